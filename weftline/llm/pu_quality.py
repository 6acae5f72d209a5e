"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Only positives are trusted: rows labelled good. All documents are the unlabelled set. A first logistic model tells positives from unlabelled
rows; among the documents that it scores highest there are hardly any bad ones, so the share of all documents
there over the share of positives there estimates the class prior from above, and the smallest such ratio is taken. The
classifier then minimises

    prior * mean_P loss(z)  +  max(0, mean_U loss(-z) - prior * mean_P loss(-z))

over linear scores z of bounded features of the whole text. Where the second part is negative the step goes against it. Each step is one
pass over the table of features of all documents: tasks add up losses, gradients and curvatures at a few trial points, and
what reaches the driver has the size of the features squared, whatever the input. Labels, language, source and id are no
inputs of a score; labels of 0 are not used at all.

Defined results: null and empty texts have features like any (all that need words are 0). A label that is null, whose id is
null or that is contradicted for the same id isn't trusted; a trusted id trusts all rows that repeat it. Without any trusted
row every score is 0, without any document there are none. Repeated rows stay repeated. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import discard, keep

SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of ordinary prose: letters, also those outside ASCII, white space and plain punctuation.
PLAIN = bytes(c for c in range(256) if c >= 128 or chr(c).isalpha() or c in b" \t\n\x0b\x0c\r.,;:?'\"()-")
SIGNS = b".,;:?!'\"()-#*$%&|<>/\\=+~_^@[]{}"
_PLAIN_SET = frozenset(PLAIN)
#: Name of each measure and the values up to which its ramps rise, from 0 to 1.
MEASURES = (
    ("words", (3.0, 6.0, 9.0)),  # logarithm of their number
    ("word_length", (4.0, 6.0, 9.0, 14.0)),
    ("odd_characters", (0.02, 0.1, 0.3)),
    ("words_with_odd_end", (0.05, 0.2, 0.6)),
    ("lone_odd_words", (0.02, 0.1, 0.3)),
    ("upper_words", (0.05, 0.2, 0.6)),
    ("shouts", (0.02, 0.1, 0.5)),
    ("digits", (0.02, 0.1, 0.3)),
    ("stutter", (0.02, 0.1, 0.5)),
    ("repeated_words", (0.1, 0.3, 0.7)),
    ("commonest_word", (0.1, 0.2, 0.5)),
    ("different_words", (0.2, 0.5, 0.8)),
    ("repeated_lines", (0.1, 0.3, 0.6)),
    ("short_lines", (0.2, 0.5, 0.9)),
    ("sentences", (0.03, 0.08, 0.2)),
)
SIZE = 1 + sum(len(knots) for _, knots in MEASURES)
RIDGE, STEPS, TRIALS = 1e-4, 14, (1.0, 0.5, 0.2, 0.05)
#: Bins of the first model's scores, and the least share of positives in the tail that gives the prior.
BINS, LEAST_TAIL = 400, 0.3


def measures(text: str | None) -> tuple[float, ...]:
    """The measures of a whole text, in order."""
    raw = (text or "").encode()
    words = raw.split()
    n = max(len(words), 1)
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    chars = max(len(raw) - sum(raw.count(c) for c in SPACE), 1)
    odd = raw.translate(None, PLAIN)
    repeat = 0
    if len(words) >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        repeat = len(windows) - len(set(windows))
    counts = Counter(words)
    ends = Counter(w[-1] for w in words)
    alone = sum(k for w, k in counts.items() if not w.translate(None, SIGNS))
    return (
        float(np.log1p(len(words))), chars / n, len(odd) / chars, sum(k for c, k in ends.items() if c not in _PLAIN_SET) / n, alone / n,
        sum(map(bytes.isupper, words)) / n, raw.count(b"!") / n, sum(raw.count(c) for c in b"0123456789") / chars,
        sum(map(eq, words, words[1:])) / n, repeat / n, (max(counts.values()) if counts else 0) / n, len(counts) / n,
        (len(lines) - len(set(lines))) / max(len(lines), 1), sum(len(x.split(None, 4)) < 4 for x in lines) / max(len(lines), 1),
        sum(ends[c] for c in b".?") / n,
    )


def features(text: str | None) -> list[float]:
    """A constant, and each measure as ramps: between one knot and the next from 0 to 1."""
    out = [1.0]
    for value, (_, knots) in zip(measures(text), MEASURES, strict=True):
        low = 0.0
        for high in knots:
            out.append(min(1.0, max(0.0, (value - low) / (high - low))))
            low = high
    return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(x, pa.list_(pa.float32()))], names=["id", "x"])


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column("x")
    return x.flatten().to_numpy().reshape(len(x), SIZE).astype(float), batch.column("trusted").to_numpy(zero_copy_only=False)


def soft(z: np.ndarray) -> np.ndarray:
    """log(1 + exp(z)): the logistic loss of ``-z``."""
    return np.logaddexp(0.0, z)


def sums_at(x: np.ndarray, trusted: np.ndarray, points: np.ndarray) -> np.ndarray:
    """For each point: number of rows and of trusted ones, losses of U at -z and P at z and at -z, gradients of these
    three, curvatures of U and of P; as one vector."""
    out = []
    for w in points:
        z = np.clip(x @ w, -40, 40)
        s = 1 / (1 + np.exp(-z))
        p, zp, sp = x[trusted], z[trusted], s[trusted]
        curve = s * (1 - s)
        out.append(np.concatenate([
            [len(x), len(p), soft(z).sum(), soft(-zp).sum(), soft(zp).sum()], x.T @ s, p.T @ (sp - 1), p.T @ sp,
            (x.T @ (x * curve[:, None])).ravel(), (p.T @ (p * curve[trusted][:, None])).ravel(),
        ]))
    return np.concatenate(out)


def _added_up(table: DataFrame, points: np.ndarray) -> np.ndarray:
    """``sums_at`` over all rows; a task gives one row, and these are added up by place."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = sums_at(*_matrix(batch), points)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    rows = table.mapInArrow(each, "v array<double>").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).toArrow()  # one row a place
    out = np.zeros(len(points) * (5 + 3 * SIZE + 2 * SIZE**2))
    out[rows.column("k").to_numpy()] = rows.column("v").to_numpy()
    return out.reshape(len(points), -1)


def _parts(v: np.ndarray) -> dict[str, np.ndarray | float]:
    n, p = max(v[0], 1.0), max(v[1], 1.0)
    g, h = v[5 : 5 + 3 * SIZE].reshape(3, SIZE), v[5 + 3 * SIZE :].reshape(2, SIZE, SIZE)
    return {"u": v[2] / n, "p": v[3] / p, "p-": v[4] / p, "du": g[0] / n, "dp": g[1] / p, "dp-": g[2] / p, "hu": h[0] / n, "hp": h[1] / p}


def risk(v: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The non-negative risk, its part that may not be negative, the direction down, and the curvature."""
    s = _parts(v)
    negative = s["u"] - prior * s["p-"]
    slope = s["du"] - prior * s["dp-"]
    down = prior * s["dp"] + slope if negative >= 0 else -slope
    # the loss of z less that of -z is -z, so the curvatures over the positives cancel out
    return float(prior * s["p"] + max(0.0, negative)), float(negative), down, s["hu"]


def separation(v: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Risk of telling positives from unlabelled rows, as ``risk`` has it."""
    s = _parts(v)
    return float(s["p"] + s["u"]), 0.0, s["dp"] + s["du"], s["hu"] + s["hp"]


def minimise(table: DataFrame, goal, start: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Newton steps; each pass takes the best of a few lengths of the step before, and the sums there for the next."""
    w, step, best = start, np.zeros(SIZE), np.inf
    for _ in range(steps):
        points = np.array([w + t * step for t in (TRIALS if step.any() else (0.0,))])
        values = _added_up(table, points)
        found = [goal(v) for v in values]
        costs = [f[0] + RIDGE * p[1:] @ p[1:] / 2 for f, p in zip(found, points, strict=True)]
        k = int(np.argmin(costs))
        if costs[k] >= best - 1e-7:
            break
        best, w = costs[k], points[k]
        ridge = np.full(SIZE, RIDGE)
        ridge[0] = 1e-9
        step = -np.linalg.solve(found[k][3] + np.diag(ridge + 1e-7), found[k][2] + ridge * w)
    return w, best


def class_prior(table: DataFrame, w: np.ndarray) -> float:
    """The smallest ratio of shares, of all rows and of positives, over the tails of the scores."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, trusted = _matrix(batch)
            b = np.clip(((x @ w) + 10) * BINS / 20, 0, BINS - 1).astype(np.int64)
            both = np.stack([np.bincount(b, minlength=BINS), np.bincount(b[trusted], minlength=BINS)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(both[0]), pa.array(both[1])], names=["b", "u", "p"])

    rows = table.mapInArrow(binned, "b long, u long, p long").groupBy("b").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).toArrow()  # BINS rows
    u, p = np.zeros(BINS), np.zeros(BINS)
    u[rows.column("b").to_numpy()], p[rows.column("b").to_numpy()] = rows.column("u").to_numpy(), rows.column("p").to_numpy()
    n, m = u.sum(), p.sum()
    above_u, above_p = u[::-1].cumsum()[::-1] / n, p[::-1].cumsum()[::-1] / m
    # few positives in a tail make its ratio uncertain: two deviations are added
    enough = above_p >= LEAST_TAIL
    ratio = above_u[enough] / above_p[enough] * (1 + 2 * np.sqrt((1 - above_p[enough]) / (above_p[enough] * m)))
    return float(np.clip(ratio.min(), 0.01, 0.99))


class Model:
    """Weights of the features and the prior they were learnt with; no weights: nothing was trusted."""

    def __init__(self, weights: np.ndarray | None, prior: float, risk: float) -> None:
        self.weights, self.prior, self.risk = weights, prior, risk

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -40, 40)))


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and features of every row, written."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_featured, f"id {kind}, x array<float>")
    return keep(docs.sparkSession, rows, "features")


def train(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Learn from ``featured`` rows and the labels of 1."""
    clean = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).filter("_id IS NOT NULL AND y IS NOT NULL")
    trusted = clean.groupBy("_id").agg(F.min("y").alias("y")).filter("y = 1").select("_id", F.lit(True).alias("_y"))
    table = keep(rows.sparkSession, rows.join(trusted, F.col("id") == F.col("_id"), "left").select("x", F.coalesce("_y", F.lit(False)).alias("trusted")), "trusted")
    if table.filter("trusted").isEmpty():
        discard(table)
        return Model(None, 0.0, 0.0)
    first, _ = minimise(table, separation, np.zeros(SIZE))
    prior = class_prior(table, first)
    w, cost = minimise(table, lambda v: risk(v, prior), np.zeros(SIZE))
    discard(table)
    return Model(w, prior, cost)


def score(rows: DataFrame, model: Model, id_col: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """id, score and predicted of every row of ``featured``."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            s = model.scores(x.flatten().to_numpy().reshape(len(x), SIZE).astype(float))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s, pa.float64())], names=["id", "score"])

    out = rows.mapInArrow(scored, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
