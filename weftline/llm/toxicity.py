"""Toxicity: a counterfactual-regularised classifier.

A logistic model over the words of a text and their prefixes (for languages that write compounds), scaled by their naive
Bayes log-odds. Weights are not negative: a text is toxic for what it says, and ordinary words don't make up for it, so
length alone changes little. For every training text with an identity term the term is swapped for others of its group and
the squared change of the score is penalised, which takes the weight off neutral mentions of groups.

Identity terms are the listed groups (a parameter; the list is English) and one group learnt from the labels, for whatever
language the corpus is in: words that many texts of both classes have and that lean to the toxic one no more than
``MAX_ODDS``, at most ``LEARNT_TERMS``. Those are the words on which a model picks up bias: they go along with toxic texts, but
most of what they are in may be neutral.

It is fitted on at most ``SAMPLE_ROWS`` labelled rows, those with the smallest hash of their id. Features are counted and
chosen by Spark; the driver gets the chosen ones (at most ``MOST_FEATURES``) and which of them each sampled text has. Every
document is scored whole. Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts get the score of a text without known words. Labels that are null, whose id is null,
or that contradict each other for one id are not used; of texts that share an id the one with the smallest hash is read; a
text without a label is scored like any other. Without any usable positive label every score is near 0, without any
negative one near 1. Repeated rows stay repeated. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import discard, keep

SAMPLE_ROWS, MOST_FEATURES, LEARNT_TERMS = 10_000, 100_000, 200
BUCKETS = 1 << 22
PREFIXES = (4, 5)
MIN_TEXTS, MIN_LOG_ODDS, MAX_ODDS, MIN_Z, RIDGE, FAIRNESS, STEPS = 5, 1.0, 2.5, 3.0, 0.1, 4.0, 300
#: Identity terms by group. Fixed values.
IDENTITY_GROUPS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("woman", "man"),
    ("women", "men"),
    ("girls", "boys"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("african", "european", "american", "mexican", "chinese", "turkish"),
    ("immigrants", "foreigners", "refugees", "natives"),
)
WORD = re.compile(r"\w+")


def _bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def word_features(word: str) -> list[int]:
    """The buckets of one word: itself and its prefixes."""
    return [_bucket("w" + word), *(_bucket(f"p{n}{word[:n]}") for n in PREFIXES if len(word) >= n)]


def words_of(text: str | None) -> set[str]:
    """The distinct words of a whole text."""
    return set(WORD.findall((text or "").lower()))


Groups = tuple[tuple[str, ...], ...]


def swaps(words: set[str], groups: Groups, learnt: dict[str, list[int]]) -> list[tuple[list[int], list[int]]]:
    """Features that go and that come when an identity term of a text is swapped for each other one of its group. A learnt
    term, which comes with its own features, is swapped for its two neighbours in the list."""
    out = [(word_features(a), word_features(b)) for group in groups for a in group if a in words for b in group if b != a]
    if len(learnt) > 1:
        names = list(learnt)
        place = {w: i for i, w in enumerate(names)}
        for a in sorted(words & place.keys()):
            out += [(learnt[a], learnt[names[(place[a] + k) % len(names)]]) for k in ((1, -1) if len(names) > 2 else (1,))]
    return out


class Model:
    """Weights by bucket and a bias; ``pairs`` tells how many swaps were penalised, ``learnt`` which terms were learnt."""

    def __init__(self, weights: dict[int, float], bias: float, pairs: int = 0, learnt: tuple[str, ...] = ()) -> None:
        self.weights, self.bias, self.pairs, self.learnt = weights, bias, pairs, learnt

    def score(self, text: str | None, known: dict[str, tuple[int, ...]]) -> float:
        """Probability of toxic; ``known`` remembers words' weighted buckets."""
        found: set[int] = set()
        weights = self.weights
        for w in words_of(text):
            f = known.get(w)
            if f is None:
                f = known[w] = tuple(b for b in word_features(w) if b in weights)
            if f:
                found.update(f)
        z = self.bias + sum(weights[b] for b in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[list[int], list[int]]], used: np.ndarray, odds: np.ndarray, fairness: float = FAIRNESS, learnt: tuple[str, ...] = ()) -> Model:
    """Fit on lists of places in ``used`` (buckets, with their log-odds). ``pairs`` has places that go and that come."""
    y = np.asarray(labels, float)
    n, positive = len(y), float(y.sum())
    if not positive or positive == n:
        return Model({}, 40.0 if n and positive == n else -40.0)
    lengths = np.array([len(r) for r in rows])
    row, col = np.repeat(np.arange(n), lengths), np.concatenate([np.asarray(r, np.int64) for r in rows])
    scale = odds
    value = scale[col]
    swap = [(i, sign, c) for i, (before, after) in enumerate(pairs) for sign, side in ((1, before), (-1, after)) for c in side]
    swap_row, swap_col = np.array([x[0] for x in swap], int), np.array([x[2] for x in swap], int)
    swap_value = np.array([x[1] for x in swap], float) * scale[swap_col]
    w, bias = np.zeros(len(used)), float(np.log(positive / (n - positive)))
    m = len(pairs)
    squares, bias_square = np.full(len(used), 1e-8), 1e-8
    importance = np.where(y > 0, (n - positive) / positive, 1.0) ** 0.5
    for _ in range(STEPS):
        z = np.bincount(row, weights=value * w[col], minlength=n) + bias
        error = importance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = np.bincount(col, weights=value * error[row], minlength=len(used)) + RIDGE * w
        if m and fairness:
            change = np.bincount(swap_row, weights=swap_value * w[swap_col], minlength=m)
            grad += fairness * n / m * np.bincount(swap_col, weights=swap_value * change[swap_row], minlength=len(used))
        squares += grad**2
        w = np.maximum(0.0, w - 0.3 * grad / np.sqrt(squares))
        g = error.sum()
        bias_square += g * g
        bias -= 0.3 * g / np.sqrt(bias_square)
    strong = w * scale > 0.01
    return Model({int(b): float(x) for b, x in zip(used[strong], (w * scale)[strong], strict=True)}, float(bias), m, learnt)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts, and in how many toxic ones, a task's batch has each word and each bucket."""
    for batch in batches:
        count: list[Counter] = [Counter(), Counter(), Counter(), Counter()]
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = words_of(text)
            found = {b for w in words for b in word_features(w)}
            count[0].update(words)
            count[2].update(found)
            if toxic:
                count[1].update(words)
                count[3].update(found)
        words, buckets = list(count[0]), list(count[2])
        for i in range(0, max(len(words), len(buckets)), 100_000):
            w, b = words[i : i + 100_000], buckets[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([
                pa.array(w + [None] * len(b), pa.string()), pa.array([None] * len(w) + b, pa.int32()),
                pa.array([count[0][x] for x in w] + [count[2][x] for x in b], pa.int64()), pa.array([count[1][x] for x in w] + [count[3][x] for x in b], pa.int64()),
            ], names=["word", "bucket", "n", "t"])


def _featurize(batches: Iterator[pa.RecordBatch], place: dict[int, int], groups: Groups, learnt: dict[str, list[int]]) -> Iterator[pa.RecordBatch]:
    nested = pa.list_(pa.list_(pa.int32()))
    known = lambda features: sorted({place[b] for b in features if b in place})
    for batch in batches:
        rows, before, after = [], [], []
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            rows.append(known(b for w in words for b in word_features(w)))
            pairs = [(known(a), known(b)) for a, b in swaps(words, groups, learnt)]
            before.append([a for a, _ in pairs])
            after.append([b for _, b in pairs])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array(rows, pa.list_(pa.int32())), pa.array(before, nested), pa.array(after, nested)], names=["id", "toxic", "features", "before", "after"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, groups: Groups = IDENTITY_GROUPS, fairness: float = FAIRNESS) -> Model:
    """Fit on at most ``sample_rows`` rows of ``labels``."""
    spark = docs.sparkSession
    clean = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IS NOT NULL")
    clean = clean.groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other").drop("other")
    chosen = clean.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(sample_rows).select("id", "toxic")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")  # at most sample_rows rows
    texts = keep(spark, texts.groupBy("id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")), "sample")
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("toxic") > 0).cast("int")), F.lit(0)).alias("t")).first()
    if not size.t or size.t == size.n:
        return Model({}, 40.0 if size.n and size.t == size.n else -40.0)
    counts = keep(spark, texts.select("text", (F.col("toxic") > 0).alias("toxic")).mapInArrow(_counted, "word string, bucket int, n long, t long").groupBy("word", "bucket").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), "feature-counts")
    clear = F.col("n") - F.col("t")
    odds = F.log((F.col("t") + 0.5) / (size.t + 1)) - F.log((clear + 0.5) / (size.n - size.t + 1))
    # features whose odds may well be chance would add up in long texts
    z = odds / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (clear + 0.5))
    kept, counts = counts, counts.withColumn("odds", odds).withColumn("z", z)
    best = counts.filter((F.col("bucket").isNotNull()) & (F.col("n") >= MIN_TEXTS) & (F.col("odds") >= MIN_LOG_ODDS) & (F.col("z") >= MIN_Z))
    best = best.orderBy(F.desc("z"), "bucket").limit(MOST_FEATURES).select("bucket", "odds").collect()
    best.sort(key=lambda r: r["bucket"])
    both = counts.filter(F.col("word").isNotNull() & (F.col("t") >= MIN_TEXTS) & (clear >= MIN_TEXTS) & F.col("odds").between(MIN_LOG_ODDS, MAX_ODDS))
    learnt = {r["word"]: r["n"] for r in both.orderBy(F.desc("n"), "word").limit(LEARNT_TERMS).select("word", "n").collect()}
    # a prefix belongs to a term if hardly any other word has it; a stem that the term shares with insults doesn't
    wanted = sorted({b for w in learnt for b in word_features(w)})
    times = {r["bucket"]: r["n"] for r in counts.filter(F.col("bucket").isin(wanted)).select("bucket", "n").collect()} if wanted else {}
    own = {w: [b for b in word_features(w) if times.get(b, 0) <= 1.25 * n] for w, n in learnt.items()}
    used, scale = np.array([r["bucket"] for r in best], np.int64), np.array([r["odds"] for r in best], float)
    place = {int(b): i for i, b in enumerate(used)}
    kind = docs.schema[id_col].dataType.simpleString()
    found = texts.mapInArrow(lambda it: _featurize(it, place, groups, own), f"id {kind}, toxic int, features array<int>, before array<array<int>>, after array<array<int>>").toArrow()
    found = found.sort_by("id")
    pairs = [(a, b) for x, y in zip(found.column("before").to_pylist(), found.column("after").to_pylist(), strict=True) for a, b in zip(x, y, strict=True)]
    discard(texts, kept)
    return fit([x.values.to_numpy(zero_copy_only=False) for x in found.column("features")], found.column("toxic").to_numpy() > 0, pairs, used, scale, fairness, tuple(learnt))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[int, ...]] = {}
    for batch in batches:
        scores = []
        for t in batch.column("text").to_pylist():
            if len(known) > 300_000:
                known.clear()
            scores.append(model.score(t, known))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], names=["id", "score"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and predicted of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = texts.mapInArrow(lambda it: _scored(it, model), f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
