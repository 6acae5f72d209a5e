"""Quality rules by weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0). Votes are counted over all documents; expectation-maximisation on
those counts estimates how often each rule votes what when a document is good or bad, and the posterior probability that
a document is good replaces the demand that it pass every rule. There are at most 3 ** len(RULES) vote patterns, so what
reaches the driver has a fixed bound whatever the size of the input.

Defined results: a null or empty text has no words and fails the base rules. Repeated rows stay repeated. Ties (posterior
exactly at the threshold) are kept. An empty table gives an empty result. No other column is read.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Bytes of ordinary prose: letters, also those outside ASCII, white space and plain punctuation.
PLAIN = bytes(c for c in range(256) if c >= 128 or chr(c).isalpha() or c in b" \t\n\x0b\x0c\r.,;:?'\"()-")
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: name, value of the feature from which the rule votes bad, value up to which it votes good
RULES = (
    ("symbols_per_word", 0.2, 0.05),
    ("junk_share", 0.14, 0.1),
    ("repeated_share", 0.4, 0.2),
    ("stutter_share", 0.3, 0.05),
    ("dup_line_share", 0.5, 0.34),
    ("upper_share", 0.4, 0.1),
    ("shouts_per_word", 0.3, 0.05),
    ("word_length_off", 5.0, 3.0),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def measure(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The five base counts of a whole text, and the value of each rule's feature."""
    if not text:
        return (0, 0, 0, 0, 0), (0.0,) * len(RULES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly these six characters
    n = len(words)
    chars = len(text) - sum(raw.count(c) for c in SPACE)
    symbols = sum(raw.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            end = 0
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeat += i + 3 - max(i, end)
                    end = i + 3
    upper = sum(map(bytes.isupper, words))
    stutter = sum(map(eq, words, words[1:]))
    junk = len(raw.translate(None, delete=PLAIN))
    per, size = max(n, 1), max(chars, 1)
    features = (symbols / per, junk / size, repeat / per, stutter / per, dup / max(len(lines), 1), upper / per, raw.count(b"!") / per, abs(chars / per - 5.5))
    return (n, chars, symbols, dup, repeat), features


def vote(features: tuple[float, ...]) -> int:
    """The votes as one number, a base-3 digit a rule (0 bad, 1 none, 2 good)."""
    code = 0
    for value, (_, bad, good) in zip(features, RULES, strict=True):
        code = code * 3 + (0 if value >= bad else 2 if value <= good else 1)
    return code


def _votes_of(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3**k % 3 for k in range(len(RULES) - 1, -1, -1)], axis=1)


def fit_posteriors(counts: dict[int, int], rounds: int = 200, prior_bad: float = 0.2) -> dict[int, float]:
    """Probability of good for each observed vote pattern.

    Two classes, votes independent given the class. A bad document breaks few of the rules, so a bad vote says much and a
    good one little: that is the start, and a Dirichlet prior of a hundredth of the weight keeps the classes from
    swapping names.
    """
    if not counts:
        return {}
    codes = np.array(sorted(counts))
    weight = np.array([counts[c] for c in codes], dtype=float)
    votes, k = _votes_of(codes), len(RULES)
    onehot = np.stack([votes == v for v in range(3)], axis=2).astype(float)
    start = np.array([[0.25, 0.15, 0.6], [0.01, 0.19, 0.8]])
    prob = np.repeat(start[:, None, :], k, axis=1)
    pseudo = 0.01 * weight.sum() * start[:, None, :]
    share = np.array([prior_bad, 1 - prior_bad])
    post = np.zeros((len(codes), 2))
    for _ in range(rounds):
        log = np.log(share) + np.einsum("pkv,ckv->pc", onehot, np.log(prob))
        new = np.exp(log - log.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        done = np.abs(new - post).max() < 1e-9
        post = new
        mass = weight[:, None] * post
        prob = np.einsum("pc,pkv->ckv", mass, onehot) + pseudo
        prob /= prob.sum(axis=2, keepdims=True)
        share = np.clip(mass.sum(axis=0) / weight.sum(), 0.001, 0.999)
        if done:
            break
    return {int(c): float(p) for c, p in zip(codes, post[:, 1], strict=True)}


def _measured(texts: pa.Array) -> pa.Array:
    base, codes = [], []
    for text in texts:  # one text in Python at a time, not all of a batch
        counts, features = measure(text.as_py())
        base.append(counts)
        codes.append(vote(features))
    cols = list(zip(*base, strict=True)) if base else [()] * len(BASE)
    return pa.StructArray.from_arrays([*(pa.array(x, pa.int64()) for x in cols), pa.array(codes, pa.int32())], names=[*BASE, "_votes"])


def with_votes(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """The carried columns, the base counts and the votes of each row. Only texts go to Python and only numbers come back."""
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in BASE), T.StructField("_votes", T.IntegerType())])
    # not called deterministic, as the optimizer would run it once more below a filter
    counted = F.arrow_udf(_measured, schema).asNondeterministic()
    return docs.select(*(F.col(c) for c in carry), counted(F.col(text_col)).alias("_counted")).select(*carry, "_counted.*")


def learn(docs: DataFrame, text_col: str = "text") -> dict[int, float]:
    """Posterior of each vote pattern, learnt from the votes on all documents."""
    rows = with_votes(docs, [], text_col).groupBy("_votes").count().collect()  # at most 3 ** len(RULES) rows
    return fit_posteriors({r["_votes"]: r["count"] for r in rows})


def judge(docs: DataFrame, carry: list[str], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The carried columns, the base counts, base_failed, p_good and kept for each row."""
    posteriors = learn(docs, text_col)
    spark = docs.sparkSession
    table = spark.createDataFrame(list(posteriors.items()) or [(0, 0.0)], "_votes int, p_good double")
    out = with_votes(docs, carry, text_col).join(F.broadcast(table), "_votes", "left")  # at most 3 ** len(RULES) rows
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.coalesce("p_good", F.lit(0.0)) >= threshold))
    return out.select(*carry, *BASE, "base_failed", "p_good", "kept")


def all_patterns() -> Iterator[int]:
    """Every vote pattern, for tests."""
    return (sum(v * 3 ** (len(RULES) - 1 - i) for i, v in enumerate(x)) for x in itertools.product(range(3), repeat=len(RULES)))
