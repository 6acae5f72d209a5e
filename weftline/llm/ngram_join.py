"""N-gram Jaccard join: exact, by pigeonhole over a partitioned universe.

A document is its set of distinct 4-word shingles. Two sets of at most U items with similarity t differ in at most
H = (1 - t) / (1 + t) * 2U items. Sizes are cut into bands so that linked sets are in the same band or in neighbouring
ones; the partition of a band serves the pairs whose larger set is in it, so each set takes part in two. A partition
hashes items into m = H + 1 + E segments. Linked sets agree in at least 1 + E segments. The cost of a segment decides its
share of the allowance: empty segments, which all sets have in common, get none. A set with at most E of them indexes
each other segment as it is; a set with more indexes its segments and, in a name space of such sets, also the one-deletion
neighbourhoods, which count double; the rare set for which even that can't suffice meets its like under one key. Sets that
share a key are verified exactly; a sketch of 1,024 parities spares the items of sets that are too far apart.

Defined results: a null or empty text has no shingles, links with nothing and is its own component. Rows with the same
text, repeated ids included, are in one component. A null id is a member but never the smallest; a component of null ids
alone has a null id. Equal sets are one class, found by a 64-bit key whose uniqueness a second key proves; if two
different sets ever share the first, the job takes another seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import discard, holding, keep
from weftline.llm.shingles import LOWER, STEP, Seen, Words, mix, set_key, shingle_set
from weftline.llm.simjoin import similar_components

FLUSH, SKETCH = 500_000, 1024


def text_set(text: str | None, size: int, memory: Words) -> np.ndarray:
    """The set of one whole text."""
    return shingle_set(text.encode("utf-8", "surrogatepass").translate(LOWER).split(), size, memory) if text else np.empty(0, np.uint64)


class Bands:
    """Size bands for a similarity of ``percent`` in 100, with their error bounds and segment counts."""

    def __init__(self, percent: int) -> None:
        self.percent, self.tops = percent, [1]
        # E for each H: enough that few sets have more empty segments; at lower similarities segments are smaller
        self.share = 20 if percent >= 85 else 8

    def of(self, n: int) -> int:
        """The band of a set of n items."""
        while self.tops[-1] < n:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * 100 // self.percent))
        return int(np.searchsorted(self.tops, n))

    def partition(self, band: int) -> tuple[int, int]:
        """(H, E) of a band."""
        while len(self.tops) <= band:
            self.of(self.tops[-1] + 1)
        errors = 2 * self.tops[band] * (100 - self.percent) // (100 + self.percent)
        return errors, -(-(errors + 1) // self.share) if errors else 0


def signatures(items: np.ndarray, bands: Bands) -> np.ndarray:
    """The keys under which a set is indexed."""
    out = []
    band = bands.of(len(items))
    for k in (band, band + 1):
        errors, spare = bands.partition(k)
        m = errors + 1 + spare
        seed = mix(np.array([k], np.uint64) * STEP)
        seg = (mix(items ^ seed) % np.uint64(m)).astype(np.int64)
        value = mix(items + seed)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, seg, value)
        used = np.bincount(seg, minlength=m) > 0
        place = mix(np.arange(m, dtype=np.uint64) + seed)
        out.append(mix(sums + place)[used])
        empty = m - int(used.sum())
        if empty > spare:
            apart = place ^ M_APART
            out.append(mix(sums + apart)[used])
            out.append(mix(sums[seg] - value + apart[seg])[np.bincount(seg, minlength=m)[seg] > 1])
            if 3 * empty >= 2 * m - errors:
                out.append(mix(seed ^ M_ALONE))
    return np.unique(np.concatenate(out))


M_APART, M_ALONE = np.uint64(0x5851F42D4C957F2D), np.uint64(0x2545F4914F6CDD1D)


def sketch(items: np.ndarray) -> np.ndarray:
    """How many items, even or odd, have each of ``SKETCH`` remainders: a bit for each."""
    return np.packbits(np.bincount((items % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).view(np.int64)


def _heads(batches: Iterator[pa.RecordBatch], size: int, seed: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Every row's set key; the signatures too, unless this task has just given those of the same set."""
    memory, seen, bands = Words(), Seen(), Bands(percent)
    long, names = pa.int64(), ["id", "th", "n", "cls", "second", "keys", "sketch"]
    for batch in batches:
        at, rows, held = 0, [], 0

        def flush(batch: pa.RecordBatch, at: int, rows: list[tuple]) -> pa.RecordBatch:
            n, cls, second, keys, sketch = zip(*rows, strict=True)
            part = batch.slice(at, len(rows))
            return pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), pa.array(n, long), pa.array(cls, long), pa.array(second, long), pa.array(keys, pa.list_(long)), pa.array(sketch, pa.list_(long))], names=names)

        for t in batch.column("text"):  # one text in Python at a time, not all of a batch
            items = text_set(t.as_py(), size, memory)
            cls, second, keys, bits = None, None, None, None
            if len(items):
                cls, second = set_key(items, seed), set_key(items, seed + 1_000_003)
                if not seen(cls):
                    keys, bits = signatures(items, bands).view(np.int64), sketch(items)
            rows.append((len(items), cls, second, keys, bits))
            held += 0 if keys is None else len(keys)
            if held > FLUSH:
                yield flush(batch, at, rows)
                at, rows, held = at + len(rows), [], 0
        if rows:
            yield flush(batch, at, rows)


def _items(batches: Iterator[pa.RecordBatch], size: int, seed: int) -> Iterator[pa.RecordBatch]:
    memory = Words()
    for batch in batches:
        rows = [(set_key(x, seed), x.view(np.int64)) for t in batch.column("text") if len(x := text_set(t.as_py(), size, memory))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["cls", "items"])


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    seed = 0
    while True:
        heads = keep(spark, texts.mapInArrow(lambda it, s=seed: _heads(it, size, s, percent), f"id {kind}, th long, n long, cls long, second long, keys array<long>, sketch array<long>"), "heads")
        if heads.groupBy("cls").agg(F.min("second").alias("a"), F.max("second").alias("b")).filter("a <> b").isEmpty():
            break
        discard(heads)
        seed += 1

    def fetch(wanted: DataFrame) -> DataFrame:
        th = heads.groupBy("cls").agg(F.min("th").alias("th")).join(wanted, "cls", "left_semi").select("th").distinct()  # copies are counted out before the join
        chosen = holding(texts.select("text", "th"), keep(spark, th, "wanted"), "th", once=True).select("text")
        return chosen.mapInArrow(lambda it: _items(it, size, seed), "cls long, items array<long>")

    comps = similar_components(spark, heads.select("cls", "n", "keys", "sketch"), fetch, percent)
    heads = heads.drop("keys", "sketch")
    classes = heads.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("least"))
    classes = classes.join(comps, F.col("cls") == F.col("node"), "left").select("cls", "least", F.coalesce("component", "cls").alias("component"))
    names = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    # a table of its own, so that the join with a hot class can be split
    named = keep(spark, classes.join(names, "component").select(F.col("cls").alias("c"), "component_id"), "named")
    out = heads.join(named, F.col("cls") == F.col("c"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
