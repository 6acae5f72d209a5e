"""Ranked lexical search: term-bucketed postings, joined with the terms of the items, scored in whole numbers.

Tasks count the terms of each text and write postings in blocks: a term with the rows, counts and lengths of up to a batch of
texts. They are bucketed by term; a bucket lies in cells of one stretch of the input each, so a term that every text has
fills many cells and no cell grows. ``index`` takes all terms, or those that a bitmap of fixed size lets through.

The search joins the terms of the items to the postings while these are still blocks (a term's items in groups of at most
``ITEMS`` or so beside them), deals them by batch of texts and group of items, scores each match there and adds up by item
and document. All of a pair's matches are in one task, so matches are never shuffled, only blocks are. A window ranks; each
task keeps its first ``k`` of an item before the ranks are shuffled. All scores are made, none is estimated.

Defined results: rows of ``docs`` are documents of their own, also where they repeat an id or have none; of equal scores the
smaller id comes first, null last. Rows of ``items`` that share an id are one item, whose terms add up; a null id is an
item too. Null and empty texts have no terms; an item without terms, or whose terms no document has, has no rows, nor has
any item with empty documents. Terms of any length are kept whole. Only id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.scratch import keep

#: Bytes of terms, A-Z in lower case; all others separate.
TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BITS = 27
#: Cells have one bucket of 2 ** STRETCH tasks of the scan.
BUCKETS, STRETCH = 64, 4
#: A block is closed after so many postings or bytes of text.
MOST_POSTINGS, MOST_BYTES = 500_000, 16_000_000
ITEMS = 10_000
SCALE = 1_000_000_000


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text, in order."""
    return (text or "").encode().translate(TERM).split()


def bit_of(term: bytes) -> int:
    """The place of a term in the bitmap."""
    return xxhash.xxh64_intdigest(term) >> (64 - BITS)


class Wanted(dict):
    """Whether the bitmap has a term, remembered for the most recent ones; without a bitmap all are wanted."""

    def __init__(self, bitmap: np.ndarray | None) -> None:
        self.bitmap = bitmap

    def __missing__(self, term: bytes) -> bool:
        if len(self) > 500_000:
            self.clear()
        bit = bit_of(term)
        found = self[term] = self.bitmap is None or bool(self.bitmap[bit >> 3] >> (bit & 7) & 1)
        return found


def _blocks(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray | None, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Posting blocks of a task, and of each batch its documents as a block without a term. A batch goes by its first row."""
    wanted = Wanted(bitmap)
    rows, sizes, ids = [], [], []
    terms: dict[bytes, int] = {}
    which, at, times = [], [], []
    read = 0

    def block() -> pa.RecordBatch:
        n = np.asarray(sizes, np.int32)
        place, doc = np.asarray(which, np.int64), np.asarray(at, np.int64)
        order = np.argsort(place, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(terms)))]).astype(np.int32)
        row, tf = np.asarray(rows, np.int64), np.asarray(times, np.int32)
        lists = lambda values, of: pa.ListArray.from_arrays(pa.array(np.append(ends, ends[-1] + len(rows)).astype(np.int32)), pa.array(np.append(values[order], of)))
        known = pa.ListArray.from_arrays(pa.array([None] * len(terms) + [0, len(rows)], pa.int32()), pa.array(ids, kind))
        return pa.RecordBatch.from_arrays([
            pa.array([t.decode() for t in terms] + [None], pa.string()), pa.array([rows[0]] * (len(terms) + 1), pa.int64()), lists(row[doc], row), lists(tf, np.ones(len(rows), np.int32)), lists(n[doc], n), known,
        ], names=["term", "batch", "rows", "tfs", "ns", "ids"])

    for batch in batches:
        for row, key, text in zip(batch.column("row").to_pylist(), batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = terms_of(text)
            if not found:
                continue
            here = len(rows)
            rows.append(row)
            sizes.append(len(found))
            ids.append(key)
            for term, tf in Counter(found).items():
                if wanted[term]:
                    which.append(terms.setdefault(term, len(terms)))
                    at.append(here)
                    times.append(tf)
            read += len(text)
            if len(which) >= MOST_POSTINGS or read >= MOST_BYTES:
                yield block()
                rows, sizes, ids, terms, which, at, times, read = [], [], [], {}, [], [], [], 0
    if rows:
        yield block()


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, term, bit and times of each item, where ``item`` is a struct with the id, so that null is a key like any."""
    kind = items.schema[id_col].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("id"), batch.column("text").to_pylist(), strict=True):
                count = Counter(terms_of(text))
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(count), batch.column("id").type), pa.array([t.decode() for t in count], pa.string()), pa.array(map(bit_of, count), pa.int64()), pa.array(count.values(), pa.int64())], names=["id", "term", "bit", "times"])

    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(counted, f"id {kind}, term string, bit long, times long")
    return rows.groupBy(F.struct("id").alias("item"), "term", "bit").agg(F.sum("times").alias("times"))


def bitmap_of(terms: DataFrame) -> np.ndarray:
    """The bitmap of the terms' bits: 2 ** BITS bits whatever their number, in rows of 4 kB."""
    maps = terms.groupBy(F.expr("bit div 32768").alias("b")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("m")).collect()
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in maps:
        out[r["b"] * 4096 : r["b"] * 4096 + len(r["m"])] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def index(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Posting blocks (term, batch, rows, tfs, ns, ids) of every document, of all terms or surely those of ``terms``; the documents
    themselves are the blocks whose term is null. Written, each file sorted by term."""
    spark = docs.sparkSession
    shipped = None if terms is None else spark.sparkContext.broadcast(bitmap_of(terms))  # of fixed size
    name, kind = docs.schema[id_col].dataType.simpleString(), docs.select(F.col(id_col)).limit(0).toArrow().schema[0].type
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = texts.mapInArrow(lambda it: _blocks(it, None if shipped is None else shipped.value, kind), f"term string, batch long, rows array<long>, tfs array<int>, ns array<int>, ids array<{name}>")
    stretch = F.shiftright("batch", 33 + STRETCH)  # tasks of the scan
    cells = blocks.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).repartition(F.col("bucket"), stretch)
    return keep(spark, cells.sortWithinPartitions("bucket", "term"), "postings")


def search(postings: DataFrame, wanted: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", group: int = ITEMS) -> DataFrame:
    """item, rank, document id and score of the ``k`` best documents of each item.

    ``postings`` comes from ``index``, ``wanted`` from ``item_terms``.
    """
    blocks, texts = postings.filter("term IS NOT NULL"), postings.filter("term IS NULL")
    size = texts.agg(F.coalesce(F.sum(F.size("rows")), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(1)).cast("long").alias("l")).first()
    count, total = size["n"], size["l"]
    spark = postings.sparkSession
    items = keep(spark, wanted.select("item").distinct().select(F.monotonically_increasing_id().alias("no"), F.col("item").alias("_i")), "items")
    groups = 1 + items.count() // group
    numbered = wanted.join(items, F.col("item") == F.col("_i"))
    users = numbered.groupBy("term", F.pmod(F.xxhash64("no"), F.lit(groups)).alias("group")).agg(F.collect_list(F.struct("no", "times")).alias("users"))
    weights = blocks.groupBy("term").agg(F.sum(F.size("rows")).cast("long").alias("df"))
    w = F.floor(1000 * F.ln(F.lit(2.0 * count + 2) / (2 * F.col("df") + 1).cast("double")))
    weights = weights.select(F.col("term").alias("_w"), w.alias("w")).filter("w > 0")
    terms = keep(spark, users.join(weights, F.col("term") == F.col("_w")).select(F.col("term").alias("_t"), "group", "users", "w"), "item-terms")
    # whole numbers, as the contract has them
    hits = F.expr(f"transform(arrays_zip(rows, tfs, ns), p -> struct(p.rows AS row, w * (({SCALE}L * p.tfs) div (1000L * p.tfs + 8 * (25 + (75L * p.ns * {count}L) div {total}L))) AS impact))")
    dealt = blocks.join(terms, F.col("term") == F.col("_t")).withColumn("hits", hits)
    dealt = dealt.select("batch", "group", "users", "hits").repartition("batch", "group")
    matches = dealt.select("batch", "group", "hits", F.inline("users")).select("batch", "group", "no", "times", F.inline("hits"))
    scores = matches.groupBy("batch", "group", "no", "row").agg(F.sum(F.col("times") * F.col("impact")).alias("score")).filter("score > 0")
    tied = scores.withColumn("_r", F.rank().over(Window.partitionBy("no").orderBy(F.desc("score")))).filter(F.col("_r") <= k)
    names = texts.select(F.explode(F.arrays_zip("rows", "ids")).alias("d")).select(F.col("d.rows").alias("_row"), F.col("d.ids").alias("id"))
    named = tied.join(names, F.col("row") == F.col("_row"))
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    out = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out = out.join(items.withColumnRenamed("no", "_no"), F.col("no") == F.col("_no"))
    return out.select(F.col("_i.id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
