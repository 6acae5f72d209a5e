"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

An item is a set of windows; a window is a set of shingles of three words (fewer in shorter windows). Shingles are
ordered by how often they occur in the documents. Containment is wanted whole, so the necessary prefix of a window is its
rarest shingle: only documents that have it can hold the window. The document's position of that shingle and its offset in
the window give where the window must start (positional bound) and whether it fits in the document (length bound); what
is left is verified word by word.

The index of windows is broadcast in slices of at most ``SLICE_ROWS`` rows and ``SLICE_BYTES`` bytes, one pass over the
documents for each, so what is broadcast has a bound whatever the benchmark's size.

Defined results: a null or empty text has no words. Rows with the same text have the same result. Items without words are
never found; item ids that repeat count once; a null item id counts as an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.scratch import keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is no ASCII character but a-z and 0-9, written as the characters that count: that and the possessive repeat scan fast.
WORD = r"[a-z0-9\x80-\x{10FFFF}]++"
ANY_CASE = r"[A-Za-z0-9\x80-\x{10FFFF}]++"
WINDOW, SHINGLE = 10, 3
SLICE_ROWS, SLICE_BYTES = 200_000, 32 << 20


def words_of(text: Column) -> Column:
    """The words of a whole text, A-Z lower-cased; none for null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _shingles(words: Column, size: int) -> Column:
    """Hashes of the shingles at each position (the last ones, which are short, can match nothing that verifies)."""
    parts = [words] + [F.slice(words, i + 1, F.greatest(F.size(words), F.lit(1))) for i in range(1, size)]
    names = [f"w{i}" for i in range(size)]
    zipped = F.arrays_zip(*(p.alias(n) for p, n in zip(parts, names, strict=True)))
    return F.transform(zipped, lambda x: F.xxhash64(*(x.getField(n) for n in names)))


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """Distinct (wtext, words, len, item) of the items."""
    w = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    w = w.select("item", "words", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))).alias("at"))
    w = w.select("item", F.expr(f"slice(words, at, {window})").alias("words"))
    return w.select("item", F.array_join("words", " ").alias("wtext"), "words", F.size("words").alias("len")).distinct()


def _slices(index: DataFrame, width: Column) -> int:
    n, size = index.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return max(1, -(-n // SLICE_ROWS), -(-size // SLICE_BYTES))


def _positions(texts: DataFrame, sizes: list[int]) -> Callable[[list[str]], DataFrame]:
    """A function that gives (h, words, n, size, at, sh), one row a shingle and shingle size."""

    def rows(cols: list[str]) -> DataFrame:
        parts = [texts.select(*cols, F.lit(s).alias("size"), F.posexplode(_shingles(F.col("words"), s)).alias("at", "sh")) for s in sizes]
        return reduce(DataFrame.unionByName, parts)

    return rows


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = base.select(F.md5("text").alias("h"), words_of(F.col("text")).alias("words"))
    heads = base.select("id", F.md5("text").alias("h"), F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(ANY_CASE), F.lit(0))).cast("long").alias("n_words"))
    windows = keep(spark, windows_of(items, item_col, item_text_col, window), "windows")
    distinct = windows.select("wtext", "words", "len").distinct().withColumn("size", F.least(F.lit(SHINGLE), F.col("len")))
    sizes = sorted(r[0] for r in distinct.select("size").distinct().collect())  # at most three numbers
    if not sizes:
        hits = spark.createDataFrame([], "h string, start int, len int, wtext string")
    else:
        inside = reduce(DataFrame.unionByName, [
            distinct.filter(F.col("size") == s).select("wtext", "len", "size", F.posexplode(F.slice(_shingles(F.col("words"), s), 1, F.col("len") - s + 1)).alias("off", "sh")) for s in sizes
        ])
        inside = keep(spark, inside, "window-shingles")
        known = inside.select("size", "sh").distinct()
        positions = _positions(texts, sizes)
        parts = _slices(known, F.lit(24))
        counted = []
        for i in range(parts):
            some = known.filter(F.pmod("sh", F.lit(parts)) == i)
            counted.append(positions(["words"]).select("size", "sh").join(F.broadcast(some), ["size", "sh"]).groupBy("size", "sh").count())
        counts = keep(spark, reduce(DataFrame.unionByName, counted), "counts")
        rarity = F.struct(F.coalesce("count", F.lit(0)).alias("c"), "sh", "off")
        prefix = inside.join(counts, ["size", "sh"], "left").groupBy("wtext", "len", "size").agg(F.min(rarity).alias("r"))
        # a shingle that no document has proves that its window is in none
        prefix = keep(spark, prefix.filter("r.c > 0").select("wtext", "len", "size", F.col("r.sh").alias("sh"), F.col("r.off").alias("off")), "prefixes")
        parts = _slices(prefix, F.octet_length("wtext") + 64)
        found = []
        for i in range(parts):
            some = prefix.filter(F.pmod("sh", F.lit(parts)) == i)
            c = positions(["h", "words"]).join(F.broadcast(some), ["size", "sh"])
            c = c.withColumn("start", F.col("at") - F.col("off")).filter("start >= 0 AND start + len <= size(words)")
            c = c.filter(F.array_join(F.expr("slice(words, start + 1, len)"), " ") == F.col("wtext"))
            found.append(c.select("h", "start", "len", "wtext"))
        hits = reduce(DataFrame.unionByName, found)
    hits = keep(spark, hits.distinct(), "hits")
    spans = hits.groupBy("h", "start").agg(F.max("len").alias("len")).withColumn("end", F.col("start") + F.col("len"))
    before = F.max("end").over(Window.partitionBy("h").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))  # one text's windows
    spans = spans.withColumn("before", F.coalesce(before, F.lit(0)))
    n_hit = spans.groupBy("h").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before"))).cast("long").alias("n_hit"))
    named = hits.select("h", "wtext").distinct().join(windows.select("wtext", "item").distinct(), "wtext").select("h", "item").distinct()
    named = named.groupBy("h").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    # a table of its own, so that the join with a hot text can be split
    side = keep(spark, n_hit.join(named, "h").withColumnRenamed("h", "k"), "found")
    out = keep(spark, heads, "heads").join(side, F.col("h") == F.col("k"), "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )
