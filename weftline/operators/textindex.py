"""A trigram index over the files of a corpus: a search reads the files that can match, not every line.

Two tables below one folder. ``texts`` has the files in order of their path, numbered, in small pages, so that reading a few
numbers skips the others. ``grams`` has posting blocks: three characters and the numbers of the files of a block that hold
them, sorted, as distances from the first of the block; it is split into folders by a hash of the characters, and each file is sorted by them.

A text is looked up by its rarest trigrams: blocks of the rarest are joined with those of the next ones by block, and the
lists intersected there, so common trigrams are never read whole. What is left is verified by the operators themselves, on
the lines of those files. A text of fewer than three characters has no trigram, and all files are read.

Results equal those of a scan: every line with a text is in a file that has all trigrams of the text. Trigrams don't cross
lines. Null contents are empty, a null path is no file; of files that share a path each has its own number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import text as T

#: Folders of postings; files and characters of a block; trigrams of a text that are looked up, and files read by number.
BUCKETS, BLOCK_FILES, BLOCK_CHARS, RAREST, NUMBERED = 32, 1024, 4_000_000, 4, 1000
#: Rows of a page of texts: what is skipped or read at once.
PAGE = 16


def grams_of(text: str) -> set[str]:
    """The trigrams of a text, none across a line break."""
    return {g for i in range(len(text) - 2) if "\n" not in (g := text[i : i + 3])}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting blocks of a task. Numbers rise, as the texts come in their order."""
    found: dict[str, list[int]] = {}
    first, last, files, chars = -1, -1, 0, 0

    def block() -> pa.RecordBatch:
        grams = list(found)
        lists = [(np.asarray(found[g], np.int64) - first).astype(np.int32) for g in grams]
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([first] * len(grams), pa.int64()), pa.array(map(len, lists), pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["gram", "block", "n", "places"])

    for batch in batches:
        for number, text in zip(batch.column("number").to_pylist(), batch.column("content").to_pylist(), strict=True):
            if files and (files >= BLOCK_FILES or chars >= BLOCK_CHARS or number < last):
                yield block()
                found, first, files, chars = {}, -1, 0, 0
            first, last = number if first < 0 else first, number
            for g in grams_of(text):
                found.setdefault(g, []).append(number)
            files, chars = files + 1, chars + len(text)
    if found:
        yield block()


class TextIndex:
    """An index below ``root``, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def build(cls, files: DataFrame, root: str) -> TextIndex:
        """Write the index of (path, content)."""
        out = cls(files.sparkSession, root)
        texts = files.filter("path IS NOT NULL").select("path", F.coalesce("content", F.lit("")).alias("content"))
        texts = texts.repartitionByRange("path", F.xxhash64("content")).sortWithinPartitions("path").withColumn("number", F.monotonically_increasing_id())
        texts.write.option("parquet.page.row.count.limit", PAGE).parquet(f"{out.root}/texts")
        blocks = out.texts.select("number", "content").mapInArrow(_blocks, "gram string, block long, n int, places array<int>")
        bucket = F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")
        # a task writes one folder's share of some blocks, so that no folder is one task
        dealt = blocks.withColumn("bucket", bucket).repartition(F.col("bucket"), F.shiftright("block", 33 + 4)).sortWithinPartitions("bucket", "gram")
        dealt.write.option("parquet.page.row.count.limit", 256).partitionBy("bucket").parquet(f"{out.root}/grams")
        return out

    @property
    def texts(self) -> DataFrame:
        """number, path and content of every file."""
        return self.spark.read.schema("path string, content string, number long").parquet(f"{self.root}/texts")

    @property
    def grams(self) -> DataFrame:
        """The posting blocks."""
        return self.spark.read.schema("gram string, block long, n int, places array<int>, bucket int").parquet(f"{self.root}/grams")

    def _postings(self, grams: list[str]) -> DataFrame:
        buckets = [r["b"] for r in self.spark.createDataFrame([(g,) for g in grams], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).alias("b")).distinct().collect()]  # at most BUCKETS
        return self.grams.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))

    def _numbers(self, text: str) -> DataFrame | None:
        """number of each file that has the text's rarest trigrams; None if the text has no trigram."""
        grams = sorted(grams_of(text))
        if not grams:
            return None
        counts = {r["gram"]: r["n"] for r in self._postings(grams).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # as many as the text has
        if len(counts) < len(grams):
            return self.spark.createDataFrame([], "number long")
        rarest = sorted(grams, key=lambda g: (counts[g], g))[:RAREST]
        found = None
        for g in rarest:
            side = self._postings([g]).select("block", F.transform("places", lambda p: F.col("block") + p).alias("files"))
            found = side if found is None else found.join(side.withColumnRenamed("files", "_more"), "block").select("block", F.array_intersect("files", "_more").alias("files"))
        return found.select(F.explode("files").alias("number"))

    def candidates(self, texts: list[str]) -> DataFrame | None:
        """number of each file that may hold one of the texts; None: any file may."""
        out = None
        for text in texts:
            one = self._numbers(text)
            if one is None:
                return None
            out = one if out is None else out.unionByName(one)
        return None if out is None else out.distinct()

    def files(self, texts: list[str]) -> DataFrame:
        """path and content of the files that may hold one of the texts. Few are read by number, more by a join."""
        found = self.candidates(texts)
        if found is None:
            return self.texts.select("path", "content")
        few = [r["number"] for r in found.limit(NUMBERED + 1).collect()]
        if len(few) <= NUMBERED:
            return self.texts.filter(F.col("number").isin(few) if few else F.lit(False)).select("path", "content")
        return self.texts.join(found, "number", "left_semi").select("path", "content")

    def lines(self, *texts: str) -> DataFrame:
        """path, line_no and text of the files that may hold one of the texts: what the line operators take."""
        return T.scan_lines(self.files(list(texts)))

    def holding(self, text: str) -> DataFrame:
        """Sorted paths of the files that hold a text."""
        return self.files([text]).filter(F.contains("content", F.lit(text))).select("path").distinct().orderBy("path")
