"""A corpus pipeline: documents through five operators, each over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import decontam, line_templates, mixing, ngram_join, quality
from weftline.llm.scratch import apart, discard, keep, temporaries

#: Of near duplicates: what the contract of the operator, which the stage calls, takes.
SHINGLE, PERCENT = 4, 85
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _packed(docs: DataFrame) -> DataFrame:
    """Each row as ``row`` beside its text, so that no column of the input clashes with an operator's."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Each row is judged by its own text. A null or empty text fails the base rules; repeated rows stay or go together; a
    posterior at the threshold is kept. An empty table gives an empty table.
    """
    return quality.judge(_packed(docs), ["row"]).filter("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; ``n_chars`` follows the text. A document that loses all lines stays, empty."""
    out, new = line_templates.drop_lines(_packed(docs)), {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_dropped") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def _row_key(docs: DataFrame) -> Column:
    """A key of the row itself: equal for rows that are equal, and for no others. The id leads, null last."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"), F.xxhash64(*plain).alias("row"), F.md5("text").alias("md5"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``gone`` (a written table with ``key``). Rows of other keys aren't shuffled."""
    wanted = keep(docs.sparkSession, gone.select(F.col("key.row").alias("_row")).distinct(), "gone-rows")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _row_key(docs).alias("_key")).withColumn("_row", F.col("_key.row"))
    rest, some = apart(rows, wanted, "_row")
    # no anti-join, which the optimizer would move below the bitmap
    some = some.join(gone.select(F.col("key").alias("_gone"), F.lit(True).alias("_hit")).distinct(), F.col("_key").eqNullSafe(F.col("_gone")), "left").filter("_hit IS NULL")
    return rest.select("row").unionByName(some.select("row")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of Jaccard 0.85 over four-word shingles: the one with the smallest id.

    Rows stand for themselves, also where they share an id or have none: of rows that repeat id and text the smallest by
    their other columns stays, of rows that are equal in all columns one. A document without words stays, and so does each
    repeat of it. An empty table gives an empty table.
    """
    keyed = docs.select(_row_key(docs).alias("key"), F.col("text"))
    with temporaries() as made:
        found = keep(spark, ngram_join.join(keyed, "key", size=SHINGLE, percent=PERCENT), "near-duplicates")
        made.remove(found)
    words = found.filter("n_shingles > 0")
    gone = keep(spark, words.filter(~F.col("key").eqNullSafe(F.col("component_id"))).select("key").distinct(), "gone")
    rest = _without(docs, gone)
    again = keep(spark, words.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "again")
    if again.isEmpty():
        return rest
    packed = rest.select(F.struct(*(F.col(f"`{c}`") for c in rest.columns)).alias("row"), _row_key(rest).alias("_key"))
    one = packed.join(again, F.col("_key").eqNullSafe(F.col("key")), "left_semi").dropDuplicates(["_key"])
    return _without(rest, again).unionByName(one.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Rows stand for themselves: repeats of a row, of an id, and rows without an id each stay or go by their own text. A null
    or empty text stays, and with an empty benchmark everything does. An empty table gives an empty table.
    """
    keyed = docs.select(_row_key(docs).alias("key"), F.col("text"))
    found = decontam.find(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "key")
    return _without(docs, keep(spark, found.filter("contaminated").select("key"), "contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``; columns of these
    names in the input give way.

    Rows are carried through the mix, so each has its own size and copies, also where ids are null or repeat. A document
    without words is never taken. An empty table gives an empty table.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    rows = docs.drop(*added)
    packed = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.col("doc_id"), F.col("text"), F.col("source"))
    return mixing.mix(packed, carry=("row",)).filter("copies > 0").select("row.*", *added)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
]

#: Quality rules and mixing iterate to a fixed point, which SQL doesn't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, keep(spark, stage(spark, docs, sf_dir), name)
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
