"""Connected components by alternating large-star and small-star steps, all in DataFrames.

Neighbour lists are never gathered: a step is a minimum per node (partially aggregated) and an equi-join, so a node with
very many links is no more than a skewed join. Each round is written to the shared folder, which cuts the lineage; the
round before is then deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.scratch import dealt_anew, discard, keep


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
    return both.filter("v > u").join(dealt_anew(least, "w"), F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _open(edges: DataFrame) -> DataFrame:
    """Nodes that have two smaller ones or that are both ends: none where all edges are stars around smallest nodes."""
    twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("u")
    chain = edges.select("u").join(edges.select(F.col("v").alias("w")).distinct(), F.col("u") == F.col("w"), "left_semi")
    return twice.unionByName(chain).limit(1)


def components(spark: SparkSession, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) of every linked node that is not itself the smallest.

    Null ends and self-links are left out; no links give an empty result.
    """
    real = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = real.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = keep(spark, edges, "edges")
    while not _open(edges).isEmpty():
        old, edges = edges, keep(spark, _small(_large(edges)), "edges")
        discard(old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
