"""Running aggregates along groups of any size.

Rows are dealt by ranges of (group, order), so a group of any size spreads over as many tasks as it fills. Each range
computes its own running values; what the ranges before it have of the same group is one row for each range that a group
spans, and is added on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.scratch import keep

#: How the aggregates of two stretches of a group make that of both.
JOINED = {"sum": lambda a, b: a + b, "xor": lambda a, b: a.bitwiseXOR(b)}
AGGREGATE = {"sum": F.sum, "xor": F.bit_xor}


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` written in ranges of ``order``, with ``_part``, the number of the range."""
    return keep(df.sparkSession, df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def running(df: DataFrame, group: str, order: list[Column], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with ``_part`` and a running value for each of ``values`` (name: kind and what to add up, whole numbers).

    ``group`` has no nulls. Rows that are equal by ``group`` and ``order`` come one after the other in any order, and
    those that lie in one range stay in one task.
    """
    parts = ranged(df, F.col(group), *order)
    each = parts.groupBy("_part", group).agg(*(AGGREGATE[kind](x).alias(f"_{name}") for name, (kind, x) in values.items()))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most a row for each range
    spans = each.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), *(AGGREGATE[kind](f"_{name}").over(before).alias(f"_{name}") for name, (kind, _) in values.items()))
    spans = spans.filter(F.col(f"_{next(iter(values))}").isNotNull())
    here = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.join(spans, (F.col("_part") == F.col("_p")) & (F.col(group) == F.col("_g")), "left")
    for name, (kind, x) in values.items():
        out = out.withColumn(name, JOINED[kind](F.coalesce(F.col(f"_{name}"), F.lit(0)), AGGREGATE[kind](x).over(here)))
    return out.drop("_p", "_g", *(f"_{name}" for name in values))
