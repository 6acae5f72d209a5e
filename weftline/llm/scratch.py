"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` is read from the session. Only where it is unset and the master is local (tests, a laptop) a
temporary folder is used; on a cluster that is an error. A written table cuts the lineage: a lost executor costs a re-read,
not a recomputation. Tables are deleted by ``discard`` once everything made from them is written, else when the JVM ends.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local($|\[)", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return _FALLBACK[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is deleted when the JVM ends."""
    path = f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def keep(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


_OPEN: list[list[DataFrame]] = []


@contextmanager
def temporaries() -> Iterator[list[DataFrame]]:
    """Delete at the end the tables that ``keep`` writes meanwhile, but for those taken out of the list."""
    made: list[DataFrame] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.pop()
        discard(*made)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``keep`` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


BUCKETS, BITS = 4096, 32768


def _flagged(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``df`` with ``_likely``: false only where ``key`` is not in ``wanted``.

    A bitmap of 2 ** 27 bits goes to all executors: 4096 rows of 4 kB at most, whatever the input's size. With far more
    wanted keys than bits every row is likely.
    """
    bucket, bit = F.pmod(F.col(key), F.lit(BUCKETS)).cast("int"), F.pmod(F.shiftright(key, 12), F.lit(BITS))
    maps = wanted.select(bucket.alias("_b"), bit.alias("_p")).repartition("_b").groupBy("_b").agg(F.bitmap_construct_agg("_p").alias("_map"))
    byte = F.ascii(F.decode(F.substring("_map", (F.shiftright(bit, 3) + 1).cast("int"), 1), "ISO-8859-1"))
    hit = F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1
    out = df.join(F.broadcast(maps), bucket == F.col("_b"), "left")
    return out.select(*df.columns, F.coalesce(hit, F.lit(False)).alias("_likely"))


def holding(df: DataFrame, wanted: DataFrame, key: str, once: bool = False) -> DataFrame:
    """The rows of ``df`` whose ``key`` (an evenly spread long) is in ``wanted``, a written table of distinct keys; with
    ``once`` one row a key. Only likely rows are shuffled.

    An inner join, as the optimizer would move a semi-join below the bitmap.
    """
    likely = _flagged(df, wanted, key).filter("_likely").drop("_likely")
    if once:
        likely = likely.dropDuplicates([key])
    return likely.join(wanted.select(F.col(key).alias("_k")), F.col(key) == F.col("_k")).drop("_k")


def apart(df: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose ``key`` is surely not in ``wanted``, and the others, for an exact left join."""
    flagged = _flagged(df, wanted, key)
    return flagged.filter("NOT _likely").drop("_likely"), flagged.filter("_likely").drop("_likely")


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``key`` as an expression of equal value.

    An aggregate is partitioned by its key, and a join on that key then happens in place, where no partition can be split.
    Under another expression Spark shuffles the (small) aggregate again, both sides of the join are plain shuffles, and
    adaptive execution splits a hot key.
    """
    text = dict(df.dtypes)[key] == "string"
    return df.withColumn(key, F.concat(F.col(key), F.lit("")) if text else F.col(key).bitwiseXOR(F.lit(0)))
