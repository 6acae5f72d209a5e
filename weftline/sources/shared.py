"""Folders that driver and executors share, for what an operator has to write before it can be read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, deleted when the JVM ends; a temporary one only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weftline-")
    path = f"{root.rstrip('/')}/weftline/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def there(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written to the shared folder and read back: computed once, and the plan ends there. A lost
    executor costs a re-read. Deleted when the JVM ends."""
    path = fresh_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


class Kept:
    """``written``, for a block: at its end all that was written in it is deleted."""

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.frames.append(written(df))
        return self.frames[-1]

    def __enter__(self) -> Kept:
        return self

    def __exit__(self, *_: object) -> None:
        for df in self.frames:
            place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_at)
            place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        self.frames.clear()
