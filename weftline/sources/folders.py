"""Small files and folders in whatever store the session reaches: listing, creating, deleting. Data goes through Spark."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import SparkSession


class Folders:
    """Paths below one root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        """What is directly in a folder, sorted; nothing if it isn't there."""
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def exists(self, name: str) -> bool:
        """Whether there is such a file or folder."""
        return self._fs.exists(self._path(name))

    def age(self, name: str) -> float:
        """Seconds since a file or folder was last changed."""
        return time.time() - self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def create(self, name: str, text: str) -> bool:
        """Write a new small file; false if there is one of this name already."""
        path = self._path(name)
        if self._fs.exists(path):
            return False
        try:
            out = self._fs.create(path, False)
        except Exception as e:  # the one that came first keeps the name
            if "FileAlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def text(self, name: str) -> str:
        """The content of a small file."""
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str = "") -> None:
        """Remove a file, or a folder with all that is in it."""
        self._fs.delete(self._path(name), True)

    def size(self) -> int:
        """Bytes of all files below the root."""
        root = self._path("")
        return self._fs.getContentSummary(root).getLength() if self._fs.exists(root) else 0
