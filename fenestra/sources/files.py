"""Small files and folders in any store that Spark reaches, and where scratch tables go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir; on one machine in a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


class Folder:
    """A folder below which small texts are written whole or not at all."""

    def __init__(self, spark: SparkSession, home: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(home).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm, self.home = jvm, home.rstrip("/")

    def _at(self, name: str):
        return self._path(f"{self.home}/{name}")

    def names(self, of: str) -> list[str]:
        at = self._at(of)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_once(self, name: str, text: str) -> None:
        """Makes the text visible by one rename; fails if the name is taken."""
        temporary = self._at(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(temporary, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(temporary, self._at(name)):
            self._fs.delete(temporary, False)
            raise FileExistsError(f"{self.home}/{name}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
