"""Folders of stored tables, through Hadoop's file systems: whatever Spark can write to."""

from __future__ import annotations

import json
import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Only where that is unset and all runs in one process a local one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def released(df: DataFrame, release: Callable[[], None]) -> DataFrame:
    """df, a lazy result; what it reads is released when nothing holds df any more."""
    weakref.finalize(df, release).atexit = False
    return df


class Folder:
    """Small files and listings of one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def names(self, name: str = "") -> list[str]:
        """What is in a folder; nothing if it isn't there."""
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def put(self, name: str, value) -> None:
        """Writes JSON under a name. It is written aside and renamed, so a reader sees all of it or nothing."""
        aside = self._at(f".{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        self._fs.mkdirs(self._at(name).getParent())
        if not self._fs.rename(aside, self._at(name)):
            raise OSError(f"{self.path}/{name} can't be written")

    def get(self, name: str):
        rows = self.spark.read.option("wholetext", True).text(f"{self.path}/{name}").collect()  # one small file
        return json.loads(rows[0]["value"])

    def remove(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)
