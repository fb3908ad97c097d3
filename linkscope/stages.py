"""Intermediate tables in the folder that driver and executors share.

A table that several branches of a plan read is written once; it cuts the lineage and outlives
lost executors. Stage counts who still needs a table and deletes it with the last of them.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder in local mode where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="linkscope-")
    return _OWN[app]


class Stage:
    """Tables of one analysis. keep() writes one; release() says that one reader less needs it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[list] = []  # frame, path, readers

    def keep(self, df: DataFrame, name: str, readers: int = 1) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append([kept, path, readers])
        return kept

    def release(self, *frames: DataFrame) -> None:
        for entry in [t for t in self.tables if any(t[0] is f for f in frames)]:
            entry[2] -= 1
            if entry[2] <= 0:
                self._delete(entry[1])
                self.tables.remove(entry)

    def close(self) -> None:
        """Delete all that is left; frames made of these tables must have been read by then."""
        self.tables.clear()
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self) -> Stage:
        return self

    def __exit__(self, *_) -> None:
        self.close()
