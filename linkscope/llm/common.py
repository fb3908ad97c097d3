"""What the operators of this subpackage share: reading tables, durable intermediate tables, words."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D (a fixed value of the contracts).
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="linkscope-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one call in the shared folder, each of which can be dropped once nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.tables = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((kept, path))
        return kept

    def drop(self, *frames: DataFrame) -> None:
        """Delete the tables of these frames, which keep() returned; others are left alone."""
        for kept, path in [t for t in self.tables if any(t[0] is f for f in frames)]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
            self.tables = [t for t in self.tables if t[1] != path]

    def drop_all_but(self, *frames: DataFrame) -> None:
        self.drop(*[t[0] for t in self.tables if not any(t[0] is f for f in frames)])


def words(text: Column) -> Column:
    """Maximal runs of characters other than white space; no words for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of doc_id as text, modulo 4, is 2. A null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def once(value: Column) -> Column:
    """The value, computed once for each row: a generator of one row, past which Spark moves no expression.

    Without it, filters and projections above would take in the expression itself, and a lambda
    that uses it would compute it anew for each element.
    """
    return F.explode(F.array(value))
