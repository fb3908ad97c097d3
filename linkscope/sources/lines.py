"""Lines of text files with their numbers, whatever blocks the files are read in."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def escaped(path: str) -> str:
    """A file's path for readers of text, which take patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def numbered(spark: SparkSession, path: str | list[str], name: str = "source_file", more_ends: str | None = None, ends: str | None = None) -> DataFrame:
    """name (the file), line_no (from 1, long) and value of every line of the files under path.

    Files are read in splits. A split numbers its own lines in the order in which they are read,
    and the counts of the earlier splits of its file are added: one row a split. ends: what ends
    a line instead of line feeds and carriage returns; more_ends: a pattern of what else does.
    """
    reader = spark.read if ends is None else spark.read.option("lineSep", ends)
    # Rows of a split follow one another in its task.
    read = reader.text(path).select(F.col("_metadata.file_path").alias(name), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    parts: Column = F.array("value") if more_ends is None else F.split("value", more_ends)
    read = read.withColumn("parts", parts)
    own = Window.partitionBy(name, "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    local = read.withColumn("earlier", F.coalesce(F.sum(F.size("parts")).over(own), F.lit(0)))
    counts = read.groupBy(name, "block").agg(F.sum(F.size("parts")).alias("n"))
    before = counts.select(name, "block", F.coalesce(F.sum("n").over(Window.partitionBy(name).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    lines = local.join(before, [name, "block"]).select(name, (F.col("before") + F.col("earlier")).alias("first"), F.posexplode("parts").alias("i", "value"))
    return lines.select(name, (F.col("first") + F.col("i") + 1).alias("line_no"), "value")
