"""Lines of text files with their numbers, without gathering a file anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: monotonically_increasing_id counts within a partition in its low bits.
_LOW = 1 << 33


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of every line, `line` from 0 within its file; gzip is read, but as one split.

    Partitions count their lines first; their running sums, one row per file and partition, give each line its number.
    """
    text = spark.read.text(path)
    lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    counts = lines.groupBy("file", "part").agg(F.min("at").alias("least"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("shift"))
    # A row per piece of a file: sent to the lines, which stay where they are.
    return lines.join(F.broadcast(starts), ["file", "part"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value")
