"""Covariate counts of reads that keep arriving: the finest counts are sums, so batches just add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.bases import corrected_bases


def stream_counts(reads: DataFrame) -> DataFrame:
    """Streaming counts by (rg, q) of reads with a column `corrected`; the state holds one row per cell."""
    bases = corrected_bases(reads).where(~F.col("skip"))
    return bases.groupBy("rg", "q").agg(F.sum(F.col("error").cast("long")).alias("errors"), F.count("*").alias("total"))


def write_counts(reads: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep `path` at the latest counts; each batch writes a whole version of the small table, so reruns agree."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream_counts(reads).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()


def latest_counts(spark, path: str) -> DataFrame:
    """The last version that write_counts has left."""
    versions = spark.read.option("basePath", path).parquet(path)
    last = versions.agg(F.max("version").alias("v"))
    return versions.join(F.broadcast(last), F.col("version") == F.col("v")).drop("version", "v")  # one row
