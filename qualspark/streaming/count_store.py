"""Stored counts of reads that keep arriving: weighted increments by batch, merged exactly once.

A store is a folder of Parquet tables, one per batch of a stream, each holding the sums of that batch by (rg, q, cycle,
dinuc). A batch that is run again writes the same table anew, so restarts count nothing twice. Compaction sums all
batches up to a number into a base; whatever the base holds is read from it alone. A table counts once its marker of
success is there, so readers never see half of one. A store belongs to one stream and its checkpoint; stores of several
streams are merged by adding them up.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.read_arrays import count_reads

KEYS = ("rg", "q", "cycle", "dinuc")
SCHEMA = "rg string, q int, cycle int, dinuc int, errors long, total long"


def merge_counts(*tables: DataFrame) -> DataFrame:
    """The sum of several tables of counts, cell by cell."""
    both = functools.reduce(DataFrame.unionByName, (t.select(*KEYS, "errors", "total") for t in tables))
    return both.groupBy(*KEYS).agg(F.sum("errors").alias("errors"), F.sum("total").alias("total"))


def _complete(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Numbers of the store's complete tables, by kind (base, batch)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found: dict[str, list[int]] = {"base": [], "batch": []}
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        kind, _, number = status.getPath().getName().partition("-")
        if kind in found and number.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[kind].append(int(number))
    return found


def stored_counts(spark: SparkSession, path: str, *, upto: int | None = None) -> DataFrame:
    """errors and total by cell of a store: its last base and the batches after it (up to number `upto`, if given)."""
    found = _complete(spark, path)
    base = max((n for n in found["base"] if upto is None or n <= upto), default=-1)
    later = sorted(n for n in found["batch"] if n > base and (upto is None or n <= upto))
    tables = [f"{path}/base-{base}"] * (base >= 0) + [f"{path}/batch-{n}" for n in later]
    if not tables:
        return spark.createDataFrame([], SCHEMA)
    return merge_counts(spark.read.schema(SCHEMA).parquet(*tables))


def write_increments(reads: DataFrame, path: str, checkpoint: str, *, weight: str | None = None) -> StreamingQuery:
    """Add the reads of a stream to the store at `path`; see count_reads for their columns and weights."""

    def save(batch: DataFrame, number: int) -> None:
        if number <= max(_complete(batch.sparkSession, path)["base"], default=-1):
            return  # run again after a compaction that holds it
        count_reads(batch, weight=weight).write.mode("overwrite").parquet(f"{path}/batch-{number}")

    return reads.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()


def compact(spark: SparkSession, path: str) -> int:
    """Sum the store's batches into a base and return the last batch it holds, -1 if there is none.

    Older tables stay, as readers may be at them; no later reader opens them.
    """
    found = _complete(spark, path)
    last = max(found["batch"] + found["base"], default=-1)
    if last >= 0 and last not in found["base"]:
        stored_counts(spark, path, upto=last).write.mode("overwrite").parquet(f"{path}/base-{last}")
    return last
