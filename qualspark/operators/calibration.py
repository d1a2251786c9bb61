"""Calibration: how well reported qualities predict the errors that are seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.phred import p_to_q


def calibration_table(bases: DataFrame, label: str) -> DataFrame:
    """predicted_q, actual_q, label, n_bases of bases (q, error, skip) that are not skipped; qualities seen only."""
    counts = bases.where(~F.col("skip")).groupBy("q").agg(F.count("*").alias("total"), F.sum(F.col("error").cast("long")).alias("errors"))
    return calibration_of_counts(counts, label)


def calibration_of_counts(counts: DataFrame, label: str) -> DataFrame:
    """calibration_table from counts by quality: q, errors, total."""
    return counts.select(F.col("q").alias("predicted_q"), p_to_q(F.col("errors") / F.col("total")).alias("actual_q"), F.lit(label).alias("label"), F.col("total").alias("n_bases"))


def last_of_name(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same `key`, the last in `order`."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("x")).select("x.*")


def quantized(by_q: DataFrame, most: int = 93) -> DataFrame:
    """Rows 0..most: quality_score, count, quantized_score (itself where it was observed, else `most`)."""
    spark = by_q.sparkSession
    totals = by_q.groupBy(F.col("q").alias("quality_score")).agg(F.sum("total").alias("n"))
    every = spark.range(most + 1).select(F.col("id").cast("int").alias("quality_score"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return every.join(totals, "quality_score", "left").select("quality_score", n.alias("count"), F.when(n > 0, F.col("quality_score")).otherwise(most).alias("quantized_score"))


def plot_rows(table: DataFrame, kind: str) -> DataFrame:
    """What a plot draws from calibration tables: label, x, y; kind is calibration or sample-size."""
    if kind not in ("calibration", "sample-size"):
        raise ValueError(f"unknown plot: {kind}")
    return table.select("label", F.col("predicted_q").alias("x"), F.col("actual_q" if kind == "calibration" else "n_bases").cast("long").alias("y"))


def selected_quality(use_original: bool, original: Column, quality: Column) -> Column:
    """The original quality if asked for; a read without one then fails."""
    if not use_original:
        return quality
    return F.when(original.isNotNull(), original).otherwise(F.raise_error(F.lit("read has no original qualities")))
