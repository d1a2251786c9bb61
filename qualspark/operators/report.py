"""Recalibration reports: a model's counts as five tables, and back to counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.phred import posterior_q, q_to_p
from .calibration import quantized
from .model import level_counts

# Fixed values of the Arguments table, as readers of the format expect them.
ARGUMENTS = {
    "binary_tag_name": "null",
    "covariate": "ReadGroupCovariate,QualityScoreCovariate,ContextCovariate,CycleCovariate",
    "default_platform": "null",
    "deletions_default_quality": "45",
    "force_platform": "null",
    "indels_context_size": "3",
    "insertions_default_quality": "45",
    "low_quality_tail": "2",
    "maximum_cycle_value": "500",
    "mismatches_context_size": "2",
    "mismatches_default_quality": "-1",
    "no_standard_covs": "false",
    "quantizing_levels": "16",
    "recalibration_report": "null",
    "run_without_dbsnp": "false",
    "solid_nocall_strategy": "THROW_EXCEPTION",
    "solid_recal_mode": "SET_Q_ZERO",
}
_COUNTED = ("EmpiricalQuality", "Observations", "Errors")


def _empirical(prior) -> F.Column:
    """The posterior itself: the prior plus the shift from it."""
    return posterior_q(prior, F.col("errors"), F.col("total")).cast("double").alias("EmpiricalQuality")


def _observed() -> list:
    return [F.col("total").alias("Observations"), F.col("errors").cast("double").alias("Errors")]


def read_group_table(by_q: DataFrame) -> DataFrame:
    """ReadGroup, EventType, EmpiricalQuality, EstimatedQReported, Observations, Errors from counts by (rg, q)."""
    sums = by_q.groupBy("rg").agg(F.sum("errors").alias("errors"), F.sum("total").alias("total"), F.sum(q_to_p(F.col("q")) * F.col("total")).alias("expected"))
    estimate = F.round(-10 * F.log10(F.col("expected") / F.col("total")), 5)
    rows = sums.withColumn("estimate", estimate)
    shift = posterior_q(F.col("estimate"), F.col("errors"), F.col("total"))
    return rows.select(F.col("rg").alias("ReadGroup"), F.lit("M").alias("EventType"), shift.cast("double").alias("EmpiricalQuality"), F.col("estimate").alias("EstimatedQReported"), *_observed())


def quality_table(by_q: DataFrame) -> DataFrame:
    """ReadGroup, QualityScore, EventType, EmpiricalQuality, Observations, Errors; the prior is the reported quality."""
    return by_q.select(F.col("rg").alias("ReadGroup"), F.col("q").alias("QualityScore"), F.lit("M").alias("EventType"), _empirical(F.col("q")), *_observed())


def covariate_table(by_cycle: DataFrame, by_dinuc: DataFrame) -> DataFrame:
    """Context and Cycle cells in one table: ReadGroup, QualityScore, CovariateValue, CovariateName, EventType, ...

    A first read's cycle i is written as i + 1, a second read's as it is.
    """
    letters = F.array(*map(F.lit, "ATGC"))
    pair = F.concat(F.element_at(letters, F.floor(F.col("dinuc") / 4).cast("int") + 1), F.element_at(letters, F.col("dinuc") % 4 + 1))
    signed = F.when(F.col("cycle") >= 0, F.col("cycle") + 1).otherwise(F.col("cycle")).cast("string")

    def part(cells: DataFrame, value, name: str) -> DataFrame:
        return cells.select(F.col("rg").alias("ReadGroup"), F.col("q").alias("QualityScore"), value.alias("CovariateValue"), F.lit(name).alias("CovariateName"), F.lit("M").alias("EventType"), _empirical(F.col("q")), *_observed())

    return part(by_dinuc, pair, "Context").unionByName(part(by_cycle, signed, "Cycle"))


def report_tables(finest: DataFrame) -> dict[str, DataFrame]:
    """The five tables, by title, of counts by (rg, q, cycle, dinuc); ordered as they are written."""
    spark = finest.sparkSession
    by_q = level_counts(finest, "rg", "q")
    cells = covariate_table(level_counts(finest, "rg", "q", "cycle"), level_counts(finest, "rg", "q", "dinuc"))
    scores = quantized(by_q).select(F.col("quality_score").alias("QualityScore"), F.col("count").alias("Count"), F.col("quantized_score").alias("QuantizedScore"))
    return {
        "Arguments": spark.createDataFrame(list(ARGUMENTS.items()), "Argument string, Value string"),
        "Quantized": scores.orderBy("QualityScore"),
        "RecalTable0": read_group_table(by_q).orderBy("ReadGroup"),
        "RecalTable1": quality_table(by_q).orderBy("ReadGroup", "QualityScore"),
        "RecalTable2": cells.orderBy("ReadGroup", "QualityScore", "CovariateValue", "CovariateName"),
    }


def counts_from_report(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Counts by level from report tables: rg (rg, mean_q, errors, total), q, cycle, dinuc. Mean qualities stay fractions."""
    counted = [F.col("Errors").cast("long").alias("errors"), F.col("Observations").alias("total")]
    cells = tables["RecalTable2"]
    value = F.col("CovariateValue")
    letter = lambda k: F.position(F.substring(value, k, 1), F.lit("ATGC")) - 1
    code = 4 * letter(1) + letter(2)
    cycle = F.when(value.try_cast("int") > 0, value.try_cast("int") - 1).otherwise(value.try_cast("int"))
    keys = [F.col("ReadGroup").alias("rg"), F.col("QualityScore").alias("q")]
    return {
        "rg": tables["RecalTable0"].select(F.col("ReadGroup").alias("rg"), F.col("EstimatedQReported").alias("mean_q"), *counted),
        "q": tables["RecalTable1"].select(*keys, *counted),
        "cycle": cells.where("CovariateName = 'Cycle'").select(*keys, cycle.alias("cycle"), *counted),
        "dinuc": cells.where("CovariateName = 'Context'").select(*keys, code.alias("dinuc"), *counted),
    }


def longest_cycle(cells: DataFrame) -> DataFrame:
    """One row, n: how many cycles the longest read has; null without cells."""
    return cells.agg(F.max(F.when(F.col("cycle") >= 0, F.col("cycle") + 1).otherwise(-F.col("cycle"))).alias("n"))


def dense_cells(cells: DataFrame, key: str) -> DataFrame:
    """Counts over the whole domain rg x quality x key of a report, with zeros where nothing was seen.

    A table by read group, quality and cycle is small, and each side of the product holds one column of it.
    """
    groups, spark = cells.select("rg").distinct(), cells.sparkSession
    if key == "dinuc":
        domain = spark.range(16).select(F.col("id").cast("int").alias(key))
    else:
        longest = longest_cycle(cells).where("n is not null")
        domain = longest.select(F.explode(F.expr("sequence(-n, n - 1)")).alias(key))
    every = groups.crossJoin(spark.range(43).select(F.col("id").cast("int").alias("q"))).crossJoin(domain)
    return every.join(cells, ["rg", "q", key], "left").select("rg", "q", key, F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("total", F.lit(0)).alias("total"))
