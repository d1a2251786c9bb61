"""Recalibration by logistic regression of errors on reported quality."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phred import p_to_q
from ..jobs.tables import materialize


def regression_qualities(by_q: DataFrame, strength: float = 1.0) -> DataFrame:
    """(q, new_q): the quality of the error rate that a logistic curve over q gives, fitted on weighted counts by q.

    by_q: q, errors, total. `strength` is the inverse of the ridge penalty, as for a sum of losses over all bases.
    """
    # A row per quality, written out, as every step of the fit reads it.
    counts = materialize(by_q.groupBy("q").agg(F.sum("errors").alias("e"), F.sum("total").alias("n")), "regression-counts")
    split = counts.select("q", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("e").cast("double").alias("w")), F.struct(F.lit(0.0).alias("label"), (F.col("n") - F.col("e")).cast("double").alias("w")))).alias("x")).select("q", "x.*").where("w > 0")
    points = VectorAssembler(inputCols=["q"], outputCol="features").transform(split)
    total = split.agg(F.sum("w")).collect()[0][0] or 1.0
    model = LogisticRegression(weightCol="w", regParam=1.0 / (strength * total), standardization=False).fit(points)
    every = VectorAssembler(inputCols=["q"], outputCol="features").transform(counts.select("q"))
    return model.transform(every).select("q", p_to_q(vector_to_array("probability")[1]).alias("new_q"))


def isotonic_qualities(by_q: DataFrame) -> DataFrame:
    """(rg, q, new_q): the quality of the error rate that best fits the counts among rates that never rise with q.

    by_q: rg, q, errors, total. The weighted least squares fit at q is the least, over stretches that begin at or below q,
    of the highest mean rate of a stretch from there to q or beyond. A read group has as many stretches as pairs of its
    qualities. Qualities without counts are left out; a null group is one.
    """
    counts = by_q.groupBy("rg", "q").agg(F.sum("errors").alias("e"), F.sum("total").alias("n")).where("n > 0")
    up_to = Window.partitionBy("rg").orderBy("q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = counts.select("rg", "q", "e", "n", F.sum("e").over(up_to).alias("se"), F.sum("n").over(up_to).alias("sn"))
    first = sums.select(F.col("rg").alias("_rg"), F.col("q").alias("a"), (F.col("se") - F.col("e")).alias("before_e"), (F.col("sn") - F.col("n")).alias("before_n"))
    stretches = sums.join(first, F.col("rg").eqNullSafe(F.col("_rg")) & (F.col("a") <= F.col("q")))
    mean = (F.col("se") - F.col("before_e")) / (F.col("sn") - F.col("before_n"))
    onward = Window.partitionBy("rg", "a").orderBy(F.desc("q")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    highest = stretches.select("rg", "a", "q", F.max(mean).over(onward).alias("rate"))
    return highest.groupBy("rg", "q").agg(F.min("rate").alias("rate")).select("rg", "q", p_to_q(F.col("rate")).alias("new_q"))
