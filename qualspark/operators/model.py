"""Error counts by covariate, and the hierarchical model of quality shifts made from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.covariates import BASES
from ..functions.phred import LEAST_Q, MOST_Q, expected_errors, mean_q, posterior_q, q_char
from ..jobs.tables import materialize
from .bases import checked_quality
from .read_arrays import CONTEXTS, count_reads, renew

#: Bytes of a model's arrays that are sent to all tasks.
BROADCAST_BYTES = 256_000_000


def finest_counts(bases: DataFrame) -> DataFrame:
    """errors and total by (rg, q, cycle, dinuc) over bases that are not skipped: one shuffle feeds all levels.

    bases: rg, q, cycle, dinuc, error, skip. Sums are made before the shuffle, so a read group that holds most bases
    costs no more than its cells. A counted quality above the model's range fails.
    """
    return bases.where(~F.col("skip")).groupBy("rg", checked_quality(F.col("q")).alias("q"), "cycle", "dinuc").agg(F.sum(F.col("error").cast("long")).alias("errors"), F.count("*").alias("total"))


def level_counts(finest: DataFrame, *keys: str) -> DataFrame:
    """errors and total by fewer keys; by dinucleotide, only bases that have one count."""
    rows = finest.where("dinuc >= 0") if "dinuc" in keys else finest
    return rows.groupBy(*keys).agg(F.sum("errors").alias("errors"), F.sum("total").alias("total"))


def grouping_set_counts(bases: DataFrame) -> DataFrame:
    """All four levels in one statement: level, rg, q, cycle, dinuc, errors, total; keys of other levels are null.

    Only the finest counts are spread over the levels, not bases.
    """
    return grouping_sets(finest_counts(bases))


def grouping_sets(finest: DataFrame) -> DataFrame:
    """grouping_set_counts from finest counts."""
    sets = finest.groupingSets([["rg"], ["rg", "q"], ["rg", "q", "cycle"], ["rg", "q", "dinuc"]], "rg", "q", "cycle", "dinuc")
    counted = sets.agg(F.grouping_id().alias("g"), F.sum("errors").alias("errors"), F.sum("total").alias("total"))
    level = F.when(F.col("g") == 7, "rg").when(F.col("g") == 3, "q").when(F.col("g") == 1, "cycle").otherwise("dinuc")
    return counted.select(level.alias("level"), "rg", "q", "cycle", "dinuc", "errors", "total").where("level <> 'dinuc' or dinuc >= 0")


def mean_qualities(by_q: DataFrame) -> DataFrame:
    """(rg, mean_q) from counts by (rg, q): the quality of the mean expected error, cut toward zero without rounding."""
    high, low = expected_errors(F.col("q"), F.col("total"))
    sums = by_q.groupBy("rg").agg(F.sum(high).alias("high"), F.sum(low).alias("low"), F.sum(F.col("total").cast("decimal(19,0)")).alias("n"))
    return sums.select("rg", mean_q(F.col("high"), F.col("low"), F.col("n")).alias("mean_q"))


@dataclass
class Model:
    """Small tables: rg (rg, mean_q, delta), q (rg, q, prior, delta), cycle and dinuc (rg, q, key, prior, delta)."""

    rg: DataFrame
    q: DataFrame
    cycle: DataFrame
    dinuc: DataFrame


def fit_model(bases: DataFrame, means: DataFrame | None = None) -> Model:
    """The model of `bases`: each level's prior is its parent's posterior quality.

    A cell that was never seen shifts nothing, and a read group whose bases are all skipped has no row.
    """
    return model_of_finest(finest_counts(bases), means)


def model_of_finest(finest: DataFrame, means: DataFrame | None = None) -> Model:
    """fit_model from finest counts; written out first, they are counted once for all levels."""
    by_q = level_counts(finest, "rg", "q")
    means = mean_qualities(by_q) if means is None else means
    by_rg = level_counts(by_q, "rg")
    rg = by_rg.join(means, by_rg["rg"].eqNullSafe(means["rg"])).select(by_rg["rg"], "mean_q", "errors", "total")
    return model_of_counts(rg, by_q, level_counts(finest, "rg", "q", "cycle"), level_counts(finest, "rg", "q", "dinuc"))


def model_of_counts(by_rg: DataFrame, by_q: DataFrame, by_cycle: DataFrame, by_dinuc: DataFrame) -> Model:
    """The model of counts at its four levels, from bases or read from a report.

    by_rg: rg, mean_q (whole, or a fraction as reports have it), errors, total; the others: rg, q, key, errors, total.
    """
    post = lambda prior: posterior_q(F.col(prior), F.col("errors"), F.col("total"))
    rg = by_rg.select("rg", "mean_q", "errors", "total", post("mean_q").alias("post")).withColumn("delta", F.col("post") - F.col("mean_q"))
    parent = rg.select(F.col("rg").alias("_rg"), F.col("post").alias("prior"))
    q = by_q.join(parent, F.col("rg").eqNullSafe(F.col("_rg"))).select("rg", "q", "errors", "total", "prior", post("prior").alias("post")).withColumn("delta", F.col("post") - F.col("prior"))
    parent = q.select(F.col("rg").alias("_rg"), F.col("q").alias("_q"), F.col("post").alias("prior"))

    def cells(counts: DataFrame, key: str) -> DataFrame:
        joined = counts.join(parent, F.col("rg").eqNullSafe(F.col("_rg")) & (F.col("q") == F.col("_q")))
        return joined.select("rg", "q", key, "errors", "total", "prior", (post("prior") - F.col("prior")).alias("delta"))

    return Model(rg, q, cells(by_cycle, "cycle"), cells(by_dinuc, "dinuc"))


def _laid_out(cells: Column, n: Column) -> Column:
    """Cells (at, d), sorted, as an array of n numbers in which d stands at place `at`, with zeros elsewhere."""

    def place(x: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get(cells, k - 1)["at"]).otherwise(-1)
        return F.concat(F.array_repeat(F.lit(0.0), x["at"] - before - 1), F.array(x["d"]))

    last = F.coalesce(F.try_element_at(cells, F.lit(-1))["at"], F.lit(-1))
    return F.concat(F.coalesce(F.flatten(F.transform(cells, place)), F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), n - 1 - last))


def shifts_by_group(model: Model) -> DataFrame:
    """The model as one row per read group: _rg, head, low, span, by_cycle, by_context.

    head[q] is the mean plus the shifts of the group and of quality q; by_cycle holds the shift of a cycle at
    q * span + cycle - low, by_context that of a context at q * 32 + context + 1. Qualities above the model's range share
    the place MOST_Q + 1, which has no shifts of its own. Cells that were never seen shift nothing.
    """
    d, rows = F.col("delta").cast("double").alias("d"), MOST_Q + 2
    rg = model.rg.select(F.col("rg").alias("_rg"), (F.col("mean_q") + F.col("delta")).cast("double").alias("whole"))

    def cells(table: DataFrame, name: str, at: Column, *spread: Column) -> DataFrame:
        found = table.where("delta <> 0").groupBy(F.col("rg").alias("_g")).agg(*spread, F.collect_list(F.struct(at.alias("at"), d)).alias(name))
        return found.select("_g", *found.columns[1:-1], F.array_sort(name).alias(name))

    q = F.col("q")
    parts = (
        cells(model.q, "qs", q),
        cells(model.cycle, "cycles", F.struct("q", "cycle"), F.min("cycle").alias("low"), (F.max("cycle") - F.min("cycle") + 1).alias("span")),
        cells(model.dinuc, "contexts", q * CONTEXTS + F.col("dinuc") + 1),
    )
    for part in parts:
        rg = rg.join(part, F.col("_rg").eqNullSafe(F.col("_g")), "left").drop("_g")
    low, span = F.coalesce("low", F.lit(0)).alias("low"), F.coalesce("span", F.lit(1)).alias("span")
    # Sorted by quality and cycle, cells are sorted by place, too.
    placed = F.transform("cycles", lambda x: F.struct((x["at"]["q"] * F.col("span") + x["at"]["cycle"] - F.col("low")).alias("at"), x["d"].alias("d")))
    held = rg.select("_rg", "whole", low, span, "qs", placed.alias("cycles"), "contexts")
    by_q = F.transform(_laid_out(F.col("qs"), F.lit(rows)), lambda x: F.col("whole") + x)
    return held.select("_rg", "low", "span", by_q.alias("head"), _laid_out(F.col("cycles"), rows * F.col("span")).alias("by_cycle"), _laid_out(F.col("contexts"), F.lit(rows * CONTEXTS)).alias("by_context"))


def new_qualities(reads: DataFrame, model: Model, least: int = LEAST_Q) -> DataFrame:
    """(rec, qual): the mean plus all shifts for each base, cut toward zero; qualities below `least` stay.

    Shifts may add up to less than 0 (see LEAST_LETTER); such a quality keeps its own letter, one below that of 0.
    reads: rec, rg, second, seq, qual, in sequencing direction; null and empty sequences are left out. Everything happens
    within the row, so nothing but the model is moved. A model whose arrays are small is sent to all tasks, which renew
    whole batches; a larger one (very many read groups, or very long reads) meets the reads in a join by read group, whose
    hot groups are split as it runs, and positions are walked by array functions.
    """
    shifts = materialize(shifts_by_group(model), "model-shifts")
    whole = reads.where(F.length("seq") > 0).select("rec", "rg", "second", "seq", "qual")
    size = F.sum(F.lit(64) + 8 * (F.size("head") + F.size("by_cycle") + F.size("by_context")))
    if (shifts.agg(size.alias("n")).collect()[0]["n"] or 0) <= BROADCAST_BYTES:
        return renew(whole, shifts.collect(), least)
    return _renew_joined(whole, shifts, least)


def _renew_joined(reads: DataFrame, shifts: DataFrame, least: int) -> DataFrame:
    """(rec, qual) of reads that meet their group's arrays in a join."""
    met = reads.withColumn("seq", F.regexp_replace("seq", f"[^{BASES}]", "N")).join(shifts, F.col("rg").eqNullSafe(F.col("_rg")), "left")
    # Each step of an array is bound to a variable of the next one, as an expression used twice is computed twice a base.
    digits = F.translate("seq", BASES, "0123")
    pair = F.zip_with(F.split(F.concat(F.lit("N"), digits), ""), F.split(digits, ""), lambda p, c: 4 * F.ascii(p) + F.ascii(c))
    none = F.lit(4 * 48 + 48 + 16)  # beyond all pairs of digits
    keys = F.zip_with(F.split("qual", ""), pair, lambda c, x: F.least(F.ascii(c) - 33, F.lit(MOST_Q + 1)) * CONTEXTS + F.when(x < none, x - 239).otherwise(0))
    quality = lambda key: F.shiftright(key, 5)
    sign = F.when(F.col("second"), -1).otherwise(1)
    from_low = F.when(F.col("second"), -1 - F.col("low")).otherwise(-F.col("low"))

    def renewed(by_cycle) -> Column:
        def one(key: Column, k: Column) -> Column:
            total = F.get("head", quality(key)) + by_cycle(key, from_low + sign * k) + F.get("by_context", key)
            return F.when(key >= least * CONTEXTS, total.cast("int")).otherwise(quality(key))

        return F.transform(F.slice(keys, F.lit(1), F.length("seq")), one)

    inside = lambda key, at: F.get("by_cycle", quality(key) * F.col("span") + at)
    anywhere = lambda key, at: F.when(at.between(0, F.col("span") - 1), inside(key, at)).otherwise(0.0)
    ends = (from_low, from_low + sign * (F.length("seq") - 1))
    covered = (F.least(*ends) >= 0) & (F.greatest(*ends) < F.col("span"))
    found = F.when(covered, renewed(inside)).otherwise(renewed(anywhere))
    written = F.transform(found, lambda q: q_char(q))
    return met.select("rec", F.array_join(written, "").alias("qual"))


def recalibrate_reads(reads: DataFrame, model: Model | None = None) -> DataFrame:
    """(rec, qual): reads with a column `corrected` recalibrated by `model`, or by the model of the reads themselves."""
    return new_qualities(reads, model or model_of_finest(materialize(count_reads(reads), "finest-counts")))
