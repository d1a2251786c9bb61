"""From reads to one row per base, with covariates, errors and skips; and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.covariates import cycle, dinucleotide, letter
from ..functions.phred import LEAST_Q, MOST_Q, char_q, q_char


def explode_bases(reads: DataFrame, *keep: str) -> DataFrame:
    """One row per base: rec, rg, second, pos, base, prev, q, cycle, dinuc, and `keep` (columns of reads).

    reads: rec long, rg string (null is a group), second boolean, seq string, qual string (Phred+33), as long as seq.
    Reads of any length, in ASCII; an empty or null sequence gives no rows.
    """
    pos = F.col("pos")
    held = reads.where(F.length("seq") > 0).select("rec", "rg", "second", *keep, F.col("seq").cast("binary").alias("_seq"), F.col("qual").cast("binary").alias("_qual"))
    rows = held.select("*", F.explode(F.sequence(F.lit(0), F.length("_seq") - 1)).alias("pos"))
    rows = rows.select("rec", "rg", "second", *keep, "pos", letter("_seq", pos).alias("base"), F.when(pos > 0, letter("_seq", pos - 1)).alias("prev"), char_q(letter("_qual", pos)).alias("q"))
    return rows.select("*", cycle(pos, F.col("second")).alias("cycle"), dinucleotide(F.col("prev"), F.col("base"), F.col("q")).alias("dinuc"))


def with_corrections(reads: DataFrame, corrected: DataFrame) -> DataFrame:
    """Reads with `corrected`, the sequence of the same record in the corrected file; records of both files only.

    Both: rec, name, seq. A corrected name that does not begin with the read's name fails.
    """
    other = corrected.select("rec", F.col("name").alias("_name"), F.col("seq").alias("corrected"))
    joined = reads.join(other, "rec")
    same = F.when(F.col("_name").startswith(F.col("name")), F.col("corrected")).otherwise(F.raise_error(F.concat(F.lit("corrected read does not follow its read: "), F.col("name"))))
    return joined.withColumn("corrected", same).drop("_name")


def corrected_bases(reads: DataFrame) -> DataFrame:
    """Bases of reads with a column `corrected`: also error (the corrected base differs) and skip (q below LEAST_Q)."""
    rows = explode_bases(reads.withColumn("corrected", F.col("corrected").cast("binary")), "corrected")
    changed = letter("corrected", F.col("pos")) != F.col("base")
    return rows.withColumn("error", changed).withColumn("skip", F.col("q") < LEAST_Q).drop("corrected")


def checked_quality(q: Column) -> Column:
    """The quality, which a model can hold only up to MOST_Q."""
    return F.when(q <= MOST_Q, q).otherwise(F.raise_error(F.concat(F.lit("quality above the model's range: "), q.cast("string"))))


def assemble(bases: DataFrame, q: str = "q") -> DataFrame:
    """(rec, qual) from base rows; without an exchange where they are already spread by rec."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", q_char(F.col(q)).alias("c"))))
    return bases.groupBy("rec").agg(F.array_join(F.transform(pairs, lambda x: x["c"]), "").alias("qual"))
