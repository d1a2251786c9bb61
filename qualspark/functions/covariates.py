"""Covariates of bases: machine cycle and dinucleotide context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .phred import LEAST_Q

#: Order of bases in dinucleotide codes 0..15: AA, AT, AG, AC, TA, ... CC.
BASES = "ATGC"


def letter(raw: str, at: Column) -> Column:
    """Letter `at`, from 0, of a column of ASCII bytes, found without walking along it."""
    return F.substring(F.col(raw), at + 1, F.lit(1)).cast("string")


def _number(base: Column) -> Column:
    """1 to 4 for a letter of BASES, else 0."""
    return F.when(F.length(base) == 1, F.position(base, F.lit(BASES))).otherwise(0)


def cycle(pos: Column, second: Column) -> Column:
    """0, 1, ... along a first read; -1, -2, ... along a second."""
    return F.when(second, -(pos + 1)).otherwise(pos)


def strand_cycle(pos: Column, length: Column, reverse: Column, second: Column) -> Column:
    """Cycle of a base of an aligned read: counted from the far end on the reverse strand."""
    return cycle(F.when(reverse, length - 1 - pos).otherwise(pos), second)


def clipped_cycle(pos: Column, start: Column, end: Column, reverse: Column, second: Column) -> Column:
    """Cycle within the aligned part [start, end) of a read; 0 in soft clips."""
    return F.when((pos < start) | (pos >= end), 0).otherwise(strand_cycle(pos - start, end - start, reverse, second))


def dinucleotide(previous: Column, base: Column, q: Column, least: int = LEAST_Q) -> Column:
    """Code of (previous, base); -1 for a first base, for letters outside ATGC, or if the base's own quality is low."""
    code = 4 * (_number(previous) - 1) + _number(base) - 1
    known = previous.isNotNull() & (_number(previous) > 0) & (_number(base) > 0) & (q >= least)
    return F.when(known, code).otherwise(-1)


def complement(base: Column) -> Column:
    return F.translate(base, "ATGC", "TACG")
