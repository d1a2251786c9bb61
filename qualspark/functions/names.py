"""What read names carry: pair suffixes and read groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def second_in_pair(name: Column) -> Column:
    """Whether the part before the first underscore ends in /2."""
    return F.split_part(name, F.lit("_"), F.lit(1)).endswith("/2")


def read_group_field(name: Column) -> Column:
    """Read group from the second underscore field, which must start with RG; what follows its last colon."""
    field = F.split_part(name, F.lit("_"), F.lit(2))
    return F.when(field.startswith("RG"), F.substring_index(field, ":", -1)).otherwise(F.raise_error(F.concat(F.lit("no read group in the name "), name)))


def read_group_anywhere(name: Column, delimiter: str = "_") -> Column:
    """Read group from the last field that starts with RG:, wherever it stands; null if there is none."""
    fields = F.filter(F.split(name, delimiter), lambda f: f.startswith("RG:"))
    return F.substring_index(F.try_element_at(fields, F.lit(-1)), ":", -1)


def bare_name(name: Column, delimiter: str = "_") -> Column:
    """First field without its pair suffix."""
    return F.regexp_replace(F.element_at(F.split(name, delimiter), 1), "/[12]$", "")


def canonical_name(name: Column, second: Column) -> Column:
    """Name with its pair suffix."""
    return F.concat(name, F.when(second, "/2").otherwise("/1"))


def fastq_key(name: Column) -> Column:
    """First underscore field, suffix kept: what canonical names are compared with."""
    return F.split_part(name, F.lit("_"), F.lit(1))


def reverse_complement(seq: Column) -> Column:
    """Reverse complement over A, T, G, C; other letters stay."""
    return F.reverse(F.translate(seq, "ATGC", "TACG"))
