"""Aligned reads as a whole: their counts, their report, the model of a report, and their new qualities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import reverse_complement
from .align import adaptor_boundary, flag_reads, reference_span
from .calibration import selected_quality
from .cigar import with_trim
from .model import Model, model_of_counts, new_qualities
from .read_arrays import count_aligned
from .report import counts_from_report, report_tables


def aligned_part(cigar: Column, length: Column) -> tuple[Column, Column]:
    """(start, end) of a read's bases without its soft clips."""
    clip = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(cigar, pattern, 1), F.lit("")).cast("int"), F.lit(0))
    return clip("^(?:[0-9]+H)?([0-9]+)S"), length - clip("[^0-9]([0-9]+)S(?:[0-9]+H)?$")


def alignment_reads(alignments: DataFrame, read_groups: DataFrame | None = None, use_original: bool = True) -> DataFrame:
    """What the operators here take, from SAM or BAM rows, in alignment direction.

    rec, rg, second, reverse, seq, qual, chrom, pos, cigar, boundary, aln_start, aln_end. Qualities come from the OQ tag
    where use_original is set. With `read_groups` (rg_id, pu) rg is the platform unit, as reports name groups. Unmapped
    alignments and those without a CIGAR are left out.
    """
    bit = lambda k: F.col("flag").bitwiseAND(k) != 0
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    rows = alignments.where(~bit(4) & (F.col("cigar") != "*")).withColumn("rg", tag("RG"))
    if read_groups is not None:
        rows = rows.join(F.broadcast(read_groups.select(F.col("rg_id").alias("rg"), "pu")), "rg", "left").withColumn("rg", F.col("pu"))  # a header's lines
    start, end = aligned_part(F.col("cigar"), F.length("seq"))
    boundary = adaptor_boundary(F.col("pos"), F.col("pos") + reference_span(F.col("cigar")), F.col("tlen"), F.col("pnext"), bit(1), bit(4), bit(8), bit(16), bit(32))
    return rows.select("rec", "rg", bit(128).alias("second"), bit(16).alias("reverse"), "seq", selected_quality(use_original, tag("OQ"), F.col("qual")).alias("qual"), F.col("rname").alias("chrom"), "pos", "cigar", boundary.alias("boundary"), start.alias("aln_start"), end.alias("aln_end"))


def aligned_counts(reads: DataFrame, bins: DataFrame) -> DataFrame:
    """Finest counts of aligned reads (see alignment_reads) against a reference and excluded sites (see site_bins).

    Low qualities, N, soft clips, adaptor and excluded sites are skipped; covariates are those of the aligned part. What
    is skipped is found per read, and whole batches of reads are summed to their cells.
    """
    held = reads.select("rec", "rg", "second", "reverse", "seq", "qual", "chrom", "pos", "cigar", "boundary", "aln_start", "aln_end")
    return count_aligned(with_trim(flag_reads(held, bins)))


def alignment_report(reads: DataFrame, bins: DataFrame) -> dict[str, DataFrame]:
    """The report's five tables from aligned reads."""
    return report_tables(aligned_counts(reads, bins))


def model_of_report(tables: dict[str, DataFrame]) -> Model:
    """The model that a report's counts make; mean qualities stay fractions."""
    counts = counts_from_report(tables)
    by_q = (counts[k].withColumn("q", F.col("q").cast("int")) for k in ("q", "cycle", "dinuc"))  # a file's numbers are long
    return model_of_counts(counts["rg"], *by_q)


def recalibrate_alignments(reads: DataFrame, model: Model) -> DataFrame:
    """(rec, qual) of aligned reads by a model, in alignment direction; covariates are those of whole reads, clips and all.

    Reads are turned into sequencing direction, recalibrated there, and turned back.
    """
    back = lambda c: F.when(F.col("reverse"), F.reverse(c)).otherwise(c)
    turned = F.when(F.col("reverse"), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    ahead = reads.select(F.struct("rec", "reverse").alias("rec"), "rg", "second", turned.alias("seq"), back(F.col("qual")).alias("qual"))
    return new_qualities(ahead, model).select("rec.rec", "rec.reverse", "qual").select("rec", back(F.col("qual")).alias("qual"))
