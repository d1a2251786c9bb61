"""Aligned reads against a reference: CIGAR walks, errors, excluded sites, adaptor trimming."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.covariates import clipped_cycle, complement, dinucleotide, letter, strand_cycle
from ..functions.phred import char_q
from ..jobs.tables import materialize
from .cigar import cigar_rows, with_flags, with_trim

#: Positions that share one bin when points meet intervals.
BIN = 1024
_READ, _REF = "MIS=X", "MDN=X"


def variant_sites(vcf: DataFrame) -> DataFrame:
    """Distinct 0-based (chrom, pos) of every position of every record: chrom, pos (1-based), ref, stop (nullable)."""
    end = F.coalesce(F.col("stop"), F.col("pos") - 1 + F.length("ref"))
    spread = vcf.where(end > F.col("pos") - 1).select("chrom", F.explode(F.sequence(F.col("pos") - 1, end - 1)).alias("pos"))
    return spread.select("chrom", F.col("pos").cast("int").alias("pos")).distinct()


def in_intervals(points: DataFrame, bed: DataFrame, flag: str) -> DataFrame:
    """`points` (chrom, pos) with a boolean `flag`: inside any half-open interval of bed (chrom, start, end).

    Intervals are spread over bins and meet the points' bins in an equi-join; overlapping intervals count once.
    """
    spans = bed.where("end > start").select(F.col("chrom").alias("_c"), "start", "end", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN))).alias("_b"))
    sites = points.select(F.col("chrom"), F.col("pos")).distinct()
    hit = sites.join(spans, (F.col("chrom") == F.col("_c")) & (F.floor(F.col("pos") / BIN) == F.col("_b")) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")), "left_semi")
    hit = hit.select(F.col("chrom").alias("_c"), F.col("pos").alias("_p"), F.lit(True).alias(flag))
    return points.join(hit, (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("_p")), "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop("_c", "_p")


def cigar_ops(reads: DataFrame, *keep: str) -> DataFrame:
    """One row per CIGAR operation: rec, keep, k, op, n, read_at, ref_at (offsets before it, from the alignment's start).

    reads: rec, cigar. Reads without a CIGAR give none; a letter outside MIDNSHP=X fails.
    """
    return cigar_rows(reads, *keep)


def aligned_pairs(ops: DataFrame, *keep: str) -> DataFrame:
    """One row per aligned pair in order: rec, keep, k, op, read_pos, ref_off; the side an operation does not use is null."""
    rows = ops.where(F.col("op").isin(*"MIDNS=X") & (F.col("n") > 0)).select("rec", *keep, "k", "op", "read_at", "ref_at", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    on = lambda ops, at: F.when(F.col("op").isin(*ops), F.col(at) + F.col("j"))
    return rows.select("rec", *keep, "k", "op", "j", on(_READ, "read_at").alias("read_pos"), on(_REF, "ref_at").alias("ref_off"))


def variant_spans(vcf: DataFrame) -> DataFrame:
    """Half-open spans (chrom, start, end) of variant records, as variant_sites takes them; they may overlap."""
    end = F.coalesce(F.col("stop"), F.col("pos") - 1 + F.length("ref"))
    return vcf.where(end > F.col("pos") - 1).select("chrom", (F.col("pos") - 1).alias("start"), end.alias("end"))


def _by_bin(spans: DataFrame, kind: str, text: Column) -> DataFrame:
    """Spans (chrom, start, end, and what `text` reads) cut at bin borders: chrom, bin, kind, s, e (within the bin), t."""
    cut = spans.where("end > start").select("*", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN))).alias("bin"))
    at = F.col("bin") * BIN
    s, e = F.greatest(F.col("start") - at, F.lit(0)).cast("int"), F.least(F.col("end") - at, F.lit(BIN)).cast("int")
    return cut.select("chrom", "bin", F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), text.alias("t"))


def _bins_of(regions: bool):
    """Bins from their parts (chrom, bin, kind, s, e, t), those of a bin one after another: chrom, bin, text, mask.

    With `regions`, reference outside parts of kind bed is masked.
    """

    def build(batches):
        import pyarrow as pa

        ones, swapped = b"1" * BIN, bytes.maketrans(b"01", b"10")
        key, text, mask, inside, low, high = None, None, None, None, BIN, 0

        def whole():
            if regions and low < high:
                outside = inside[low:high].translate(swapped)
                mask[low:high] = (np.frombuffer(mask, np.uint8)[low:high] | np.frombuffer(outside, np.uint8)).tobytes()
            return (*key, text.decode(), mask.decode())

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["chrom", "bin", "text", "mask"])

        for batch in batches:
            rows = []
            for chrom, bin_, kind, s, e, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (chrom, bin_):
                    if key is not None:
                        rows.append(whole())
                    key, text, mask, inside, low, high = (chrom, bin_), bytearray(b" " * BIN), bytearray(b"0" * BIN), bytearray(b"0" * BIN), BIN, 0
                if kind == "ref":
                    text[s:e] = t
                    low, high = min(low, s), max(high, e)
                elif kind == "skip":
                    mask[s:e] = ones[s:e]
                else:
                    inside[s:e] = ones[s:e]
            if rows:
                yield pack(rows)
        if key is not None:
            yield pack([whole()])

    return build


def site_bins(chunks: DataFrame, skipped: DataFrame, bed: DataFrame | None = None) -> DataFrame:
    """The reference and its excluded sites, BIN positions a row: chrom, bin, text, mask.

    chunks: chrom, start, seq (ASCII), disjoint and without holes within a contig; skipped: half-open spans (chrom, start,
    end); with bed (chrom, start, end), what it does not cover of the reference is skipped, too. `text` has a space where
    there is no reference, `mask` a 1 at skipped sites and 0 elsewhere. Spans and chunks are cut at bin borders and meet
    in one shuffle, sorted by bin; a task holds one bin at a time, and no site is a row.
    """
    held = chunks.select("chrom", "start", (F.col("start") + F.length("seq")).alias("end"), F.col("seq").cast("binary").alias("raw"))
    bin_start = F.col("bin") * BIN
    piece = F.substring(F.col("raw"), (F.greatest(bin_start - F.col("start"), F.lit(0)) + 1).cast("int"), (F.least(F.col("end"), bin_start + BIN) - F.greatest(F.col("start"), bin_start)).cast("int"))
    none = F.lit(None).cast("binary")
    rows = _by_bin(held, "ref", piece).unionByName(_by_bin(skipped.select("chrom", "start", "end"), "skip", none))
    if bed is not None:
        rows = rows.unionByName(_by_bin(bed.select("chrom", "start", "end"), "bed", none))
    return rows.repartition("chrom", "bin").sortWithinPartitions("chrom", "bin").mapInArrow(_bins_of(bed is not None), "chrom string, bin long, text string, mask string")


def skipped_counts(bins: DataFrame) -> DataFrame:
    """(chrom, n_skipped) of contigs with skipped sites."""
    return bins.groupBy("chrom").agg(F.sum(F.length(F.replace("mask", F.lit("0"), F.lit("")))).alias("n_skipped")).where("n_skipped > 0")


def reference_span(cigar: Column) -> Column:
    """How many reference positions an alignment covers."""
    moves = F.regexp_extract_all(cigar, F.lit("([0-9]+)[MDN=X]"), F.lit(1))
    return F.aggregate(moves, F.lit(0), lambda s, x: s + x.cast("int"))


def with_windows(reads: DataFrame, bins: DataFrame) -> DataFrame:
    """Reads with _ref and _mask: letters of the sites from one before the alignment to one behind it.

    reads: rec, chrom, pos, cigar and more. Most reads touch one bin, meet it and are done. One that touches several meets
    each of them; its own columns go to the first only, and its parts come together in one exchange by rec. So reads are
    made twice, but only those that a bin's border cuts are moved twice.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in reads.columns))
    placed = reads.where("cigar is not null and cigar <> '*'").select("rec", "chrom", whole.alias("_row"), (F.col("pos") - 1).alias("first"), (F.col("pos") + reference_span(F.col("cigar"))).alias("last"))
    bin_of = lambda c: F.floor(F.col(c) / BIN)
    binary = lambda c: F.col(c).cast("binary").alias(c)
    # Written out, so that both joins read the same bins.
    bins = materialize(bins.select("chrom", "bin", binary("text"), binary("mask")), "site-bins")
    part = lambda c, fill: F.coalesce(F.substring(F.col(c), F.col("low") + 1, F.col("n")).cast("string"), F.repeat(F.lit(fill), F.col("n")))

    near = placed.where(bin_of("first") == bin_of("last")).select("chrom", "_row", bin_of("first").alias("bin"), F.pmod("first", F.lit(BIN)).cast("int").alias("low"), (F.col("last") + 1 - F.col("first")).cast("int").alias("n"))
    near = near.join(bins, ["chrom", "bin"], "left").select("_row.*", part("text", " ").alias("_ref"), part("mask", "0").alias("_mask"))

    far = placed.where(bin_of("first") < bin_of("last"))
    touched = far.select("rec", "chrom", "first", "last", "_row", F.explode(F.sequence(bin_of("first"), bin_of("last"))).alias("bin"))
    low = F.greatest(F.col("first") - F.col("bin") * BIN, F.lit(0)).cast("int")
    n = (F.least(F.col("last") + 1 - F.col("bin") * BIN, F.lit(BIN)) - low).cast("int")
    held = touched.select("rec", "chrom", "bin", low.alias("low"), n.alias("n"), F.when(F.col("bin") == bin_of("first"), F.col("_row")).alias("_row"))
    parts = held.join(bins, ["chrom", "bin"], "left").select("rec", "_row", F.struct("bin", part("text", " ").alias("text"), part("mask", "0").alias("mask")).alias("x"))
    joined = lambda c: F.array_join(F.transform("xs", lambda x: x[c]), "")
    far = parts.groupBy("rec").agg(F.first("_row", ignorenulls=True).alias("_row"), F.array_sort(F.collect_list("x")).alias("xs")).select("_row.*", joined("text").alias("_ref"), joined("mask").alias("_mask"))
    return near.unionByName(far)


def flag_reads(reads: DataFrame, bins: DataFrame) -> DataFrame:
    """Reads with ref and skip, a letter per base: the reference base it is aligned to (a space for none), and 1 if it is skipped.

    reads: rec, chrom, pos (0-based), cigar and more; bins: see site_bins. See `cigar.flags` for the rules.
    """
    return with_flags(with_windows(reads, bins))


def read_flags(reads: DataFrame, bins: DataFrame) -> DataFrame:
    """(rec, ref, skip) of flag_reads."""
    return flag_reads(reads.select("rec", "chrom", "pos", "cigar"), bins).select("rec", "ref", "skip")


def flagged_bases(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per base of reads with flags (rec, seq, ref, skip): rec, keep, read_pos, error, skip.

    A base is an error if it differs from a reference base; sites beyond the reference and indels are none.
    """
    raw = lambda c: F.col(c).cast("binary").alias(f"_{c}")
    held = rows.where(F.length("skip") > 0).select("rec", *keep, raw("seq"), raw("ref"), raw("skip"), F.explode(F.sequence(F.lit(0), F.length("skip") - 1)).alias("read_pos"))
    on = lambda c: F.substring(F.col(c), F.col("read_pos") + 1, F.lit(1))
    return held.select("rec", *keep, "read_pos", ((on("_ref") != F.lit(b" ")) & (on("_ref") != on("_seq"))).alias("error"), (on("_skip") == F.lit(b"1")).alias("skip"))


def read_errors(reads: DataFrame, bins: DataFrame) -> DataFrame:
    """Errors and skips along aligned reads: rec, read_pos, error, skip. reads: rec, chrom, pos (0-based), cigar, seq."""
    return flagged_bases(flag_reads(reads.select("rec", "chrom", "pos", "cigar", "seq"), bins))


def adaptor_boundary(start: Column, end: Column, tlen: Column, mate_start: Column, paired: Column, unmapped: Column, mate_unmapped: Column, reverse: Column, mate_reverse: Column) -> Column:
    """Where adaptor sequence would begin on the reference; null where mates give no such place. `end` is exclusive."""
    none = (tlen == 0) | ~paired | unmapped | mate_unmapped | (reverse == mate_reverse)
    behind = F.when(reverse & (end - 1 > mate_start), mate_start - 1)
    ahead = F.when(~reverse & (start <= mate_start + tlen), start + F.abs(tlen))
    return F.when(~none, F.coalesce(behind, ahead))


def trim_bounds(reads: DataFrame) -> DataFrame:
    """Bases that lie in adaptor, as (rec, gone_from, gone_to), half-open. reads: rec, pos, cigar, reverse, boundary (nullable).

    See `cigar.trimmed_part` for the rules.
    """
    return with_trim(reads.select("rec", "pos", "cigar", "reverse", "boundary")).where("gone_from is not null").select("rec", "gone_from", "gone_to")


def trimmed(reads: DataFrame) -> DataFrame:
    """The bases within trim_bounds: rec, read_pos."""
    return trim_bounds(reads).select("rec", F.explode(F.sequence("gone_from", F.col("gone_to") - 1)).alias("read_pos"))


def aligned_covariates(reads: DataFrame, *keep: str) -> DataFrame:
    """Bases of aligned reads with covariates in sequencing direction, mapped back to alignment direction.

    reads: rec, rg, second, reverse, seq, qual, aln_start, aln_end (the part without soft clips). Gives rec, rg, keep, pos,
    base, q, cycle and dinuc over the whole read, and clip_cycle and clip_dinuc over the aligned part alone: 0 in soft
    clips, and its first base in sequencing direction has no context, whatever was clipped before it.
    """
    pos, n = F.col("pos"), F.col("n")
    held = reads.where(F.length("seq") > 0).select("rec", "rg", "second", "reverse", "aln_start", "aln_end", *keep, F.length("seq").alias("n"), F.col("seq").cast("binary").alias("_seq"), F.col("qual").cast("binary").alias("_qual"))
    rows = held.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    rows = rows.select("*", letter("_seq", pos).alias("base"), char_q(letter("_qual", pos)).alias("q"), F.when(pos > 0, letter("_seq", pos - 1)).alias("before"), F.when(pos < n - 1, letter("_seq", pos + 1)).alias("after"))
    previous = F.when(F.col("reverse"), complement(F.col("after"))).otherwise(F.col("before"))
    own = F.when(F.col("reverse"), complement(F.col("base"))).otherwise(F.col("base"))
    dinuc = dinucleotide(previous, own, F.col("q"))
    clipped = (pos < F.col("aln_start")) | (pos >= F.col("aln_end"))
    first = pos == F.when(F.col("reverse"), F.col("aln_end") - 1).otherwise(F.col("aln_start"))
    return rows.select(
        "rec",
        "rg",
        *keep,
        "pos",
        "base",
        "q",
        strand_cycle(pos, n, F.col("reverse"), F.col("second")).alias("cycle"),
        dinuc.alias("dinuc"),
        clipped_cycle(pos, F.col("aln_start"), F.col("aln_end"), F.col("reverse"), F.col("second")).alias("clip_cycle"),
        F.when(clipped, 0).when(first, -1).otherwise(dinuc).alias("clip_dinuc"),
    )
