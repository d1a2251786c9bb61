"""Command line: recalibrate FASTQ pairs or alignments, report on alignments, benchmark them, and print what a plot draws."""

from __future__ import annotations

import argparse
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.covariates import letter
from ..functions.names import fastq_key, read_group_field, second_in_pair
from ..functions.phred import LEAST_LETTER, char_q
from ..operators import align, aligned, bases, calibration, model, report
from ..sources import alignments, fastq, report_file, sites
from ..sources.bam_writer import bam_parts, write_bam
from .tables import materialize


def recalibrate(spark: SparkSession, reads: str, corrected: str, out: str, infer_rg: bool = False) -> None:
    """Recalibrate `reads` by the errors that their corrected copies show; writes FASTQ text under `out`."""
    raw = fastq.read_fastq(spark, reads)
    rg = read_group_field(F.col("name")) if infer_rg else F.lit(None).cast("string")
    named = raw.withColumn("rg", rg).withColumn("second", second_in_pair(F.col("name")))
    joined = bases.with_corrections(named, fastq.read_fastq(spark, corrected))
    finest = materialize(model.finest_counts(bases.corrected_bases(joined)), "finest-counts")
    done = model.recalibrate_reads(joined, model.model_of_finest(finest))
    fastq.write_fastq(joined.drop("qual").join(done, "rec"), out)


def benchmark(spark: SparkSession, sam: str, fasta: str, vcf: str, bed: str | None = None, reads: str | None = None, label: str | None = None, use_original: bool = False) -> DataFrame:
    """Calibration table of aligned reads, or of the reads of a FASTQ file that the alignments know by name."""
    stored = _stored(spark, sam)
    rows = alignments.as_reads(stored, use_original)
    written = rows.withColumn("seq", F.when(F.col("reverse"), F.reverse(F.translate("seq", "ATGC", "TACG"))).otherwise(F.col("seq")))
    bins = _bins(spark, fasta, vcf, bed)
    found = align.flag_reads(written, bins).select("rec", "seq", "ref", "skip")
    if reads is not None:
        # By name, and the last alignment of a name counts; a read that no alignment names fails.
        known = calibration.last_of_name(rows.select("rec", "name", "reverse"), "name", "rec")
        other = fastq.read_fastq(spark, reads).select(fastq_key(F.col("name")).alias("key"), F.col("qual").alias("q_text"))
        joined = other.join(known, F.col("key") == F.col("name"), "left")
        must = F.when(F.col("rec").isNotNull(), F.col("rec")).otherwise(F.raise_error(F.concat(F.lit("no alignment is named "), F.col("key"))))
        quals = joined.select(must.alias("rec"), "reverse", "q_text")
    else:
        quals = rows.select("rec", "reverse", F.col("qual").alias("q_text"))
    written_q = F.when(F.col("reverse"), F.reverse("q_text")).otherwise(F.col("q_text")).cast("binary")
    bases_found = align.flagged_bases(found.join(quals.select("rec", written_q.alias("q_text")), "rec"), "q_text")
    return calibration.calibration_table(bases_found.select(char_q(letter("q_text", F.col("read_pos"))).alias("q"), "error", "skip"), label or reads or sam)


def write_report(spark: SparkSession, sam: str, fasta: str, vcf: str, out: str, bed: str | None = None, use_original: bool = True) -> None:
    """The recalibration report of aligned reads, by platform unit, as text under `out`."""
    reads = aligned.alignment_reads(_stored(spark, sam), _groups(spark, sam), use_original)
    counts = materialize(aligned.aligned_counts(reads, _bins(spark, fasta, vcf, bed)), "finest-counts")
    text = report_file.format_report(report_file.collect_report(report.report_tables(counts)))  # read groups x qualities x cycles
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.text(_uri(out))


def recalibrate_alignments(spark: SparkSession, sam: str, report_path: str, out: str, use_original: bool = True, set_original: bool = False) -> None:
    """Alignments with new qualities by a report, as BAM files under `out`, in the order of the input.

    Unmapped alignments, those without a CIGAR and those of groups that the report does not name stay as they are. With
    set_original the OQ tag keeps the qualities that the new ones replace, unless it is there. A BAM file holds no
    quality below 0, so new ones that are lower are written as 0.
    """
    stored = _stored(spark, sam).withColumn("file_rec", F.struct("file", "rec")).drop("file", "rec").withColumnRenamed("file_rec", "rec")
    own = aligned.model_of_report(report_file.read_report(spark, _uri(report_path)))
    reads = aligned.alignment_reads(stored, _groups(spark, sam), use_original).join(F.broadcast(own.rg.select("rg")), "rg", "left_semi")
    done = aligned.recalibrate_alignments(reads, own).withColumnRenamed("qual", "new_q")
    rows = stored.join(done, "rec", "left")
    if set_original:
        kept = F.map_from_arrays(F.array(F.lit("OQ")), F.array("qual"))
        rows = rows.withColumn("tags", F.when(F.col("new_q").isNotNull() & ~F.map_contains_key("tags", "OQ"), F.map_concat("tags", kept)).otherwise(F.col("tags")))
    low = "".join(chr(33 + q) for q in range(LEAST_LETTER, 0))
    rows = rows.withColumn("qual", F.coalesce(F.translate("new_q", low, "!" * len(low)), "qual")).orderBy("rec").drop("rec", "new_q")
    write_bam(rows, _uri(out), "".join(f"{r['value']}\n" for r in _header(spark, sam).orderBy("line").collect()))  # a header


def _stored(spark: SparkSession, sam: str) -> DataFrame:
    """Alignments of SAM text, a BAM file, or a folder of them, with `file`, its place among them."""
    if not _is_bam(sam):
        return alignments.read_sam(spark, sam).withColumn("file", F.lit(0))
    return reduce(DataFrame.unionByName, (alignments.read_bam(spark, [p]).withColumn("file", F.lit(k)) for k, p in enumerate(_bam_files(sam))))


def _is_bam(path: str) -> bool:
    return path.rstrip("/").endswith(".bam")


def _bam_files(path: str) -> list[str]:
    """The file itself, or those of a folder as `recalibrate -b` writes it."""
    from pyarrow import fs as pafs

    fs, name = pafs.FileSystem.from_uri(_uri(path).rstrip("/"))
    return [_uri(path)] if fs.get_file_info(name).is_file else bam_parts(_uri(path))


def _header(spark: SparkSession, sam: str) -> DataFrame:
    """(line, value) of the header; that of the first file of a folder."""
    if _is_bam(sam):
        return alignments.header_lines(spark, _bam_files(sam)[0])
    return alignments.numbered_lines(spark, sam).where("startswith(value, '@')")


def _groups(spark: SparkSession, sam: str) -> DataFrame:
    return alignments.bam_read_groups(spark, _bam_files(sam)[0]) if _is_bam(sam) else alignments.read_groups(spark, sam)


def _bins(spark: SparkSession, fasta: str, vcf: str, bed: str | None) -> DataFrame:
    return align.site_bins(sites.read_fasta(spark, fasta), align.variant_spans(sites.read_vcf(spark, vcf)), None if bed is None else sites.read_bed(spark, bed))


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{os.path.abspath(path)}"


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="qualspark")
    kinds = parser.add_subparsers(dest="command", required=True)
    r = kinds.add_parser("recalibrate")
    source = r.add_mutually_exclusive_group(required=True)
    source.add_argument("-f", "--fastq", nargs=2)
    source.add_argument("-b", "--sam")
    r.add_argument("-g", "--report")
    r.add_argument("-u", "--use-oq", action="store_true")
    r.add_argument("-s", "--set-oq", action="store_true")
    r.add_argument("-o", "--out", required=True)
    r.add_argument("--infer-rg", action="store_true")
    b = kinds.add_parser("benchmark")
    for flag, name in (("-b", "--sam"), ("-r", "--reference"), ("-v", "--vcf")):
        b.add_argument(flag, name, required=True)
    for flag, name in (("-f", "--fastq"), ("-l", "--label"), ("-d", "--bed")):
        b.add_argument(flag, name)
    b.add_argument("-u", "--use-oq", action="store_true")
    c = kinds.add_parser("report")
    for flag, name in (("-b", "--sam"), ("-r", "--reference"), ("-v", "--vcf"), ("-o", "--out")):
        c.add_argument(flag, name, required=True)
    c.add_argument("-d", "--bed")
    c.add_argument("-u", "--use-oq", action="store_true")
    p = kinds.add_parser("plot")
    p.add_argument("-t", "--type", choices=("calibration", "sample-size"), default="calibration")
    p.add_argument("file")
    own = parser.parse_args(args)
    if own.command == "recalibrate" and (own.sam is None) != (own.report is None):
        parser.error("alignments (-b) are recalibrated by a report (-g), reads (-f) by their corrected copies")
    spark = SparkSession.builder.appName("qualspark").getOrCreate()
    if own.command == "recalibrate" and own.sam:
        recalibrate_alignments(spark, own.sam, own.report, own.out, own.use_oq, own.set_oq)
    elif own.command == "report":
        write_report(spark, own.sam, own.reference, own.vcf, own.out, own.bed, own.use_oq)
    elif own.command == "recalibrate":
        recalibrate(spark, *own.fastq, own.out, own.infer_rg)
    elif own.command == "benchmark":
        table = benchmark(spark, own.sam, own.reference, own.vcf, own.bed, own.fastq, own.label, own.use_oq)
        for row in sites.calibration_text(table).collect():  # one line per quality
            print(row["value"])
    else:
        for row in calibration.plot_rows(sites.read_calibration(spark, own.file), own.type).orderBy("label", "x").collect():
            print(*row, sep="\t")


if __name__ == "__main__":
    main()
