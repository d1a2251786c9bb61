"""Registered queries of the file sources and writers: the given tables written as files below the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, aligned, calibration, model, read_arrays, report
from ..sources import alignments, fastq, report_file, sites
from ..sources.bam_writer import bam_parts, write_bam
from . import synthetic as syn
from .queries import _A, _ACTUAL, _B, _COUNTS, ORACLE_SQL, QUERIES, _finest, _query
from .tables import materialize, shared_dir


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _written(lines: DataFrame, name: str) -> str:
    """The path of text files that hold `lines`."""
    path = _path(lines.sparkSession, name)
    lines.write.text(path)
    return path


@_query("WITH " + syn.READS_SQL + " SELECT name, CAST(NULL AS VARCHAR) AS comment, seq, qual FROM reads")
def fastq_file(spark, sf_dir):
    """Reads written as FASTQ and read back."""
    path = _path(spark, "fastq")
    fastq.write_fastq(syn.documents_reads(spark, sf_dir).select("rec", "name", "seq", "qual"), path)
    return fastq.read_fastq(spark, path).drop("rec")


def _sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignments, written as SAM text and read back; the OQ tag holds the qualities in reverse."""
    rows = syn.alignments(spark, sf_dir)
    flag = F.when(F.col("reverse"), 16).otherwise(0) + F.when(F.col("second"), 128).otherwise(0) + 1
    tags = F.concat_ws("\t", F.concat(F.lit("RG:Z:"), F.col("rg")), F.concat(F.lit("OQ:Z:"), F.reverse("qual")))
    fields = (F.concat(F.lit("r"), F.col("rec")), flag, F.col("chrom"), F.col("pos") + 1, F.lit(30), F.col("cigar"), F.lit("="), F.col("pnext") + 1, F.col("tlen"), F.col("seq"), F.col("qual"), tags)
    return alignments.read_sam(spark, _written(rows.select(F.concat_ws("\t", *(f.cast("string") for f in fields)).alias("value")), "sam"))


@_query(
    _A
    + """ SELECT 'r' || rec || CASE WHEN second THEN '/2' ELSE '/1' END AS name, rg, second, reverse, CASE WHEN reverse THEN reverse(translate(seq, 'ATGC', 'TACG')) ELSE seq END AS seq,
    CASE WHEN reverse THEN qual ELSE reverse(qual) END AS qual, cigar, chrom, pos FROM aligned"""
)
def sam_file(spark, sf_dir):
    """Alignments from SAM text, in sequencing direction, with the qualities of the OQ tag."""
    return alignments.as_reads(_sam(spark, sf_dir), use_original=True).drop("rec")


@_query(ORACLE_SQL["sam_file"].replace("cigar, chrom, pos", "cigar, coalesce(rg, '*') AS chrom, pos"))
def bam_file(spark, sf_dir):
    """sam_file by way of BAM files, one for each partition; a language is a contig, so that the header is short."""
    langs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang").where("lang is not null").distinct().orderBy("lang").collect()  # a handful
    path, rows = _path(spark, "bam"), _sam(spark, sf_dir)
    contig = F.coalesce(F.try_element_at("tags", F.lit("RG")), F.lit("*"))
    write_bam(rows.withColumn("rname", contig).withColumn("pnext", F.greatest("pnext", F.lit(-1))), path, "".join(f"@SQ\tSN:{x['lang']}\tLN:{(1 << 31) - 1}\n" for x in langs))
    return alignments.as_reads(alignments.read_bam(spark, bam_parts(path)), use_original=True).drop("rec")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read groups of a header that has one for each language."""
    langs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang").where("lang is not null").distinct().coalesce(1).orderBy("lang")
    lines = langs.select(F.format_string("@RG\tID:%s\tSM:x\tPU:unit-%s", "lang", "lang").alias("value"))
    return alignments.read_groups(spark, _written(lines.coalesce(1), "header"))


@_query("SELECT lang AS rg_id, 'unit-' || lang AS pu, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS rg_ord FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def read_groups_file(spark, sf_dir):
    return _groups(spark, sf_dir)


@_query(_A + " SELECT 'unit-' || rg AS unit, count(*) AS n, CAST(sum(length(qual)) AS BIGINT) AS bases FROM aligned GROUP BY rg")
def reads_by_unit(spark, sf_dir):
    """Alignments meet their group's platform unit."""
    rows = aligned.alignment_reads(_sam(spark, sf_dir), _groups(spark, sf_dir))
    return rows.groupBy(F.col("rg").alias("unit")).agg(F.count("*").alias("n"), F.sum(F.length("qual")).alias("bases"))


@_query("WITH " + syn.READS_SQL + f" SELECT chrom, k * {syn.READ} AS start, corrected AS seq FROM reads")
def fasta_file(spark, sf_dir):
    """The reference, a contig a document, written as FASTA and read back."""
    lines = syn.documents_reads(spark, sf_dir).groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("k", "corrected"))).alias("x"))
    text = F.concat_ws("\n", F.concat(F.lit(">"), F.col("chrom"), F.lit(" a contig")), F.transform("x", lambda x: x["corrected"]))
    return sites.read_fasta(spark, _written(lines.select(text.alias("value")), "fasta")).select("chrom", F.col("start").cast("long").alias("start"), "seq")


@_query(ORACLE_SQL["variant_expand"])
def vcf_file(spark, sf_dir):
    """Variant sites of records written as VCF."""
    info = F.coalesce(F.concat(F.lit("DP=3;END="), F.col("stop").cast("string")), F.lit("."))
    fields = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", F.lit("T"), F.lit("."), F.lit("."), info)
    return align.variant_sites(sites.read_vcf(spark, _written(syn.variant_records(spark, sf_dir).select(fields.alias("value")), "vcf")))


@_query(f"WITH {syn.SITES_SQL} SELECT chrom, count(DISTINCT p) AS n, CAST(min(p) AS INTEGER) AS first, CAST(max(p) AS INTEGER) AS last FROM (SELECT chrom, unnest(range(a, b)) AS p FROM bed) GROUP BY chrom")
def bed_file(spark, sf_dir):
    """Positions inside regions written as BED."""
    lines = syn.confident_regions(spark, sf_dir).select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string")).alias("value"))
    inside = sites.bed_positions(sites.read_bed(spark, _written(lines, "bed")))
    return inside.groupBy("chrom").agg(F.count("*").alias("n"), F.min("pos").cast("int").alias("first"), F.max("pos").cast("int").alias("last"))


@_query(_B + f", made AS (SELECT q AS predicted_q, {_ACTUAL.format(e='sum(CAST(error AS BIGINT))', n='count(*)')} AS actual_q, count(*) AS n_bases FROM bases WHERE NOT skip GROUP BY q) SELECT made.*, label FROM made, (SELECT unnest(['first', 'second']) AS label)")
def calibration_files(spark, sf_dir):
    """Calibration tables of two labels as tab-separated files, read as one."""
    counts = materialize(model.level_counts(_finest(spark, sf_dir), "q"), "counts-q")
    table = calibration.calibration_of_counts(counts, "first")
    paths = [_written(sites.calibration_text(table.withColumn("label", F.lit(x))), "calibration") for x in ("first", "second")]
    return sites.read_calibration(spark, paths)


@_query(ORACLE_SQL["cov_cycle"])
def report_round_trip(spark, sf_dir):
    """A report written as text, read back and turned into counts by cycle."""
    finest = materialize(_finest(spark, sf_dir), "finest-counts")
    text = report_file.format_report(report_file.collect_report(report.report_tables(finest)))  # a report: read groups x qualities x cycles
    path = _written(spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1), "report")
    cells = report.counts_from_report(report_file.read_report(spark, path))["cycle"]
    return cells.select("rg", F.col("q").cast("int").alias("q"), "cycle", "errors", "total")


@_query(f"{_COUNTS} SELECT CAST(max(CASE WHEN cycle >= 0 THEN cycle + 1 ELSE -cycle END) AS INTEGER) AS n FROM counts")
def longest_cycle(spark, sf_dir):
    return report.longest_cycle(model.level_counts(_finest(spark, sf_dir), "rg", "q", "cycle"))


@_query(
    f"""{_COUNTS}, n AS (SELECT max(CASE WHEN cycle >= 0 THEN cycle + 1 ELSE -cycle END) AS n FROM counts)
    SELECT g.rg, CAST(s AS INTEGER) AS q, CAST(v AS INTEGER) AS cycle, CAST(coalesce(errors, 0) AS BIGINT) AS errors, CAST(coalesce(total, 0) AS BIGINT) AS total
    FROM (SELECT DISTINCT rg FROM counts) g, (SELECT unnest(range(0, 43)) AS s), (SELECT unnest(range(-n, n)) AS v FROM n)
    LEFT JOIN (SELECT rg, q, cycle, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(total) AS BIGINT) AS total FROM counts GROUP BY ALL) c ON c.rg = g.rg AND c.q = s AND c.cycle = v"""
)
def dense_cycles(spark, sf_dir):
    """Counts by cycle over the whole domain of a model."""
    return report.dense_cells(materialize(model.level_counts(_finest(spark, sf_dir), "rg", "q", "cycle"), "cycle-counts"), "cycle")


_VALUES = ", ".join(f"coalesce(string_agg(CAST({c} AS VARCHAR), ',' ORDER BY pos) FILTER (NOT skip{extra}{also}), '') AS {c}_{name}" for c, extra in (("q", ""), ("cycle", ""), ("dinuc", " AND dinuc >= 0")) for name, also in (("errors", " AND error"), ("valid", "")))


@_query(_B + f" SELECT rec, {_VALUES} FROM bases GROUP BY rec")
def read_values(spark, sf_dir):
    """Each read's covariates at its errors and at all bases that count, as text."""
    values = read_arrays.read_values(syn.documents_reads(spark, sf_dir))
    return values.select("rec", *(F.array_join(c, ",").alias(c) for c in values.columns[1:]))


__all__ = ["ORACLE_SQL", "QUERIES"]
