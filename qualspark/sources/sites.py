"""References, variant sites and intervals: FASTA, VCF and BED files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..jobs.tables import materialize
from ..operators.align import BIN


def read_fasta(spark: SparkSession, path: str, upper: bool = False) -> DataFrame:
    """(chrom, start, seq): each line of a sequence with the position of its first base; letters as written unless `upper`.

    A segmented scan: a partition walks its lines in order and numbers bases from its last header, or from its own start
    where it has had none yet. What is open at a partition's end is then carried on over the partitions of a file, a row
    each. Neither many contigs nor one long one gather anywhere. Lines before a file's first header fail.
    """
    text = spark.read.text(path).where("value <> ''").select(F.col("_metadata.file_path").alias("file"), F.spark_partition_id().alias("part"), "value")

    def scan(batches):
        import pyarrow as pa

        open_at: dict[tuple[str, int], tuple[str | None, int]] = {}
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string())
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], ["file", "part", "head", "at", "seq"])
        for batch in batches:
            rows = []
            for file, part, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head, at = open_at.get((file, part), (None, 0))
                if value.startswith(">"):
                    head, at = (value[1:].split(None, 1) or [""])[0] if value[1:2].strip() else "", 0
                else:
                    seq = value.strip(" ")
                    rows.append((file, part, head, at, seq))
                    at += len(seq)
                open_at[file, part] = head, at
            yield pack(rows)
        # What each file's piece leaves open: no line.
        yield pack([(file, part, head, at, None) for (file, part), (head, at) in open_at.items()])

    rows = materialize(text.mapInArrow(scan, "file string, part int, head string, at long, seq string"), "fasta-lines")
    ends = rows.where("seq is null")
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    run = ends.withColumn("run", F.count("head").over(Window.partitionBy("file").orderBy("part")))
    # The last header before a piece, and the bases since: those of the piece with that header and of all after it.
    named = run.withColumn("held", F.sum("at").over(Window.partitionBy("file", "run").orderBy("part"))).select("file", "part", "held", F.last("head", ignorenulls=True).over(Window.partitionBy("file").orderBy("part")).alias("last"))
    carried = named.select("file", "part", F.last("last").over(before).alias("open"), F.last("held").over(before).alias("carried"))
    lines = rows.where("seq is not null").join(carried, ["file", "part"])
    chrom = F.coalesce("head", "open", F.raise_error(F.lit("a sequence without a header")))
    start = F.when(F.col("head").isNull(), F.col("at") + F.col("carried")).otherwise(F.col("at"))
    return lines.select(chrom.alias("chrom"), start.alias("start"), (F.upper("seq") if upper else F.col("seq")).alias("seq"))


def reference_bases(chunks: DataFrame) -> DataFrame:
    """(chrom, pos, base) of reference chunks."""
    return chunks.select("chrom", "start", F.posexplode(F.split("seq", "")).alias("k", "base")).where("base <> ''").select("chrom", (F.col("start") + F.col("k")).cast("int").alias("pos"), "base")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos (1-based), ref, stop): stop from INFO END where it is given; gzip is read."""
    f = F.split("value", "\t")
    end = F.regexp_extract(F.element_at(f, 8), r"(?:^|;)END=([0-9]+)", 1)
    rows = spark.read.text(path).where("value <> '' and not startswith(value, '#')")
    return rows.select(F.element_at(f, 1).alias("chrom"), F.element_at(f, 2).cast("int").alias("pos"), F.element_at(f, 4).alias("ref"), F.when(end != "", end.cast("int")).alias("stop"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end), half-open; a line without exactly three fields fails."""
    f = F.split(F.trim("value"), r"\s+")
    three = F.when(F.size(f) == 3, f).otherwise(F.raise_error(F.concat(F.lit("not three fields: "), F.col("value"))))
    return spark.read.text(path).where("trim(value) <> ''").select(three.alias("f")).select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("int").alias("start"), F.col("f")[2].cast("int").alias("end"))


def bed_positions(bed: DataFrame) -> DataFrame:
    """Distinct (chrom, pos) inside the intervals.

    Intervals are cut at the borders of bins and give up what those before them in their bin cover, so no position is
    made twice and none is shuffled.
    """
    bins = F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN))
    cut = bed.where("end > start").select("chrom", "start", "end", F.explode(bins).alias("bin"))
    low, high = F.greatest("start", F.col("bin") * BIN).cast("int"), F.least("end", (F.col("bin") + 1) * BIN).cast("int")
    spans = cut.select("chrom", "bin", low.alias("start"), high.alias("end")).groupBy("chrom", "bin", "start").agg(F.max("end").alias("end"))
    before = Window.partitionBy("chrom", "bin").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    own = spans.select("chrom", F.greatest("start", F.max("end").over(before)).alias("start"), "end").where("end > start")
    return own.select("chrom", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))


def read_calibration(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Calibration tables written as tab-separated text without a header."""
    return spark.read.csv(path, sep="\t", schema="predicted_q int, actual_q int, label string, n_bases long")


def calibration_text(table: DataFrame) -> DataFrame:
    """`value` lines of a calibration table, ascending by predicted quality."""
    return table.where("n_bases > 0").orderBy("predicted_q").select(F.concat_ws("\t", "predicted_q", "actual_q", "label", "n_bases").alias("value"))
