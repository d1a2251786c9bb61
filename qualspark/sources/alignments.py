"""SAM and BAM files as rows: qname, flag, rname, pos (0-based), mapq, cigar, rnext, pnext, tlen, seq, qual, tags."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bam_blocks import RANGE_BYTES, found_ranges, header_lines, records_of
from .text_lines import numbered_lines

SCHEMA = "rec long, qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>"


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text, rec in file order. Of tags that a line repeats the last one counts."""
    lines = numbered_lines(spark, path).where("value <> '' and not startswith(value, '@')")
    # Header lines give nulls, as a filter on a field may be evaluated before the one that drops them.
    f = F.split(F.when(~F.startswith("value", F.lit("@")), F.col("value")), "\t")
    at = lambda k: F.element_at(f, k + 1)
    fields = F.slice(f, F.lit(12), F.size(f))
    pairs = F.transform(fields, lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substr(t, F.lit(6)).alias("v")))
    pairs = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return lines.select(
        F.col("line").alias("rec"),
        at(0).alias("qname"),
        at(1).cast("int").alias("flag"),
        at(2).alias("rname"),
        (at(3).cast("int") - 1).alias("pos"),
        at(4).cast("int").alias("mapq"),
        at(5).alias("cigar"),
        at(6).alias("rnext"),
        (at(7).cast("int") - 1).alias("pnext"),
        at(8).cast("int").alias("tlen"),
        at(9).alias("seq"),
        at(10).alias("qual"),
        F.map_from_entries(pairs).alias("tags"),
    )


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(rg_id, pu, rg_ord) of the @RG lines of SAM text, in header order; one without PU fails."""
    return _groups_of(numbered_lines(spark, path))


def bam_read_groups(spark: SparkSession, path: str) -> DataFrame:
    """read_groups of a BAM file's header."""
    return _groups_of(header_lines(spark, path))


def _groups_of(header: DataFrame) -> DataFrame:
    lines = header.where("startswith(value, '@RG\t')")
    field = lambda k: F.regexp_extract("value", f"\t{k}:([^\t]*)", 1)
    pu = F.when(field("PU") != "", field("PU")).otherwise(F.raise_error(F.concat(F.lit("read group without PU: "), F.col("value"))))
    before = lines.select("line", field("ID").alias("rg_id"), pu.alias("pu"))
    from pyspark.sql import Window

    return before.select("rg_id", "pu", (F.row_number().over(Window.orderBy("line")) - 1).alias("rg_ord"))  # a header's lines


def _tag(raw: bytes, at: int) -> tuple[str, str, int]:
    name, kind, at = raw[at : at + 2].decode(), chr(raw[at + 2]), at + 3
    if kind in "ZH":
        end = raw.index(0, at)
        return name, raw[at:end].decode(), end + 1
    if kind == "A":
        return name, chr(raw[at]), at + 1
    width = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
    if kind == "B":
        code, (n,) = width[chr(raw[at])], struct.unpack_from("<I", raw, at + 1)
        values = struct.unpack_from(f"<{n}{code}", raw, at + 5)
        return name, ",".join([chr(raw[at]), *map(str, values)]), at + 5 + struct.calcsize(f"<{n}{code}")
    (value,) = struct.unpack_from(f"<{width[kind]}", raw, at)
    return name, str(value), at + struct.calcsize(width[kind])


def _alignment(raw: bytes, names: list[str], rec: int) -> tuple:
    """A record's columns, in the order of SCHEMA."""
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHIiii", raw)
    at = 32
    qname, at = raw[at : at + n_name - 1].decode(), at + n_name
    ops = struct.unpack_from(f"<{n_cigar}I", raw, at)
    at += 4 * n_cigar
    packed = raw[at : at + (n_seq + 1) // 2]
    at += (n_seq + 1) // 2
    seq = "".join("=ACMGRSVTWYHKDBN"[b >> 4] + "=ACMGRSVTWYHKDBN"[b & 15] for b in packed)[:n_seq]
    quals, at, tags = raw[at : at + n_seq], at + n_seq, {}
    while at < len(raw):
        name, value, at = _tag(raw, at)
        tags[name] = value
    ref_name = lambda k: names[k] if k >= 0 else "*"
    qual = "*" if not n_seq or quals[0] == 255 else "".join(chr(q + 33) for q in quals)
    rnext = "=" if mate == ref and mate >= 0 else ref_name(mate)
    cigar = "".join(f"{x >> 4}{'MIDNSHP=X'[x & 15]}" for x in ops)
    return rec, qname, flag, ref_name(ref), pos, mapq, cigar or "*", rnext, mate_pos, tlen, seq or "*", qual, list(tags.items())


def read_bam(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Alignments of BAM files, each read in ranges of bytes by many tasks; rec counts within its file."""

    def decode(batches):
        import pyarrow as pa

        types = pa.schema([("rec", pa.int64()), ("qname", pa.string()), ("flag", pa.int32()), ("rname", pa.string()), ("pos", pa.int32()), ("mapq", pa.int32()), ("cigar", pa.string()), ("rnext", pa.string()), ("pnext", pa.int32()), ("tlen", pa.int32()), ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.map_(pa.string(), pa.string()))])

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

        for batch in batches:
            for path, start, stop, first, rec, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for names, raw in records_of(path, start, stop, first, n):
                    rows.append(_alignment(raw, names, rec))
                    rec += 1
                    if len(rows) == 2000:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)

    tasks = 4 * spark.sparkContext.defaultParallelism
    ranges = found_ranges(spark, paths, range_bytes).select("path", "start", "stop", "first", "rec", "n")
    return ranges.repartition(tasks, "path", "start").mapInArrow(decode, SCHEMA)


def as_reads(alignments: DataFrame, use_original: bool = False) -> DataFrame:
    """Alignments in sequencing direction: rec, name, rg (null without a tag), second, reverse, seq, qual, and cigar, chrom, pos.

    Unmapped alignments and those without a CIGAR are left out. With use_original the OQ tag gives the qualities.
    """
    from ..functions.names import canonical_name, reverse_complement
    from ..operators.calibration import selected_quality

    bit = lambda k: F.col("flag").bitwiseAND(k) != 0
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    rows = alignments.where(~bit(4) & (F.col("cigar") != "*"))
    qual, reverse = selected_quality(use_original, tag("OQ"), F.col("qual")), bit(16)
    return rows.select(
        "rec",
        canonical_name(F.col("qname"), bit(128)).alias("name"),
        tag("RG").alias("rg"),
        bit(128).alias("second"),
        reverse.alias("reverse"),
        F.when(reverse, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"),
        F.when(reverse, F.reverse(qual)).otherwise(qual).alias("qual"),
        "cigar",
        F.col("rname").alias("chrom"),
        "pos",
    )
