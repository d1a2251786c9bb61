"""Reads, alignments and sites made from the given tables, so that the operators have whole tables to work on.

Every text is cut into reads of READ letters, to its end. Letters map to bases, corrected bases and qualities by three
tables that a rule spells out; anything else is an N of quality 2. The same tables are written into the SQL.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.read_arrays import letters

READ = 100
#: Record numbers that a document has for its reads: more than a text can fill.
RECS = 1_000_000_000
LETTERS = " " + string.ascii_uppercase + string.ascii_lowercase
SEQ = "N" + "".join("ATGC"[(7 * k + k // 5) % 4] for k in range(52))
#: Some letters are errors: there the corrected base is the next one.
CORRECTED = "N" + "".join("ATGC"[("ATGC".index(b) + (k % 9 == 4 or k % 26 == 7)) % 4] for k, b in enumerate(SEQ[1:]))
QUALS = "#" + "".join(chr(33 + (11 * k + 3) % 43) for k in range(52))
KINDS = ("seq", "corrected", "qual")
#: Reads of a batch that a task makes.
BATCH = 10_000
_MADE = {kind: np.full(256, ord(made[0]), dtype=np.uint8) for kind, made in zip(KINDS, (SEQ, CORRECTED, QUALS), strict=True)}
for _kind, _made in zip(KINDS, (SEQ, CORRECTED, QUALS), strict=True):
    _MADE[_kind][np.frombuffer(LETTERS.encode(), np.uint8)] = np.frombuffer(_made.encode(), np.uint8)


def documents_reads(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """Reads of all documents: rec, doc_id, k, rg (lang), second, name, chrom, seq, corrected, qual."""
    return reads_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), *kinds)


def _cut(kinds: tuple[str, ...]):
    """Reads of whole batches of texts: a letter per character, so that a text is walked once, whatever its length."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            raw, sizes = letters(batch.column(2))
            first = (raw & 0xC0) != 0x80  # the first byte of each character
            chars = np.concatenate(([0], np.cumsum(first)))[np.concatenate(([0], np.cumsum(sizes)))]
            raw, n = raw[first], (np.diff(chars) + READ - 1) // READ
            doc = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            for low in range(0, len(doc), BATCH):
                held = slice(low, low + BATCH)
                start = chars[doc[held]] + k[held] * READ
                end = min(start[-1] + READ, chars[doc[held][-1] + 1])
                offsets = pa.py_buffer((np.append(start, end) - start[0]).astype(np.int32))
                texts = [pa.Array.from_buffers(pa.string(), len(start), [None, offsets, pa.py_buffer(_MADE[c][raw[start[0] : end]])]) for c in kinds]
                own = pa.array(doc[held])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(k[held], pa.int32()), *texts], ["doc_id", "lang", "k", *kinds])

    return cut


def reads_of(docs: DataFrame, *kinds: str) -> DataFrame:
    """Reads of `docs`, which may be a stream; of seq, corrected and qual only `kinds`, if any are named."""
    kinds = kinds or KINDS
    texts = docs.select("doc_id", "lang", F.col("text").cast("binary").alias("text"))
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    piece = texts.mapInArrow(_cut(kinds), f"doc_id {doc_id}, lang string, k int, " + ", ".join(f"{c} string" for c in kinds))
    second = F.col("doc_id") % 2 == 1
    rec = F.col("doc_id") * RECS + F.col("k")
    name = F.concat(F.lit("r"), rec.cast("string"), F.when(second, "/2").otherwise("/1"), F.lit("_RG:Z:"), F.col("lang"))
    return piece.select(
        rec.alias("rec"),
        "doc_id",
        "k",
        F.col("lang").alias("rg"),
        second.alias("second"),
        name.alias("name"),
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chrom"),
        *kinds,
    )


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reads aligned to their documents: also pos, cigar, reverse, tlen, pnext; four shapes of CIGAR by turns."""
    n, kind = F.length("seq"), F.col("rec") % 4
    s = lambda c: c.cast("string")
    cigar = (
        F.when((n < 60) | (kind == 0), F.concat(s(n), F.lit("M")))
        .when(kind == 1, F.concat(F.lit("10S"), s(n - 10), F.lit("M")))
        .when(kind == 2, F.concat(F.lit("20M5I"), s(n - 25), F.lit("M")))
        .otherwise(F.concat(F.lit("20M3D"), s(n - 20), F.lit("M")))
    )
    pos = (F.col("k") * READ).cast("int")
    rows = documents_reads(spark, sf_dir, "seq", "qual").select("*", pos.alias("pos"), cigar.alias("cigar"), (F.col("rec") % 3 == 1).alias("reverse"))
    step = ((F.col("rec") % 160 * 37) % 160).cast("int")
    return rows.select("*", F.when(F.col("reverse"), -(step + 20)).otherwise(step - 10).alias("tlen"), F.when(F.col("reverse"), pos + step - 90).otherwise(pos + step - 40).alias("pnext"))


def reference_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, start, seq): the corrected letters of all documents, a chunk per read."""
    return documents_reads(spark, sf_dir, "corrected").select("chrom", (F.col("k") * READ).cast("int").alias("start"), F.col("corrected").alias("seq"))


def variant_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, pos (1-based), ref, stop) from all orders: several a document on average, some of them long."""
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.max("doc_id").alias("m"))  # one row
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").crossJoin(n)
    key = F.col("o_orderkey")
    ref = F.when(key % 5 == 0, "ACG").otherwise("A")
    return orders.select(F.concat(F.lit("c"), (key % (F.col("m") + 1)).cast("string")).alias("chrom"), ((key * 13) % 997 + 1).cast("int").alias("pos"), ref.alias("ref"), F.when(key % 11 == 0, ((key * 13) % 997 + 9).cast("int")).alias("stop"))


def confident_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, start, end) from all documents: two regions each, the second of many lengths."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    chrom = F.concat(F.lit("c"), F.col("doc_id").cast("string"))
    first = docs.select(chrom.alias("chrom"), F.lit(5).alias("start"), (F.lit(60) + F.col("doc_id") % 50).cast("int").alias("end"))
    return first.unionByName(docs.select(chrom.alias("chrom"), F.lit(150).alias("start"), (F.lit(151) + F.floor(F.col("n") / 2)).cast("int").alias("end")))


# The same relations as SQL, for the oracle.
_Q = lambda s: s.replace("'", "''")
READS_SQL = f"""cut AS (SELECT doc_id, lang, t, unnest(range(0, CAST((length(t) + {READ - 1}) // {READ} AS BIGINT))) AS k
  FROM (SELECT doc_id, lang, regexp_replace(coalesce(text, ''), '[^A-Za-z]', ' ', 'g') AS t FROM documents)),
piece AS (SELECT doc_id, lang, k, substring(t, k * {READ} + 1, {READ}) AS c FROM cut),
reads AS (SELECT doc_id * {RECS} + k AS rec, doc_id, k, lang AS rg, doc_id % 2 = 1 AS second,
  'r' || (doc_id * {RECS} + k) || CASE WHEN doc_id % 2 = 1 THEN '/2' ELSE '/1' END || '_RG:Z:' || lang AS name, 'c' || doc_id AS chrom,
  translate(c, '{LETTERS}', '{SEQ}') AS seq, translate(c, '{LETTERS}', '{CORRECTED}') AS corrected, translate(c, '{LETTERS}', '{_Q(QUALS)}') AS qual FROM piece)"""
BASES_SQL = (
    READS_SQL
    + """,
letters AS (SELECT rec, rg, second, CAST(p AS INTEGER) AS pos, substring(seq, p + 1, 1) AS base, CASE WHEN p > 0 THEN substring(seq, p, 1) END AS prev,
  ascii(substring(qual, p + 1, 1)) - 33 AS q, substring(corrected, p + 1, 1) AS cor FROM (SELECT *, unnest(range(0, length(seq))) AS p FROM reads)),
bases AS (SELECT rec, rg, second, pos, base, prev, CAST(q AS INTEGER) AS q, CAST(CASE WHEN second THEN -(pos + 1) ELSE pos END AS INTEGER) AS cycle,
  CAST(CASE WHEN prev IS NOT NULL AND instr('ATGC', prev) > 0 AND instr('ATGC', base) > 0 AND q >= 6 THEN 4 * (instr('ATGC', prev) - 1) + instr('ATGC', base) - 1 ELSE -1 END AS INTEGER) AS dinuc,
  base <> cor AS error, q < 6 AS skip FROM letters)"""
)
ALIGNED_SQL = (
    READS_SQL
    + f""",
step AS (SELECT *, length(seq) AS n, rec % 3 = 1 AS reverse, CAST(k * {READ} AS INTEGER) AS pos, CAST((rec % 160 * 37) % 160 AS INTEGER) AS s FROM reads),
aligned AS (SELECT *, CASE WHEN n < 60 OR rec % 4 = 0 THEN n || 'M' WHEN rec % 4 = 1 THEN '10S' || (n - 10) || 'M' WHEN rec % 4 = 2 THEN '20M5I' || (n - 25) || 'M' ELSE '20M3D' || (n - 20) || 'M' END AS cigar,
  CASE WHEN reverse THEN -(s + 20) ELSE s - 10 END AS tlen, CASE WHEN reverse THEN pos + s - 90 ELSE pos + s - 40 END AS pnext FROM step),
ops AS (SELECT rec, chrom, pos, seq, reverse, k, right(x[k + 1], 1) AS op, CAST(left(x[k + 1], length(x[k + 1]) - 1) AS INTEGER) AS n FROM
  (SELECT rec, chrom, pos, seq, reverse, x, unnest(range(0, len(x))) AS k FROM (SELECT *, regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]') AS x FROM (SELECT * EXCLUDE (k) FROM aligned)))),
walk AS (SELECT *, CAST(coalesce(sum(CASE WHEN op IN ('M','I','S','=','X') THEN n ELSE 0 END) OVER w, 0) AS INTEGER) AS read_at,
  CAST(coalesce(sum(CASE WHEN op IN ('M','D','N','=','X') THEN n ELSE 0 END) OVER w, 0) AS INTEGER) AS ref_at FROM ops
  WINDOW w AS (PARTITION BY rec ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pairs AS (SELECT rec, chrom, pos, seq, reverse, k, op, j, CASE WHEN op IN ('M','I','S','=','X') THEN read_at + j END AS read_pos, CASE WHEN op IN ('M','D','N','=','X') THEN ref_at + j END AS ref_off
  FROM (SELECT *, unnest(range(0, n)) AS j FROM walk WHERE op NOT IN ('H','P')))"""
)
SITES_SQL = """variants AS (SELECT DISTINCT chrom, CAST(unnest(range(pos - 1, coalesce(stop, pos - 1 + length(ref)))) AS INTEGER) AS pos FROM
  (SELECT 'c' || (o_orderkey % (SELECT max(doc_id) + 1 FROM documents)) AS chrom, (o_orderkey * 13) % 997 + 1 AS pos, CASE WHEN o_orderkey % 5 = 0 THEN 'ACG' ELSE 'A' END AS ref,
    CASE WHEN o_orderkey % 11 = 0 THEN (o_orderkey * 13) % 997 + 9 END AS stop FROM orders)),
bed AS (SELECT 'c' || doc_id AS chrom, 5 AS a, 60 + doc_id % 50 AS b FROM documents UNION ALL SELECT 'c' || doc_id, 150, 151 + coalesce(length(text), 0) // 2 FROM documents)"""
