"""CIGAR walks within the row: a read is walked once from its start, whatever it is asked for."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE, _PART = re.compile(r"(?:[0-9]+[MIDNSHP=X])+"), re.compile(r"([0-9]+)([MIDNSHP=X])")
READ, REF = frozenset("MIS=X"), frozenset("MDN=X")


def walk(cigar: str) -> Iterator[tuple[str, int, int, int]]:
    """(operation, length, read bases before it, reference sites before it) of each operation; other letters fail."""
    if not _WHOLE.fullmatch(cigar):
        raise ValueError(f"CIGAR cannot be read: {cigar}")
    read_at = ref_at = 0
    for n, op in _PART.findall(cigar):
        n = int(n)
        yield op, n, read_at, ref_at
        read_at += n if op in READ else 0
        ref_at += n if op in REF else 0


def flags(cigar: str, ref: bytes, mask: bytes) -> tuple[bytes, bytes]:
    """(ref, skip), a letter per base: the reference base it is aligned to (a space for none), and 1 if it is skipped.

    ref, mask: letters of the sites from one before the alignment to one behind it. M, =, X: skipped if the site is. I:
    skipped if the sites on both sides are. D, N: if any deleted site is skipped, the base before it is. S: skipped. H, P:
    nothing.
    """
    letters, skip = [], bytearray()
    for op, n, read_at, ref_at in walk(cigar):
        if op in "M=X":
            letters.append(ref[ref_at + 1 : ref_at + 1 + n])
            skip += mask[ref_at + 1 : ref_at + 1 + n]
        elif op in "IS":
            letters.append(b" " * n)
            skip += (b"1" if op == "S" or mask[ref_at : ref_at + 2] == b"11" else b"0") * n
        elif op in "DN" and read_at and b"1" in mask[ref_at + 1 : ref_at + 1 + n]:
            skip[read_at - 1] = ord("1")
    return b"".join(letters), bytes(skip)


def trimmed_part(cigar: str, far: int, reverse: bool) -> tuple[int, int] | None:
    """[from, to) of the bases in adaptor, or None; `far` is the distance from the alignment's start to the boundary.

    On the reverse strand everything up to the last read base at or before the boundary goes, on the forward strand
    everything from the first read base at or after it; bases aligned to nothing follow their neighbours.
    """
    last, first, end = None, None, 0
    for op, n, read_at, ref_at in walk(cigar):
        if not n:
            continue
        if op in READ:
            end = read_at + n
        if op in REF:
            left, gap = far - ref_at, op in "DN"
            if left >= 0:
                last = read_at + (0 if gap else min(n, left + 1))
            if first is None and left < n:
                first = read_at + (0 if gap else max(left, 0))
    part = (0, last) if reverse else (first, end)
    return part if None not in part and part[1] > part[0] else None


def _added(reads: DataFrame, columns: list, make) -> DataFrame:
    """`reads` with columns that `make` gives for an Arrow batch; the batch's other columns pass by."""
    schema = T.StructType([*reads.schema.fields, *columns])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch)], [f.name for f in schema.fields])

    return reads.mapInArrow(run, schema)


def cigar_rows(reads: DataFrame, *keep: str) -> DataFrame:
    """One row per operation: rec, keep, k, op, n, read_at, ref_at. reads: rec, cigar. Reads without a CIGAR give none."""

    def make(batch):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("op", pa.string()), ("n", pa.int32()), ("read_at", pa.int32()), ("ref_at", pa.int32())]))
        return [pa.array([[dict(zip(("op", "n", "read_at", "ref_at"), x, strict=True)) for x in walk(c)] for c in batch.column("cigar").to_pylist()], kind)]

    held = reads.where("cigar is not null and cigar <> '*'").select("rec", "cigar", *keep)
    one = T.StructType([T.StructField("op", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("n", "read_at", "ref_at"))])
    rows = _added(held, [T.StructField("_ops", T.ArrayType(one))], make)
    return rows.select("rec", *keep, F.posexplode("_ops").alias("k", "x")).select("rec", *keep, "k", "x.*")


def with_flags(reads: DataFrame) -> DataFrame:
    """Reads with ref and skip from cigar and the letters around their sites (_ref, _mask), which go."""

    def make(batch):
        import pyarrow as pa

        made = [flags(c, (r or "").encode(), (m or "").encode()) for c, r, m in zip(*(batch.column(c).to_pylist() for c in ("cigar", "_ref", "_mask")), strict=True)]
        return [pa.array([x[k].decode() for x in made], pa.string()) for k in (0, 1)]

    return _added(reads, [T.StructField("ref", T.StringType()), T.StructField("skip", T.StringType())], make).drop("_ref", "_mask")


def with_trim(reads: DataFrame) -> DataFrame:
    """Reads with gone_from and gone_to (nulls for none). reads: pos, cigar, reverse, boundary (nullable)."""

    def make(batch):
        import pyarrow as pa

        columns = (batch.column(c).to_pylist() for c in ("pos", "cigar", "reverse", "boundary"))
        parts = [trimmed_part(c, b - p, r) if b is not None and c not in (None, "*") else None for p, c, r, b in zip(*columns, strict=True)]
        return [pa.array([x and x[k] for x in parts], pa.int32()) for k in (0, 1)]

    return _added(reads, [T.StructField("gone_from", T.IntegerType()), T.StructField("gone_to", T.IntegerType())], make)
