"""BAM files by ranges of bytes: one file is read by as many tasks as its size asks for.

A range owns the BGZF blocks that begin in it. Where its first record begins is found from the bytes alone: the first
place from which records follow each other soundly to the end of the range. Ranges then tell how many bytes of their last
record lie in later ranges, and each must begin where the ones before it leave off; a file in which one does not is read
by a single task. So the rows are those of a reader from the start, or the fallback's.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE_BYTES = 8 << 20
_MAGIC, _HEAD = b"\x1f\x8b\x08\x04", 18
_FOUND = "path string, k long, start long, stop long, first long, total long, over long, n long"


def _open(path: str):
    from pyarrow import fs as pafs

    fs, name = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def _block_size(source, at: int, size: int) -> int:
    """Bytes of the BGZF block at `at`, or 0 if none begins there."""
    if at + _HEAD > size:
        return 0
    head = source.read_at(_HEAD, at)
    if head[:4] != _MAGIC or head[10:16] != b"\x06\x00BC\x02\x00":
        return 0
    return struct.unpack_from("<H", head, 16)[0] + 1


def first_block(source, at: int, size: int) -> int:
    """Where the first block at or after `at` begins: one that is followed by another or by the end of the file."""
    while at < size:
        raw = source.read_at(min(1 << 16, size - at) + 3, at)
        k = raw.find(_MAGIC)
        while k >= 0:
            if (n := _block_size(source, at + k, size)) and (at + k + n == size or _block_size(source, at + k + n, size)):
                return at + k
            k = raw.find(_MAGIC, k + 1)
        at += max(len(raw) - 3, 1)
    return size


def blocks_from(source, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(where it begins, its content) of blocks from `at` on."""
    while at < size:
        n = _block_size(source, at, size)
        if not n:
            raise ValueError(f"no block at byte {at}")
        yield at, zlib.decompress(source.read_at(n - _HEAD, at + _HEAD)[:-8], -15)
        at += n


class Header:
    """A BAM file's header: its text, the names of its references, and its length."""

    def __init__(self, source, size: int):
        blocks, self.held = blocks_from(source, 0, size), bytearray()
        self._need(blocks, 8)
        if self.held[:4] != b"BAM\1":
            raise ValueError("not a BAM file")
        n = struct.unpack_from("<i", self.held, 4)[0]
        self._need(blocks, 12 + n)
        self.text = self.held[8 : 8 + n].split(b"\0")[0].decode()
        at, self.names = 12 + n, []
        for _ in range(struct.unpack_from("<i", self.held, 8 + n)[0]):
            self._need(blocks, at + 4)
            m = struct.unpack_from("<i", self.held, at)[0]
            self._need(blocks, at + 8 + m)
            self.names.append(self.held[at + 4 : at + 3 + m].decode())
            at += 8 + m
        self.length = at

    def _need(self, blocks, n: int) -> None:
        while len(self.held) < n:
            self.held += next(blocks)[1]


def _sound(raw: bytes, at: int, n_refs: int) -> int:
    """Bytes of the record at `at` with its length field, 0 if none can begin there, -1 if too little is there to tell."""
    if at + 36 > len(raw):
        return -1
    size, ref, pos, n_name, _, _, n_cigar, _, n_seq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", raw, at)
    fine = size >= 32 and -1 <= ref < n_refs and -1 <= mate < n_refs and pos >= -1 and mate_pos >= -1 and n_name >= 1 and n_seq >= 0
    if not fine or 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq > size:
        return 0
    name = raw[at + 36 : at + 36 + n_name]
    if len(name) == n_name and (name[-1] or not all(33 <= c <= 126 for c in name[:-1])):
        return 0
    return size + 4


def walk(raw: bytes, at: int, n_refs: int) -> tuple[int, int] | None:
    """(records that begin in `raw` from `at` on, where the last one ends), or None if one of them is not sound."""
    n = 0
    while at < len(raw):
        step = _sound(raw, at, n_refs)
        if step == 0:
            return None
        if step < 0:
            # The length field or the fixed part goes on in a later range: the end is told by whoever reads on.
            return n + 1, -1
        at, n = at + step, n + 1
    return n, at


def _content(source, start: int, stop: int, size: int) -> tuple[bytes, int]:
    """(content of the blocks that begin in [start, stop), where the next block begins)."""
    parts, at = [], first_block(source, start, size)
    for at, part in blocks_from(source, at, size):  # noqa: B007
        if at >= stop:
            return b"".join(parts), at
        parts.append(part)
    return b"".join(parts), size


def _rest(source, at: int, size: int, need: int) -> bytes:
    """At least `need` bytes of content from the block at `at` on, or all there is."""
    out = bytearray()
    for _, part in blocks_from(source, at, size):
        if len(out) >= need:
            break
        out += part
    return bytes(out)


def _ended(source, raw: bytes, after: int, size: int, at: int, n_refs: int) -> tuple[int, int] | None:
    """walk() with what the last record needs of later ranges."""
    found = walk(raw, at, n_refs)
    if found is None or found[1] >= 0:
        return found
    return walk_one_more(raw, _rest(source, after, size, 36), at, n_refs)


def walk_one_more(raw: bytes, more: bytes, at: int, n_refs: int) -> tuple[int, int] | None:
    """(records that begin in `raw`, where the last one ends) with `more` bytes behind it to tell the last one's length."""
    whole, n = raw + more, 0
    while at < len(raw):
        step = _sound(whole, at, n_refs)
        if step <= 0:
            return None
        at, n = at + step, n + 1
    return n, at


def find_records(path: str, k: int, start: int, stop: int) -> tuple[int, int, int, int]:
    """(first, total, over, n) of a range: where its first record begins in its content (its length, if none does), the
    content's length, the bytes of its last record that lie beyond it, and how many records begin in it."""
    with _open(path) as source:
        size = source.size()
        header = Header(source, size)
        raw, after = _content(source, start, stop, size)
        for at in [header.length] if k == 0 else range(len(raw)):
            if at >= len(raw):
                break
            found = _ended(source, raw, after, size, at, len(header.names))
            if found:
                return at, len(raw), found[1] - len(raw), found[0]
            if k == 0:
                # A record that no rule allows: the file is read from the start by lengths alone.
                return at, len(raw), 0, -1
        # A header or a record that is longer than the range.
        return (header.length if k == 0 else len(raw)), len(raw), max(header.length - len(raw), 0) if k == 0 else 0, 0


def _ranges(spark: SparkSession, paths: list[str], range_bytes: int) -> DataFrame:
    """(path, k, start, stop) of all files, spread over tasks."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _open(path) as source:
                    size = source.size()
                starts = range(0, max(size, 1), range_bytes)
                yield pa.RecordBatch.from_pydict({"path": [path] * len(starts), "k": pa.array(range(len(starts)), pa.int64()), "start": pa.array(starts, pa.int64()), "stop": pa.array([min(s + range_bytes, size) for s in starts], pa.int64())})

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(len(paths), 1))
    return files.mapInArrow(cut, "path string, k long, start long, stop long")


def found_ranges(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES, tasks: int | None = None) -> DataFrame:
    """Ranges that agree with their neighbours: path, k, start, stop, first, rec (the number of its first record), n.

    Files in which some do not come back as one range. A range per row meets its file's others in one window.
    """
    spread = _ranges(spark, paths, range_bytes).repartition(tasks or 4 * spark.sparkContext.defaultParallelism)

    def find(batches):
        import pyarrow as pa

        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            found = [find_records(*r) for r in rows]
            columns = [[*r, *f] for r, f in zip(rows, found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if i == 0 else pa.int64()) for i, c in enumerate(zip(*columns, strict=True))], ["path", "k", "start", "stop", "first", "total", "over", "n"])

    from ..jobs.tables import materialize

    rows = materialize(spread.mapInArrow(find, _FOUND), "bam-ranges")
    order = Window.partitionBy("path").orderBy("k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # Bytes from the file's beginning: where the last record so far ends, and where a range's content and first record begin.
    begun = rows.withColumn("at", F.coalesce(F.sum("total").over(before), F.lit(0)))
    ended = begun.withColumn("due", F.max(F.col("at") + F.col("total") + F.col("over")).over(before))
    fine = F.col("due").isNull() & (F.col("n") >= 0) | (F.col("n") == 0) & (F.col("due") >= F.col("at") + F.col("total")) | (F.col("n") > 0) & (F.col("due") == F.col("at") + F.col("first"))
    judged = ended.withColumn("rec", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("bad", F.max((~fine).cast("int")).over(Window.partitionBy("path")))
    good = judged.where("bad = 0 and n > 0").select("path", "k", "start", "stop", "first", "rec", "n")
    whole = judged.where("bad = 1").groupBy("path").agg(F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("start"), F.max("stop").alias("stop"), F.lit(-1).cast("long").alias("first"), F.lit(0).cast("long").alias("rec"), F.lit(-1).cast("long").alias("n"))
    return good.unionByName(whole)


def records_of(path: str, start: int, stop: int, first: int, n: int) -> Iterator[tuple[list[str], bytes]]:
    """(reference names, record) of a range from its first record on; n < 0: of a file, from its first record on."""
    with _open(path) as source:
        size = source.size()
        header = Header(source, size)
        held, at = bytearray(), header.length if first < 0 else first
        for _, part in blocks_from(source, first_block(source, start, size), size):
            held += part
            while n and at + 4 <= len(held):
                length = struct.unpack_from("<i", held, at)[0]
                if at + 4 + length > len(held):
                    break
                yield header.names, bytes(held[at + 4 : at + 4 + length])
                at, n = at + 4 + length, n - 1
            if not n:
                return
            done = min(at, len(held))
            del held[:done]
            at -= done


def header_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a BAM file's header text: as long as its lists of references and read groups."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for p in batch.column(0).to_pylist():
                with _open(p) as source:
                    lines = Header(source, source.size()).text.splitlines()
                yield pa.RecordBatch.from_pydict({"line": pa.array(range(len(lines)), pa.int64()), "value": pa.array(lines, pa.string())})

    return spark.createDataFrame([(path,)], "path string").mapInArrow(read, "line long, value string")
