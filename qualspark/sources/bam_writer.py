"""BAM output as a Spark data source: a folder of BAM files, one for each partition, that appears when all are whole.

    spark.dataSource.register(BamSource)
    rows.write.format("bam").option("header", text).mode("append").save("file:///shared/out")

Tasks write below `_writing-<job>`; the commit moves one file of each partition into the folder, so what failed or was
tried twice leaves nothing. Every file holds the header, its records in BGZF blocks, and the end block; its number is
its partition's, so rows that were sorted by range are in order over the files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Content of a block; what deflate may add to it stays within the 65,536 bytes that a block's size can tell.
BLOCK = 65_280
#: Tags that are written as numbers; all others are text.
NUMBERS = "NM,AS,XS,MQ,NH,HI,IH,UQ,SM,AM,TC"
COLUMNS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "tags")
# Fixed values of the format: letters of bases and of CIGAR operations by their codes.
_BASES, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_NIBBLE = {ord(c): k for k, c in enumerate(_BASES)} | {ord(c.lower()): k for k, c in enumerate(_BASES)}
_CONSUME = frozenset("MDN=X")


def bgzf(data: bytes) -> bytes:
    """One block."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def references(header: str) -> list[tuple[str, int]]:
    """(name, length) of a header's @SQ lines, in order."""
    fields = [dict(f.split(":", 1) for f in line.split("\t")[1:]) for line in header.splitlines() if line.startswith("@SQ\t")]
    return [(f["SN"], int(f["LN"])) for f in fields]


def header_bytes(header: str) -> bytes:
    text, refs = header.encode(), references(header)
    names = b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in refs)
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs)) + names


def region_bin(start: int, end: int) -> int:
    """The smallest of the format's nested bins that holds [start, end): 2^14 positions at the finest of six levels, each eight times the last."""
    last, shift = max(end, start + 1) - 1, 14
    for level in range(5, 0, -1):
        if start >> shift == last >> shift:
            return ((1 << 3 * level) - 1) // 7 + (start >> shift)
        shift += 3
    return 0


def _operations(cigar: str) -> list[tuple[int, str]]:
    out, n = [], ""
    for c in "" if cigar == "*" else cigar:
        if c.isdigit():
            n += c
        else:
            out.append((int(n), c))
            n = ""
    return out


def record_bytes(row: tuple, ids: dict[str, int], numbers: frozenset[str]) -> bytes:
    """An alignment (COLUMNS) as the format stores it; a reference that the header does not name fails."""
    qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, tags = row
    ops, seq, qual = _operations(cigar or "*"), "" if seq in (None, "*") else seq, "*" if qual is None else qual
    if len(ops) > 65_535:
        raise ValueError(f"{qname}: {len(ops)} CIGAR operations")
    if qual != "*" and len(qual) != len(seq):
        raise ValueError(f"{qname}: {len(seq)} bases and {len(qual)} qualities")
    ref = -1 if rname in (None, "*") else ids[rname]
    mate = ref if rnext == "=" else -1 if rnext in (None, "*") else ids[rnext]
    codes = [_NIBBLE.get(c, 15) for c in seq.encode("latin-1", "replace")] + [0] * (len(seq) % 2)
    name = (qname or "*").encode() + b"\0"
    pos, pnext = (-1 if x is None else x for x in (pos, pnext))
    if min(pos, pnext) < -1:
        raise ValueError(f"{qname}: positions begin at 0, and -1 stands for none")
    span = sum(n for n, op in ops if op in _CONSUME)
    head = struct.pack("<iiBBHHHIiii", ref, pos, len(name), mapq or 0, region_bin(pos, pos + span) if pos >= 0 else 4680, len(ops), flag or 0, len(seq), mate, pnext, tlen or 0)
    body = [head, name, b"".join(struct.pack("<I", n << 4 | _OPS.index(op)) for n, op in ops), bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))]
    body.append(b"\xff" * len(seq) if qual == "*" else bytes(c - 33 for c in qual.encode()))
    for tag, value in tags or ():
        if value is not None:
            body.append(tag.encode() + (b"i" + struct.pack("<i", int(value)) if tag in numbers else b"Z" + value.encode() + b"\0"))
    out = b"".join(body)
    return struct.pack("<i", len(out)) + out


def blocks_of(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Blocks of joined parts, then the end block."""
    held = bytearray()
    for part in parts:
        held += part
        while len(held) >= BLOCK:
            yield bgzf(bytes(held[:BLOCK]))
            del held[:BLOCK]
    if held:
        yield bgzf(bytes(held))
    yield bgzf(b"")


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    rows: int


class BamWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        missing = [c for c in COLUMNS if c not in schema.fieldNames()]
        if missing:
            raise ValueError(f"columns are missing: {', '.join(missing)}")
        self.path, self.header, self.overwrite = options["path"].rstrip("/"), options.get("header", ""), overwrite
        self.numbers = frozenset(options.get("numbers", NUMBERS).split(","))
        self.writing = f"{self.path}/_writing-{uuid.uuid4().hex}"

    def _fs(self, path: str):
        from pyarrow import fs as pafs

        return pafs.FileSystem.from_uri(path)

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{task.partitionId():05d}-{task.taskAttemptId()}.bam"
        fs, folder = self._fs(self.writing)
        fs.create_dir(folder, recursive=True)
        ids, rows = {n: k for k, (n, _) in enumerate(references(self.header))}, 0

        def parts():
            nonlocal rows
            yield header_bytes(self.header)
            for batch in iterator:
                for row in zip(*(batch.column(c).to_pylist() for c in COLUMNS), strict=True):
                    rows += 1
                    yield record_bytes(row, ids, self.numbers)

        with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for block in blocks_of(parts()):
                out.write(block)
        return Written(task.partitionId(), name, rows)

    def commit(self, messages: list) -> None:
        """Files of the tasks that count move into the folder; a name for each job, so that appended ones stay beside older ones."""
        from pyarrow import fs as pafs

        fs, folder = self._fs(self.path)
        _, writing = self._fs(self.writing)
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(folder)):
                if old.base_name.endswith(".bam"):
                    fs.delete_file(old.path)
        job = self.writing.rsplit("-", 1)[1]
        for m in filter(None, messages):
            fs.move(f"{writing}/{m.name}", f"{folder}/part-{m.partition:05d}-{job}.bam")
        fs.delete_dir(writing)

    def abort(self, messages: list) -> None:
        from pyarrow import fs as pafs

        fs, writing = self._fs(self.writing)
        if fs.get_file_info(writing).type == pafs.FileType.Directory:
            fs.delete_dir(writing)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(self.options, schema, overwrite)


def write_bam(rows: DataFrame, path: str, header: str, mode: str = "append", numbers: str = NUMBERS) -> None:
    """Alignments (the columns of read_bam) as BAM files in the folder `path`, a URI that driver and executors share.

    `header` is the header's text; its @SQ lines name all references. Tags of `numbers` are written as numbers, others
    as text. Null or missing fields are written as the format leaves them out. No rows: one file without records.
    """
    rows.sparkSession.dataSource.register(BamSource)
    rows.select(*COLUMNS).write.format("bam").option("header", header).option("numbers", numbers).mode(mode).save(path)


def bam_parts(path: str) -> list[str]:
    """URIs of a folder's BAM files, in order."""
    from pyarrow import fs as pafs

    fs, folder = pafs.FileSystem.from_uri(path.rstrip("/"))
    found = fs.get_file_info(pafs.FileSelector(folder))
    return [f"{path.rstrip('/')}/{f.base_name}" for f in sorted(found, key=lambda f: f.base_name) if f.base_name.endswith(".bam")]
