"""WARC records in ZIP packages, written by Spark tasks and read back by range, without extraction.

A package is a ZIP file with two stored members: archive/data.warc.gz, one gzip member per record, and
indexes/index.jsonl, one line per record with its offset and length in the archive. The reader takes the end record,
its ZIP64 forms where they are used, and the central directory; from the local headers it knows where members start in
the file, reads the index, and then reads records by range.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zipfile
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, sized_broadcast
from .store_fs import committed, open_fs, read_range
from .token_store import spread

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Rows up to which the digests of repeated payloads are broadcast; above, the join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Bytes of archive that are read at once, unless one record is longer.
READ_BYTES = 4 << 20
_STAMP = "2000-01-01T00:00:00Z"


def base32_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page_id(name: str) -> int | None:
    own = name.strip("<>").rpartition(":")[2]
    return None if own == "null" else int(own)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {_STAMP}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base32_digest(payload)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC header, HTTP header, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda part: {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in part.decode().split("\r\n")[1:])}
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    if len(block) != int(warc["content-length"]):
        raise ValueError("record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


class _Sink:
    """What zipfile needs of a stream that cannot seek."""

    def __init__(self, stream):
        self._stream = stream

    def write(self, data) -> int:
        self._stream.write(data)
        return len(data)

    def flush(self) -> None:
        pass


def write_packages(pages: DataFrame, *, least_bytes: int = 0, out: str | None = None) -> DataFrame:
    """Write `pages` (page_id long, url, html; other columns are ignored) as packages; returns path, n_records of each.

    A payload is the html in UTF-8, null as empty. Of records with equal payloads of `least_bytes` or more, those with
    the smallest page_id are responses and the others revisit it; rows that repeat that page_id and payload are
    responses too. A null page_id counts as larger than any; among nulls alone, all are responses.
    """
    out = out or scratch(pages.sparkSession, "packages")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # Digests that occur once need no partner. Map-side sums keep a payload that fills the table from piling up.
    groups = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "size", "first")
    groups = materialize(groups, "warc-repeats")
    typed = rows.join(sized_broadcast(groups, BROADCAST_ROWS), ["digest", "size"], "left").select("page_id", "url", "payload", F.col("first").alias("refers_to"), F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)).alias("revisit"))

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        batch = next(batches, None)
        if batch is None:
            return
        uri, index, at = f"{out}/pages-{TaskContext.get().partitionId():06d}.zip", [], 0
        with committed(uri) as stream, zipfile.ZipFile(_Sink(stream), "w", zipfile.ZIP_STORED) as package:
            with package.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True) as archive:
                while batch is not None:
                    for page_id, url, payload, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                        data = packer.compress(record(page_id, url, payload, refers_to, revisit)) + packer.flush()
                        archive.write(data)
                        index.append((at, len(data)))
                        at += len(data)
                    batch = next(batches, None)
            with package.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as lines:
                for offset, length in index:
                    lines.write(json.dumps({"offset": offset, "length": length}).encode() + b"\n")
        yield pa.RecordBatch.from_pydict({"path": [uri], "n_records": pa.array([len(index)], pa.int64())})

    return materialize(typed.mapInArrow(write, "path string, n_records long"), "warc-packages")


def zip_members(source) -> dict[str, tuple[int, int, int]]:
    """name -> (start of its data, stored size, method) of each member of an open ZIP file, from its directories."""
    size = source.size()
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = read_range(source, tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):  # the mark may be in the comment
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of a ZIP directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07" and (count == 0xFFFF or 0xFFFFFFFF in (length, start)):
        (end64,) = struct.unpack_from("<Q", tail, at - 12)
        head = read_range(source, end64, 56)
        if head[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record where its locator points")
        count, length, start = struct.unpack_from("<QQQ", head, 32)
    directory, at, members = read_range(source, start, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("central directory is damaged")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        (local,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra, end = at + 46 + n_name, at + 46 + n_name + n_extra
        while extra + 4 <= end:
            kind, n = struct.unpack_from("<HH", directory, extra)
            if kind == 1:  # ZIP64: only the fields that do not fit, in this order
                wide = extra + 4
                if plain == 0xFFFFFFFF:
                    (plain,), wide = struct.unpack_from("<Q", directory, wide), wide + 8
                if packed == 0xFFFFFFFF:
                    (packed,), wide = struct.unpack_from("<Q", directory, wide), wide + 8
                if local == 0xFFFFFFFF:
                    (local,) = struct.unpack_from("<Q", directory, wide)
            extra += 4 + n
        head = read_range(source, local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{name}: no local header where the directory points")
        members[name] = (local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed, method)
        at = end + n_comment
    return members


def read_packages(packages: DataFrame) -> DataFrame:
    """Records of packages (path string): page_id, payload_bytes, payload_digest, record_type, refers_to.

    Payloads of responses are held against their digests; a mismatch fails the job. What a revisit says of its payload
    comes from its own headers.
    """

    def locate(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = open_fs(path)
                with fs.open_input_file(name) as source:
                    members = zip_members(source)
                    for member in (ARCHIVE, INDEX):
                        if members[member][2] != zipfile.ZIP_STORED:
                            raise ValueError(f"{path}: {member} is not stored")
                    start = members[ARCHIVE][0]
                    lines = [json.loads(x) for x in read_range(source, *members[INDEX][:2]).splitlines()]
                runs, run = [], []
                for x in lines:
                    if run and start + x["offset"] + x["length"] - run[0][0] > READ_BYTES:
                        runs.append(run)
                        run = []
                    run.append((start + x["offset"], x["length"]))
                runs += [run] if run else []
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(runs), pa.string()), "start": pa.array([r[0][0] for r in runs], pa.int64()), "lengths": pa.array([[n for _, n in r] for r in runs], pa.list_(pa.int64()))})

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path, start, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as source:
                    raw, at, out = read_range(source, start, sum(lengths)), 0, []
                for n in lengths:
                    warc, http, payload = parse_record(zlib.decompress(raw[at : at + n], 31))
                    at += n
                    digest, kind = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"]
                    if kind == "response" and (base32_digest(payload) != digest or len(payload) != int(http["content-length"])):
                        raise ValueError(f"{path}: payload of {warc['warc-record-id']} is damaged")
                    to = _page_id(warc["warc-refers-to"]) if kind == "revisit" else None
                    out.append((_page_id(warc["warc-record-id"]), int(http["content-length"]), digest, kind, to))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
                yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for c, v, t in zip(names, zip(*out, strict=True), types, strict=True)})

    found = spread(packages.select("path")).mapInArrow(locate, "path string, start long, lengths array<long>")
    # A number of its own: these rows are small, but each stands for megabytes that a task reads.
    tasks = 4 * int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(tasks, "path", "start").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
