"""Token-id shards with a minimal perfect hash index from document key to offset.

A store is a folder of range-partitioned shards in ascending key order. Shard file, little endian:

    payload   ids of all documents, end id included, nothing between them
    index     offsets of the documents (n + 1 int64, in ids), keys (n int64), null flags of the keys (n bytes),
              the hash, one fingerprint (u32) and one ordinal (u32) per slot
    footer    48 bytes: magic, id width, documents, ids, distinct keys, bytes of the hash

A key's slot gives, after its fingerprint agrees, the ordinal of its first document, and the offsets give the byte
range: constant time, one range read for the ids. Documents that repeat a key follow one another. A null key sorts
first and is reached by ordinal only. Null or empty texts hold the end id alone. An empty table makes no shard.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch
from .perfect_hash import PerfectHash, fingerprints
from .store_fs import committed, open_fs, read_range
from .text_ids import chunk_ids

_FOOTER = struct.Struct("<8sQQQQQ")
_MAGIC = b"TOKSHRD1"
#: Buckets of keys in which keys and shards are joined.
KEY_BUCKETS = 1024
_MANIFEST = "shard int, path string, n_docs long, n_ids long, first_key long, last_key long, keys array<long>"


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int, *, dtype: str | None = None, special_as_text: bool = False, index: bool = True, ordered: bool = True, out: str | None = None) -> DataFrame:
    """Encode `docs` (doc_id long, text string; other columns are ignored) into shards under `out`.

    Returns the manifest, one row per shard: shard (ascending with the keys), path, n_docs, n_ids, first_key,
    last_key. Rows are spread by (doc_id, input order), so a key that repeats a lot spans shards.
    Ids are stored in `dtype`, by default two bytes each where the vocabulary and the end id allow it, else four.
    With ordered=False shards are the input's partitions as they are, without a shuffle, and keys may come in any order.
    With index=False the files are flat, payload only, and the manifest's `keys` lists the shard's documents in order.
    """
    out = out or scratch(docs.sparkSession, "tokens")
    if index and not ordered:
        raise ValueError("an index needs ordered keys")
    dtype = dtype or id_type(tokenizer_path, end_id)
    width = np.dtype(dtype).itemsize

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, shard, uri = chunk_ids(tokenizer_path, dtype, special_as_text).encode, TaskContext.get().partitionId(), None
        end = np.array([end_id], dtype=dtype).tobytes()
        keys, nulls, sizes = [], [], []
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        uri = f"{out}/shard-{shard:06d}.ids"
        with committed(uri) as stream:
            while first is not None:
                column = first.column(0)
                nulls.append(np.asarray(column.is_null().to_numpy(zero_copy_only=False), dtype=np.uint8))
                keys.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                for value in first.column(1):
                    ids = encode(value.as_py()) + end
                    sizes.append(len(ids) // width)
                    stream.write(ids)
                first = next(batches, None)
            key, null = np.concatenate(keys), np.concatenate(nulls)
            offsets = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))])
            if index:
                stream.write(_index(key, null, offsets, width))
        known = key[null == 0]
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([shard], pa.int32()), "path": [uri], "n_docs": pa.array([len(key)], pa.int64()), "n_ids": pa.array([int(offsets[-1])], pa.int64())}
            | {"keys": pa.array([None if index else pa.array(key, pa.int64(), mask=null == 1)], pa.list_(pa.int64()))}
            | {k: pa.array([int(v[i]) if len(v) else None], pa.int64()) for k, v, i in (("first_key", known, 0), ("last_key", known, -1))}
        ).select(["shard", "path", "n_docs", "n_ids", "first_key", "last_key", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if ordered:
        rows = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange("doc_id", "_at").sortWithinPartitions("doc_id", "_at").select("doc_id", "text")
    return materialize(rows.mapInArrow(write, _MANIFEST), "token-manifest")


def id_type(tokenizer_path: str, end_id: int) -> str:
    """The narrowest of u16 and u32 that holds every id."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def _index(keys: np.ndarray, nulls: np.ndarray, offsets: np.ndarray, width: int) -> bytes:
    known = np.flatnonzero(nulls == 0)
    distinct, first = np.unique(keys[known].astype(np.uint64), return_index=True)
    table = PerfectHash.build(distinct)
    slots, raw = table.slots(distinct), table.to_bytes()
    marks, ordinals = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    marks[slots], ordinals[slots] = fingerprints(distinct), known[first]
    footer = _FOOTER.pack(_MAGIC, width, len(keys), int(offsets[-1]), len(distinct), len(raw))
    return b"".join([offsets.astype("<i8").tobytes(), keys.astype("<i8").tobytes(), nulls.tobytes(), raw, marks.tobytes(), ordinals.tobytes(), footer])


class Shard:
    """One open shard: the index in memory, the payload read by range."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self._file = fs.open_input_file(path)
        size = self._file.size()
        magic, self.width, n, self.n_ids, distinct, hashed = _FOOTER.unpack(read_range(self._file, size - _FOOTER.size, _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        self.dtype = f"<u{self.width}"
        start = self.n_ids * self.width
        raw, at = read_range(self._file, start, size - _FOOTER.size - start), 0
        parts = []
        for kind, count in (("<i8", n + 1), ("<i8", n), ("u1", n), ("u1", hashed), ("<u4", distinct), ("<u4", distinct)):
            parts.append(np.frombuffer(raw, kind, count, at))
            at += parts[-1].nbytes
        self.offsets, self.keys, self.nulls, table, self._marks, self._ordinals = parts
        self._table = PerfectHash.from_bytes(table.tobytes())

    def ordinals(self, keys: np.ndarray) -> np.ndarray:
        """Ordinal of the first document of each key, -1 if the shard has none: hash, then fingerprint."""
        keys = keys.astype(np.uint64)
        if not len(self._marks):
            return np.full(len(keys), -1, dtype=np.int64)
        slots = self._table.slots(keys)
        known = (slots >= 0) & (self._marks[slots] == fingerprints(keys))
        return np.where(known, self._ordinals[slots].astype(np.int64), -1)

    def ids(self, ordinal: int, count: int = 1) -> memoryview:
        """Packed ids of `count` documents from `ordinal` on."""
        start, end = (int(self.offsets[k]) * self.width for k in (ordinal, ordinal + count))
        return memoryview(read_range(self._file, start, end - start))


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with `start`, the ids in all shards before; its single window holds one row per shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_digests(manifest: DataFrame) -> DataFrame:
    """Read every shard back: doc_id, start, n_tokens, ids_crc32 of each document, found through the index.

    Runs of documents are range-read in chunks of a few MB. Every non-null key is looked up in the hash, and its
    documents are taken from the ordinal that it gives.
    """

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(uri)
                n = len(shard.keys)
                order = np.arange(n)
                known = shard.nulls == 0
                heads = shard.ordinals(shard.keys[known])
                if (heads < 0).any() or (shard.keys[heads] != shard.keys[known]).any():
                    raise ValueError(f"{uri}: index and keys disagree")
                order[known] = heads + (np.arange(n)[known] - np.searchsorted(shard.keys[known], shard.keys[known]) - int(np.sum(~known)))
                sizes, crcs, step = np.diff(shard.offsets), np.empty(n, dtype=np.int64), 256
                for a in range(0, n, step):
                    b = min(n, a + step)
                    wide = memoryview(np.frombuffer(shard.ids(a, b - a), shard.dtype).astype("<u4").view(np.uint8))
                    bounds = 4 * (shard.offsets[a : b + 1] - shard.offsets[a])
                    for k in range(a, b):
                        crcs[k] = zlib.crc32(wide[bounds[k - a] : bounds[k - a + 1]])
                at = order
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(shard.keys[at], pa.int64(), mask=~known[at]),
                        "start": pa.array(shard.offsets[at] + start, pa.int64()),
                        "n_tokens": pa.array(sizes[at], pa.int64()),
                        "ids_crc32": pa.array(crcs[at], pa.int64()),
                    }
                )

    placed = spread(with_starts(manifest).select("path", "start"))
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def spread(rows: DataFrame) -> DataFrame:
    """A row per file to a task per file, or nearly."""
    spark = rows.sparkSession
    return rows.repartition(max(1, min(rows.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))), F.col(rows.columns[0]))


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """Keyed access: doc_id and ids (array<long>) of each document whose doc_id is among `keys` (column doc_id).

    Keys meet the shards whose key range holds them in a join on buckets of keys, whose borders are quantiles of the
    shards' first keys; then each is one hash probe and one range read. Keys that no shard holds, and null keys, give
    no row; a repeated key gives its documents once for each repeat.
    """

    def probe(rows):
        for part in rows:
            for uri, own in part.groupby("path"):
                shard = Shard(uri)
                out = []
                for key, at in zip(own["doc_id"], shard.ordinals(own["doc_id"].to_numpy(np.int64)), strict=True):
                    while 0 <= at < len(shard.keys) and shard.keys[at] == key and not shard.nulls[at]:
                        out.append((key, np.frombuffer(shard.ids(at), shard.dtype).astype(np.int64)))
                        at += 1
                yield pd.DataFrame(out, columns=["doc_id", "ids"])

    ranges = manifest.where("first_key is not null").select("path", "first_key", "last_key")
    borders = ranges.agg(F.percentile_approx("first_key", [k / KEY_BUCKETS for k in range(1, KEY_BUCKETS)], 100 * KEY_BUCKETS).alias("b")).first().b
    borders = np.unique(np.array(borders or [], dtype=np.int64))

    @F.pandas_udf("long")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, key.to_numpy(np.int64), side="right"))

    within = ranges.withColumn("bucket", F.explode(F.sequence(bucket("first_key"), bucket("last_key"))))
    own = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").withColumn("bucket", bucket("doc_id"))
    hit = own.join(within, "bucket").where(F.col("doc_id").between(F.col("first_key"), F.col("last_key")))
    return hit.select("path", "doc_id").repartition("path").mapInPandas(probe, "doc_id long, ids array<long>")


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write a store from `docs` and return what reading its files back gives (see read_digests)."""
    return read_digests(write_store(docs, tokenizer_path, end_id))
