"""Removal of repeated passages: every word that a window of words covers which stands earlier, too.

Difference-cover anchors: positions of a document whose remainder modulo a period lies in a difference cover. Wherever two
equal windows stand, some distance from their starts reaches such a position in both, so both hold an equal anchor, a
shorter run of words hashed only there. Anchors that occur once rule out the windows around them. The others are extended:
the windows that hold one are hashed whole (128 bits) and the earliest of equal ones is found.

Both exchanges work alike. Tasks gather entries, keep one of equal ones, and deal them out by hash in blocks (`Entries`);
a bucket meets one entry a block for the hottest passage, and answers with runs per document. Buckets grow in number with
the text. Texts are shuffled twice, by id and mark, to meet the answers; no group of copies comes together anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Bytes of a text whose words are held as objects at once.
_SLICE = 1 << 22
#: Entries that a task gathers before it deals them out, and entries that a bucket is meant to hold.
_FLUSH, _BUCKET = 1_000_000, 4_000_000
_BLOCK = "bucket int, keys binary, known binary, id binary, none binary, mark binary, pos binary"
_ANSWER = "id long, mark long, at array<long>"
_FIELDS = (("id", np.int64), ("none", np.uint8), ("mark", np.int64), ("pos", np.int64))


def slices(raw: bytes, size: int = _SLICE) -> Iterator[bytes]:
    """`raw` in pieces of about `size` bytes that end between words."""
    at = 0
    while at < len(raw):
        to = min(len(raw), at + size)
        while to < len(raw) and raw[to] not in b" \t\n\x0b\x0c\r":
            to += 1
        yield raw[at:to]
        at = to


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word; bytes.split() parts at exactly the ASCII white space."""
    made = [np.array(list(map(xxhash.xxh3_64_intdigest, part.split())), dtype=np.uint64) for part in slices(raw)]
    return made[0] if len(made) == 1 else np.concatenate(made) if made else np.zeros(0, np.uint64)


def _multipliers(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers drawn by a rule."""
    return np.array([xxhash.xxh3_64_intdigest(f"{seed}:{k}") | 1 for k in range(n)], dtype=np.uint64)


def run_hashes(words: np.ndarray, at: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hashes of the `width` words from each position of `at`."""
    out, by = np.zeros(len(at), dtype=np.uint64), _multipliers(seed, width)
    for k in range(width):
        out += words[at + k] * by[k]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0x9E3779B97F4A7C15)


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    """Whether the differences of `cover` reach every remainder of `period`."""
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _packed(x: np.ndarray) -> bytes:
    """Numbers as compressed steps from one to the next."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(x, prepend=x.dtype.type(0)).tobytes())


def _unpacked(raw: bytes, kind) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind), dtype=kind)


class Entries:
    """Entries that one task has gathered: keys (a row each), and the id, mark and position that each belongs to."""

    def __init__(self, width: int, buckets: int):
        self.width, self.buckets, self.parts, self.n = width, buckets, [], 0

    def add(self, keys: np.ndarray, **fields: np.ndarray) -> None:
        self.parts.append((keys, fields))
        self.n += len(keys)

    def take(self) -> tuple[np.ndarray, dict]:
        keys = np.concatenate([k for k, _ in self.parts]) if self.parts else np.zeros((0, self.width), np.uint64)
        fields = {c: np.concatenate([f[c] for _, f in self.parts]) if self.parts else np.zeros(0, kind) for c, kind in _FIELDS}
        self.parts, self.n = [], 0
        return keys, fields

    def blocks(self, keys: np.ndarray, fields: dict, known: np.ndarray | None = None) -> dict:
        """Columns of a block for each bucket: entries in the order they were gathered, and keys that need no answer."""
        out = {c: [] for c in ("bucket", "keys", "known", *fields)}
        of = lambda k: (k[:, 0] >> np.uint64(20)) % np.uint64(self.buckets)
        known = np.zeros((0, self.width), np.uint64) if known is None else known
        order, own, known_of = np.argsort(of(keys), kind="stable"), of(keys), of(known)
        edges = np.searchsorted(own[order], np.arange(self.buckets + 1, dtype=np.uint64))
        known_order = np.argsort(known_of, kind="stable")
        known_edges = np.searchsorted(known_of[known_order], np.arange(self.buckets + 1, dtype=np.uint64))
        for b in range(self.buckets):
            at, others = order[edges[b] : edges[b + 1]], known_order[known_edges[b] : known_edges[b + 1]]
            if len(at) or len(others):
                self._put(out, b, keys[at], known[others], {c: v[at] for c, v in fields.items()})
        return out

    def decided(self, fields: dict) -> dict:
        """A block of entries whose answer the task knows itself (bucket -1)."""
        out = {c: [] for c in ("bucket", "keys", "known", *fields)}
        if len(fields["pos"]):
            none = np.zeros((0, self.width), np.uint64)
            self._put(out, -1, none, none, fields)
        return out

    @staticmethod
    def _put(out: dict, bucket: int, keys: np.ndarray, known: np.ndarray, fields: dict) -> None:
        out["bucket"].append(bucket)
        out["keys"].append(np.ascontiguousarray(keys).tobytes())
        out["known"].append(np.ascontiguousarray(known).tobytes())
        for c, v in fields.items():
            out[c].append(_packed(v))


def _batch(columns: dict):
    import pyarrow as pa

    kinds = {"bucket": pa.int32()}
    return pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.binary())) for c, v in columns.items()})


def _fields_of(table) -> tuple[dict, np.ndarray]:
    """Fields of the entries of several blocks, and how many each block has."""
    made = {c: [_unpacked(x, kind) for x in table.column(c).to_pylist()] for c, kind in _FIELDS}
    sizes = np.array([len(x) for x in made["pos"]], dtype=np.int64)
    return {c: np.concatenate(v) if v else np.zeros(0, kind) for (c, kind), v in zip(_FIELDS, made.values(), strict=True)}, sizes


def _keys_of(table, column: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), np.uint64).reshape(-1, width)


def _answer(fields: dict):
    """Rows of _ANSWER: one for each run of entries of one document."""
    import pyarrow as pa

    n = len(fields["pos"])
    new = np.ones(n, dtype=bool)
    for c in ("id", "none", "mark"):
        new[1:] &= fields[c][1:] == fields[c][:-1]
    new[1:] = ~new[1:]
    first = np.flatnonzero(new)
    offsets = pa.array(np.append(first, n).astype(np.int32), pa.int32())
    ids = pa.array(fields["id"][first], pa.int64(), mask=fields["none"][first] > 0)
    at = pa.ListArray.from_arrays(offsets, pa.array(fields["pos"], pa.int64()))
    return [ids, pa.array(fields["mark"][first], pa.int64()), at]


def _answers(blocks: DataFrame, decide) -> DataFrame:
    """Answers of all buckets and of the tasks themselves, gathered per document: id, mark, at."""
    import pyarrow as pa

    names = ["id", "mark", "at"]

    def judged(table: pa.Table) -> pa.Table:
        return pa.Table.from_arrays(_answer(decide(table)), names)

    def known(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                fields, _ = _fields_of(batch.slice(k, 1))
                yield pa.RecordBatch.from_arrays(_answer(fields), names)

    asked = blocks.where("bucket >= 0").groupBy("bucket").applyInArrow(judged, _ANSWER)
    rows = asked.unionByName(blocks.where("bucket < 0").mapInArrow(known, _ANSWER))
    return rows.groupBy(F.col("id").alias("_i"), F.col("mark").alias("_m")).agg(F.flatten(F.collect_list("at")).alias("at"))


def _texts(batch, size: int = 512) -> Iterator[tuple]:
    """(ids, null flags, marks, texts, other column) of a few rows at a time."""
    for low in range(0, batch.num_rows, size):
        part = batch.slice(low, size)
        none = np.asarray(part.column(0).is_null()).astype(np.uint8)
        ids = np.asarray(part.column(0).fill_null(0)).astype(np.int64)
        yield ids, none, np.asarray(part.column(1)).astype(np.int64), part.column(2).to_pylist(), part.column(3) if part.num_columns > 3 else None


def _laid_out(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all words, words of each text, place of each word in its text)."""
    made = [word_hashes(t or b"") for t in texts]
    sizes = np.array([len(h) for h in made], dtype=np.int64)
    words = np.concatenate(made) if made else np.zeros(0, np.uint64)
    return words, sizes, np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _anchor_blocks(docs: DataFrame, window: int, period: int, cover: tuple[int, ...], buckets: int) -> DataFrame:
    """Blocks of anchors; of anchors that a task holds more than once, all places are decided by the task."""
    width = window - period + 1
    in_cover = np.isin(np.arange(period), cover)

    def gather(batches):
        entries = Entries(1, buckets)

        def flush():
            keys, fields = entries.take()
            order = np.argsort(keys[:, 0], kind="stable")
            same = keys[order[1:], 0] == keys[order[:-1], 0]
            repeated = np.zeros(len(keys), dtype=bool)
            repeated[order[1:]] |= same
            repeated[order[:-1]] |= same
            yield _batch(entries.blocks(keys[~repeated], {c: v[~repeated] for c, v in fields.items()}, np.unique(keys[repeated])[:, None]))
            yield _batch(entries.decided({c: v[repeated] for c, v in fields.items()}))

        for batch in batches:
            for ids, none, marks, texts, _ in _texts(batch):
                words, sizes, place = _laid_out(texts)
                at = np.flatnonzero(in_cover[place % period] & (place + window <= np.repeat(sizes, sizes) + period - 1))
                doc = np.repeat(np.arange(len(texts)), sizes)[at]
                entries.add(run_hashes(words, at, width, 1)[:, None], id=ids[doc], none=none[doc], mark=marks[doc], pos=place[at])
                if entries.n >= _FLUSH:
                    yield from flush()
        yield from flush()

    return docs.select("id", "mark", "raw").mapInArrow(gather, _BLOCK)


def _repeated_anchors(table) -> dict:
    """Entries whose key another block holds, too; within a block keys differ."""
    keys, known = _keys_of(table, "keys", 1)[:, 0], _keys_of(table, "known", 1)[:, 0]
    fields, _ = _fields_of(table)
    whole = np.concatenate((keys, known))
    order = np.argsort(whole, kind="stable")
    same = whole[order[1:]] == whole[order[:-1]]
    hit = np.zeros(len(whole), dtype=bool)
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    return {c: v[hit[: len(keys)]] for c, v in fields.items()}


def _judged(keys: np.ndarray, fields: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, whether an entry stands later than an equal one, whether it repeats the entry before it), both in that order.

    Entries are ordered by key, then null ids last, id, position, mark. Equal ids and positions are neither earlier.
    """
    order = np.lexsort((fields["mark"], fields["pos"], fields["id"], fields["none"], *keys.T[::-1]))
    k = keys[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (k[1:] != k[:-1]).any(axis=1)
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else order
    later = np.zeros(len(order), dtype=bool)
    for c in ("none", "id", "pos"):
        v = fields[c][order]
        later |= v != v[head]
    mark = fields["mark"][order]
    again = ~new & ~later
    again[1:] &= mark[1:] == mark[:-1]
    return order, later, again


def _window_blocks(docs: DataFrame, window: int, period: int, buckets: int) -> DataFrame:
    """Blocks of the windows that hold a repeated anchor (docs: id, mark, raw, at); all but a task's first ones are decided."""
    width = window - period + 1

    def gather(batches):
        entries = Entries(2, buckets)

        def flush():
            keys, fields = entries.take()
            order, later, again = _judged(keys, fields)
            ask, gone = np.sort(order[~later & ~again]), np.sort(order[later])
            yield _batch(entries.blocks(keys[ask], {c: v[ask] for c, v in fields.items()}))
            yield _batch(entries.decided({c: v[gone] for c, v in fields.items()}))

        for batch in batches:
            for ids, none, marks, texts, anchors in _texts(batch):
                words, sizes, place = _laid_out(texts)
                starts = np.cumsum(sizes) - sizes
                counts = np.asarray(anchors.value_lengths().fill_null(0))
                at = np.asarray(anchors.flatten()) + np.repeat(starts, counts)
                # A window that holds an anchor of `width` words from q on starts at q + width - window to q.
                edge = np.zeros(len(words) + 1, dtype=np.int32)
                np.add.at(edge, np.maximum(at + width - window, np.repeat(starts, counts)), 1)
                np.add.at(edge, at + 1, -1)
                chosen = np.flatnonzero((np.cumsum(edge)[:-1] > 0) & (place + window <= np.repeat(sizes, sizes)))
                doc = np.repeat(np.arange(len(texts)), sizes)[chosen]
                keys = np.stack((run_hashes(words, chosen, window, 2), run_hashes(words, chosen, window, 3)), axis=1)
                entries.add(keys, id=ids[doc], none=none[doc], mark=marks[doc], pos=place[chosen])
                if entries.n >= _FLUSH:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(gather, _BLOCK)


def _later_windows(table) -> dict:
    keys = _keys_of(table, "keys", 2)
    fields, _ = _fields_of(table)
    order, later, _ = _judged(keys, fields)
    gone = np.sort(order[later])
    return {c: v[gone] for c, v in fields.items()}


def _kept_words(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the text that is left) of docs (id, mark, raw, at: windows that go)."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            rows = {c: [] for c in ("n_words", "n_removed", "kept_sha256", "kept")}
            for raw, starts in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                gone, kept, done = (np.sort(starts.values.to_numpy()) if starts.is_valid else np.zeros(0, np.int64)), [], 0
                n = 0
                for part in slices(raw or b""):
                    words = part.split()
                    if len(gone):
                        # The windows that reach into this part of the text.
                        near = gone[np.searchsorted(gone, n - window, side="right") : np.searchsorted(gone, n + len(words))]
                        edge = np.zeros(len(words) + 1, dtype=np.int64)
                        np.add.at(edge, np.maximum(near - n, 0), 1)
                        np.add.at(edge, np.minimum(near - n + window, len(words)), -1)
                        left = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                        kept.append(b" ".join([words[i] for i in left.tolist()]))
                        done += len(words) - len(left)
                    else:
                        kept.append(b" ".join(words))
                    n += len(words)
                text = b" ".join(k for k in kept if k)
                for c, v in zip(rows, (n, done, hashlib.sha256(text).hexdigest(), text), strict=True):
                    rows[c].append(v)
            made = [pa.array(rows["n_words"], pa.int64()), pa.array(rows["n_removed"], pa.int64()), pa.array(rows["kept_sha256"], pa.string()), pa.array(rows["kept"], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", *rows])

    return docs.select("id", "mark", "raw", "at").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")


def remove_repeats(table: DataFrame, id_column: str = "doc_id", text: str = "text", *, window: int = 20, period: int = 13, cover: tuple[int, ...] = (0, 1, 3, 9)) -> DataFrame:
    """Every document without the words that an earlier window of `window` words covers, a row each.

    doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by one space). A window goes if the same
    words also start earlier: in a document with a smaller id, or in the same one before. Windows are judged on the input.
    Null and empty texts have no words; texts of fewer words than a window stay whole. Null ids come after all others and
    count as one document, as do rows that repeat an id: at equal positions none of them is earlier, so repeated rows keep
    the same words. Other columns are ignored; an empty table gives no rows. Texts of any length, whose words are held as
    objects a slice at a time. Windows count as equal if two 64-bit sums over the words' hashes agree.
    """
    if not is_cover(cover, period) or period > window:
        raise ValueError("the period's difference cover must reach every remainder, and a window hold a whole period")
    spark = table.sparkSession
    docs = table.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("mark"), F.col(text).cast("binary").alias("raw"))
    size = docs.agg(F.sum(F.octet_length("raw")).alias("n")).collect()[0]["n"] or 0
    buckets = max(4 * spark.sparkContext.defaultParallelism, size // (6 * _BUCKET))
    meet = F.col("id").eqNullSafe(F.col("_i")) & (F.col("mark") == F.col("_m"))
    blocks = materialize(_anchor_blocks(docs, window, period, cover, buckets), "dedup-anchors")
    anchors = materialize(_answers(blocks, _repeated_anchors), "dedup-repeated")
    discard(blocks)
    held = docs.join(anchors, meet).select("id", "mark", "raw", "at")
    blocks = materialize(_window_blocks(held, window, period, buckets), "dedup-windows")
    discard(anchors)
    later = materialize(_answers(blocks, _later_windows), "dedup-later")
    discard(blocks)
    return _kept_words(docs.join(later, meet, "left").select("id", "mark", "raw", "at"), window)
