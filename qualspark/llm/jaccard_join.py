"""Exact Jaccard self-join of word-shingle sets with adaptive multi-match prefixes, down to its components.

Two sets that link have at least `need` = ceil(t * size) shingles in common. So under any order that all documents
share and for any l, their prefixes of size - need + l share at least l shingles. This is used twice:

1. Screening. Shingles in the order of their hashes, and a window of l more matches, l growing with the set. A document
   whose window holds fewer shingles that any other window holds cannot link, and leaves. Most texts end here.
2. Joining what is left in the order of rising document frequency, so that shared passages come last and the shingles
   of one document alone first. Each document lengthens its prefix by the estimated cost of its candidates: from the
   shortest prefix on it may ask for more matches (MATCHES), if fewer candidates save more than longer lists cost. A
   pair is verified only if it shares as many prefix shingles as the less demanding of the two asks for.

Shingles move between tasks as packed runs, one entry for each chunk of documents and shingle, however many documents
of the chunk hold it: a shingle that a third of all documents hold is as many entries as there are chunks.

Identical sets are one node. To emit no square of a family's size, nodes are first verified against one hub for each
posted shingle, in rounds, with the hub of the largest component from the second on. Then, on each list, the nodes
outside its largest component meet all others of the list, without pairs that already are in one component, whose sizes
differ too much, or whose bitmaps (parities of hashed shingles) prove too many differences; all of these are tested
inside the join. A family that is one component is never compared with itself. Intersections are counted on whole sets.
No cap on partners, lists or candidates; keys with many rows are dealt over several tasks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, sized_broadcast
from .components import connected_components
from .shingles import shingle_set

#: Matches that a document may ask for.
MATCHES = (1, 2, 3, 5, 8, 13)
#: What verifying one candidate costs, in postings read; few are left once sizes and bitmaps are compared.
VERIFY = 10
#: Rows up to which the ids of candidate nodes are broadcast; above, the join is shuffled.
BROADCAST_ROWS = 2_000_000
#: A chunk of documents ends at so many shingles or documents.
CHUNK_SHINGLES, CHUNK_DOCS = 1 << 20, 60_000
#: Rounds of hubs at most, and the share of the first round's links below which a round is the last.
ROUNDS, FEW = 6, 0.05
#: Longs in a node's bitmap.
BITMAP = 8
#: Rows of one key that meet a hub or a set in one task, and rows a side of a list that meet in one; more are dealt in parts.
HOT, LIST = 50_000, 4_000
#: Bytes of text for each range of shingles at least; there are as many ranges as partitions, or more if texts are many.
RANGE_TEXT = 64 << 20
_SHARED = 0xFFFF
_MIX = np.uint64(0x9FB21C651E98DF25)


def _need(n, num: int, den: int):
    return (n * num + den - 1) // den


def _window(n: int, num: int, den: int) -> tuple[int, int]:
    """(length, matches) of the screening window of a set of n shingles; both grow with n."""
    plain = n - _need(n, num, den) + 1
    length = min(n, plain + (plain + 1) // 2 + 4)
    return length, length - plain + 1


class _Chunk:
    """Shingles of some documents, packed for an exchange by ranges of shingles."""

    def __init__(self, number: int, ranges: int):
        self.number, self.ranges, self.size = number, ranges, 0
        self.rows: list[tuple] = []
        self._tokens: list[np.ndarray] = []
        self._docs: list[int] = []

    def add(self, tokens: np.ndarray) -> None:
        """Shingles of the row that was appended last."""
        self._tokens.append(tokens)
        self._docs.append(len(self.rows) - 1)
        self.size += len(tokens)

    def full(self) -> bool:
        return self.size >= CHUNK_SHINGLES or len(self.rows) >= CHUNK_DOCS

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct shingles in order, how many documents hold each, one of these, shingles of each document that another here holds)."""
        tokens = np.concatenate([np.zeros(0, np.uint64), *self._tokens])
        docs = np.repeat(np.array(self._docs, dtype=np.int64), np.array([len(t) for t in self._tokens], dtype=np.int64))
        order = np.argsort(tokens)
        tokens, docs = tokens[order], docs[order]
        start = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, np.int64)
        held = np.diff(np.r_[start, len(tokens)])
        met = np.bincount(docs[np.repeat(held > 1, held)], minlength=len(self.rows))
        return tokens[start], held, docs[start], met

    def runs(self, tokens: np.ndarray):
        """(range, places in `tokens`) of each range that holds any; ranges are of mixed hashes, as windows hold small ones."""
        mixed = (tokens * _MIX) >> np.uint64(32)
        own = (mixed * np.uint64(self.ranges)) >> np.uint64(32)
        order = np.argsort(own, kind="stable")
        own = own[order]
        cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
        return [(int(own[a]), order[a:b]) for a, b in zip(cut, np.r_[cut[1:], len(own)])]


def _ranges(docs: DataFrame) -> int:
    """Ranges of shingles: what a task holds of one is bounded whatever the texts' number."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE_TEXT)


def _dealt_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, by: str) -> DataFrame:
    """`left` joined with `right`, a row for each `key`. Rows of the keys that `hot` (key, deals) names are dealt by `by`."""
    if hot.isEmpty():
        return left.join(right, key)
    hot = sized_broadcast(hot, BROADCAST_ROWS)
    dealt = left.join(hot, key, "left").withColumn("deal", F.coalesce(F.pmod(F.xxhash64(by), "deals"), F.lit(0))).drop("deals")
    copies = right.join(hot, key, "left").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("deals", F.lit(1)) - 1))).drop("deals")
    return dealt.join(copies, [key, "deal"]).drop("deal")


def _deals(rows: str, most: int) -> Column:
    return F.ceil(F.col(rows) / most).cast("long")


def _joined(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def shingle_windows(docs: DataFrame, width: int, num: int, den: int, ranges: int) -> DataFrame:
    """Screening windows, two kinds of rows.

    Of documents (range null): doc_id, mark (hash of the text), n_shingles, node (null for an empty set), chunk, number
    in the chunk, met (window shingles that other sets of the chunk hold; null for copies in the chunk).
    Of runs: range, chunk, tokens (u64), docs (u16: number, or _SHARED if several of the chunk hold the shingle).
    """
    kinds = [("doc_id", "long"), ("mark", "long"), ("n_shingles", "long"), ("node", "long"), ("number", "int"), ("met", "int")]

    def sets(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        longs = {"range": pa.int32(), "chunk": pa.int64(), "tokens": pa.binary(), "docs": pa.binary()} | {k: pa.int64() if t == "long" else pa.int32() for k, t in kinds}
        out = lambda **columns: pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(len(columns["chunk"]), t) for k, t in longs.items()], names=list(longs))

        def flush(chunk: _Chunk):
            tokens, held, docs, met = chunk.distinct()
            ids, marks, sizes, nodes, own = zip(*chunk.rows, strict=True)
            n = len(chunk.rows)
            yield out(chunk=pa.array([chunk.number] * n, pa.int64()), doc_id=pa.array(ids, pa.int64()), mark=pa.array(marks, pa.int64()), n_shingles=pa.array(sizes, pa.int64()), node=pa.array(nodes, pa.int64()), number=pa.array(range(n), pa.int32()), met=pa.array(met, pa.int32(), mask=~np.array(own)))
            number, runs = np.where(held > 1, _SHARED, docs).astype("<u2"), chunk.runs(tokens)
            if runs:
                yield out(range=pa.array([r for r, _ in runs], pa.int32()), chunk=pa.array([chunk.number] * len(runs), pa.int64()), tokens=pa.array([tokens[at].tobytes() for _, at in runs], pa.binary()), docs=pa.array([number[at].tobytes() for _, at in runs], pa.binary()))

        chunk, seen = _Chunk(first, ranges), set()
        for batch in batches:
            for doc_id, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = shingle_set(text.as_py(), width)
                n = len(own)
                node = xxhash.xxh3_64_intdigest(own.tobytes()) - 2**63 if n else None
                new = n > 0 and node not in seen
                chunk.rows.append((doc_id, mark, n, node, new))
                if new:
                    seen.add(node)
                    chunk.add(own[: _window(n, num, den)[0]])
                if chunk.full():
                    yield from flush(chunk)
                    chunk, seen = _Chunk(chunk.number + 1, ranges), set()
        if chunk.rows:
            yield from flush(chunk)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(sets, "range int, chunk long, tokens binary, docs binary, " + ", ".join(f"{k} {t}" for k, t in kinds))


def _met_elsewhere(runs: DataFrame) -> DataFrame:
    """chunk, number, elsewhere: window shingles of a document that other chunks hold, found a range of shingles at a time."""

    def meet(table):
        import pyarrow as pa

        tokens, docs = _joined(table["tokens"], "<u8"), _joined(table["docs"], "<u2")
        chunks, own = np.unique(table["chunk"].to_numpy(), return_inverse=True)
        own = np.repeat(own, [len(x.as_py()) // 8 for x in table["tokens"]])
        order = np.argsort(tokens)
        same = tokens[order][1:] == tokens[order][:-1]
        shared = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
        shared = shared[docs[shared] != _SHARED]
        shared = shared[np.argsort(own[shared], kind="stable")]
        bounds = np.searchsorted(own[shared], np.arange(len(chunks) + 1))
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "docs": pa.array([docs[shared[a:b]].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())})

    def add(table):
        import pyarrow as pa

        met = np.bincount(_joined(table["docs"], "<u2"), minlength=1)
        held = np.flatnonzero(met)
        return pa.table({"chunk": pa.array([table["chunk"][0].as_py()] * len(held), pa.int64()), "number": pa.array(held, pa.int32()), "elsewhere": pa.array(met[held], pa.int32())})

    found = runs.select("range", "chunk", "tokens", "docs").groupBy("range").applyInArrow(meet, "chunk long, docs binary")
    return found.where("octet_length(docs) > 0").groupBy("chunk").applyInArrow(add, "chunk long, number int, elsewhere int")


def _screened(windows: DataFrame, num: int, den: int) -> DataFrame:
    """node, doc_id, mark, again: the sets that may link, with a row that holds each, and whether rows repeat its doc_id and text."""
    met = _met_elsewhere(windows.where("range is not null"))
    rows = windows.where("range is null and node is not null").select("doc_id", "mark", "n_shingles", "node", "chunk", "number", "met").join(met, ["chunk", "number"], "left")
    # The partner may be as small as t * n, and its window may ask for less.
    n = F.floor((F.col("n_shingles") * num + (den - 1)) / den)
    plain = n - F.floor((n * num + (den - 1)) / den) + 1
    least = F.least(n - plain, F.floor((plain + 1) / 2) + 4) + 1
    alike = rows.groupBy("node", "doc_id", "mark").agg(F.count("*").alias("n"), F.max(F.col("met") + F.coalesce("elsewhere", F.lit(0)) >= least).alias("may"))
    return alike.groupBy("node").agg(F.min(F.struct("doc_id", "mark", "n")).alias("rep"), F.max("may").alias("may")).where("may").select("node", "rep.doc_id", "rep.mark", (F.col("rep.n") > 1).alias("again"))


def _whole_sets(docs: DataFrame, wanted: DataFrame, width: int, ranges: int) -> DataFrame:
    """Whole sets of the `wanted` nodes, two kinds of rows.

    Of nodes (range null): node, chunk, n, own (shingles, u64), bits (the bitmap). Of runs: range, chunk, tokens (u64),
    held (u16: documents of the chunk that hold each).
    """

    def sets(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        types = {"range": pa.int32(), "chunk": pa.int64(), "tokens": pa.binary(), "held": pa.binary(), "node": pa.int64(), "n": pa.int32(), "own": pa.list_(pa.int64()), "bits": pa.list_(pa.int64())}
        out = lambda **columns: pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(len(columns["chunk"]), t) for k, t in types.items()], names=list(types))

        def flush(chunk: _Chunk):
            tokens, held, _, _ = chunk.distinct()
            nodes, own = zip(*chunk.rows, strict=True)
            longs = lambda arrays: pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), np.concatenate(arrays).view(np.int64))
            yield out(chunk=pa.array([chunk.number] * len(nodes), pa.int64()), node=pa.array(nodes, pa.int64()), n=pa.array([len(x) for x in own], pa.int32()), own=longs(own), bits=longs([_bitmap(x) for x in own]))
            held, runs = held.astype("<u2"), chunk.runs(tokens)
            yield out(range=pa.array([r for r, _ in runs], pa.int32()), chunk=pa.array([chunk.number] * len(runs), pa.int64()), tokens=pa.array([tokens[at].tobytes() for _, at in runs], pa.binary()), held=pa.array([held[at].tobytes() for _, at in runs], pa.binary()))

        chunk = _Chunk(first, ranges)
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = shingle_set(text.as_py(), width)
                chunk.rows.append((node, own))
                chunk.add(own)
                if chunk.full():
                    yield from flush(chunk)
                    chunk = _Chunk(chunk.number + 1, ranges)
        if chunk.rows:
            yield from flush(chunk)

    # A set may be held by rows with a null doc_id only.
    named = wanted.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("node").alias("_node"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_m"), F.col("text").cast("binary").alias("text"))
    rows = rows.join(sized_broadcast(named, BROADCAST_ROWS), F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_m") == F.col("_mark"))).select("_node", "text")
    if not wanted.where("again").isEmpty():
        rows = rows.dropDuplicates(["_node"])
    return rows.mapInArrow(sets, "range int, chunk long, tokens binary, held binary, node long, n int, own array<long>, bits array<long>")


def _bitmap(own: np.ndarray) -> np.ndarray:
    odd = (np.bincount((own & np.uint64(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def _frequencies(runs: DataFrame) -> DataFrame:
    """chunk, tokens, often: shingles that two sets or more hold, for each chunk that holds them, and how many do."""

    def count(table):
        import pyarrow as pa

        tokens, held = _joined(table["tokens"], "<u8"), _joined(table["held"], "<u2").astype(np.int64)
        chunks, own = np.unique(table["chunk"].to_numpy(), return_inverse=True)
        own = np.repeat(own, [len(x.as_py()) // 8 for x in table["tokens"]])
        _, which = np.unique(tokens, return_inverse=True)
        often = np.bincount(which, held).astype(np.int64)[which] if len(tokens) else held
        kept = np.flatnonzero(often > 1)
        kept = kept[np.argsort(own[kept], kind="stable")]
        bounds = np.searchsorted(own[kept], np.arange(len(chunks) + 1))
        parts = [kept[a:b] for a, b in zip(bounds, bounds[1:])]
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "tokens": pa.array([tokens[p].tobytes() for p in parts], pa.binary()), "often": pa.array([often[p].tobytes() for p in parts], pa.binary())})

    return runs.select("range", "chunk", "tokens", "held").groupBy("range").applyInArrow(count, "chunk long, tokens binary, often binary")


def _posts(nodes: DataFrame, often: DataFrame, num: int, den: int) -> DataFrame:
    """node, n, token, matches, bits for each shingle in the node's prefix that other sets hold; a chunk at a time."""

    def choose(left, right):
        import pyarrow as pa

        known, count = _joined(right["tokens"], "<u8"), _joined(right["often"], "<i8")
        by = np.argsort(known)
        known, count = known[by], count[by]
        sizes = left["n"].to_numpy().astype(np.int64)
        tokens = left["own"].combine_chunks().flatten().to_numpy().view(np.uint64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        at = np.minimum(np.searchsorted(known, tokens), max(0, len(known) - 1))
        held = np.where(known[at] == tokens, count[at], 1) if len(known) else np.ones(len(tokens), np.int64)
        order = np.lexsort((tokens, held, doc))
        tokens, held = tokens[order], held[order]
        first = np.cumsum(sizes) - sizes
        so_far = np.r_[0, np.cumsum(held - 1)]
        shortest = sizes - _need(sizes, num, den)
        costs = []
        for k in MATCHES:
            cost = (so_far[first + np.minimum(shortest + k, sizes)] - so_far[first]) * (1 + VERIFY / k**2)
            costs.append(np.where(shortest + k <= sizes, cost, np.inf))
        choice = np.argmin(np.stack(costs), axis=0) if len(sizes) else np.zeros(0, np.int64)
        matches = np.array(MATCHES)[choice]
        place = np.arange(len(tokens)) - np.repeat(first, sizes)
        taken = np.flatnonzero((place < np.repeat(shortest + matches, sizes)) & (held > 1))
        own = doc[taken]
        pick = lambda name: left[name].combine_chunks().take(pa.array(own))
        return pa.table({"node": pick("node"), "n": pick("n"), "token": pa.array(tokens[taken].view(np.int64)), "matches": pa.array(matches[own], pa.int32()), "bits": pick("bits")})

    return nodes.select("chunk", "node", "n", "own", "bits").groupBy("chunk").cogroup(often.groupBy("chunk")).applyInArrow(choose, "node long, n int, token long, matches int, bits array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of `pairs` (a, b: nodes) whose whole sets reach the threshold, written out."""
    pairs = materialize(pairs, "jaccard-pairs")
    often = lambda c: pairs.groupBy(c).count().where(F.col("count") > HOT).select(c, _deals("count", HOT).alias("deals"))
    left = _dealt_join(pairs, sets.select(F.col("node").alias("a"), F.col("own").alias("own_a")), "a", often("a"), "b")
    both = _dealt_join(left, sets.select(F.col("node").alias("b"), F.col("own").alias("own_b")), "b", often("b"), "a")
    met = both.select("a", "b", F.size(F.array_intersect("own_a", "own_b")).cast("long").alias("met"), (F.size("own_a").cast("long") + F.size("own_b")).alias("total"))
    links = materialize(met.where(F.col("met") * den >= (F.col("total") - F.col("met")) * num).select("a", "b"), "jaccard-links")
    discard(pairs)
    return links


def _merged(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, part: components of all links so far, from those of before and new `links`; nodes without a link have no row."""
    if parts is None:
        return connected_components(links).withColumnRenamed("root", "part")
    of = lambda c: parts.select(F.col("node").alias(c), F.col("part").alias(f"part_{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b"))
    roots = connected_components(ends)
    old = parts.join(roots.withColumnRenamed("node", "part"), "part", "left").select("node", F.coalesce("root", "part").alias("part"))
    # A part is named by a node of its own, so what else has a root is a node that had no link before.
    new = roots.join(parts.select("node"), "node", "left_anti").select("node", F.col("root").alias("part"))
    return materialize(old.unionByName(new), "jaccard-parts")


def _labelled(posts: DataFrame, parts: DataFrame | None) -> DataFrame:
    """`posts` with `part`, the component of its node so far."""
    if parts is None:
        return posts.withColumn("part", F.col("node"))
    return posts.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))


def _may_link(num: int, den: int) -> Column:
    """Of two posts (columns, and those of the other with _b): different components, sizes, and few enough differences in their bitmaps."""
    n, m = F.col("n").cast("long"), F.col("n_b").cast("long")
    met = F.floor(((n + m) * num + (num + den - 1)) / F.lit(num + den))
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.get("bits", F.lit(k)).bitwiseXOR(F.get("bits_b", F.lit(k)))) for k in range(BITMAP)))
    return (F.col("part") != F.col("part_b")) & (n * den >= m * num) & (m * den >= n * num) & (n + m - 2 * met >= apart)


def _across(labelled: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of different components whose lists meet as often as the less demanding of the two asks, a < b.

    Of two nodes in different components at least one is outside the largest component of a list that holds both, so
    those outside meet all. A long list is cut into blocks of its outsiders and of all, and each pair of blocks meets.
    """
    by_part = labelled.groupBy("token", "part").agg(F.count("*").alias("c"))
    lists = by_part.groupBy("token").agg(F.max(F.struct("c", "part")).alias("top"), F.sum("c").alias("posts"), F.count("*").alias("parts")).where("parts > 1")
    lists = lists.select("token", F.col("top.part").alias("top"), "posts", (F.col("posts") - F.col("top.c")).alias("others"))
    crowd = materialize(labelled.join(lists, "token"), "jaccard-lists")
    # Rows of the outsiders' block i and of the block j of all meet in (i, j).
    all_of = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    own = lambda n: F.pmod(F.xxhash64("node"), n)
    i, j = _deals("others", LIST), _deals("posts", LIST)
    outside = crowd.where("part <> top").withColumn("i", own(i)).withColumn("j", F.explode(all_of(j))).drop("posts", "others", "parts", "top")
    everyone = crowd.withColumn("j", own(j)).withColumn("i", F.explode(all_of(i))).select("token", "i", "j", *(F.col(c).alias(f"{c}_b") for c in ("node", "n", "part", "bits", "matches", "top")))
    once = (F.col("part_b") == F.col("top_b")) | (F.col("node") < F.col("node_b"))
    met = outside.join(everyone, ["token", "i", "j"]).where(once & _may_link(num, den))
    met = met.groupBy(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).agg(F.count("*").alias("met"), F.first(F.least("matches", "matches_b")).alias("least"))
    return met.where("met >= least").select("a", "b")


def jaccard_components(docs: DataFrame, *, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Link documents whose shingle sets have den * |intersection| >= num * |union|.

    docs: doc_id long, text string; other columns are ignored. One row per input row: doc_id, n_shingles (set size),
    component_id (smallest doc_id reachable by links, itself included; its own if nothing links), mark (xxhash64 of the text). A null, empty or
    word-less text has an empty set, links with nothing and keeps its own doc_id. Rows that repeat a doc_id are texts
    of their own, each with the component of its text. Rows with a null doc_id link as others do, but a null is no
    component id unless a component has nothing else.
    """
    ranges = _ranges(docs)
    windows = materialize(shingle_windows(docs, width, num, den, ranges), "jaccard-windows")
    wanted = materialize(_screened(windows, num, den), "jaccard-screened")
    rows = materialize(windows.where("range is null").select("doc_id", "mark", "n_shingles", "node"), "jaccard-rows")
    discard(windows)
    whole = materialize(_whole_sets(docs, wanted, width, ranges), "jaccard-sets")
    sets, runs = whole.where("range is null"), whole.where("range is not null")
    posts = materialize(_posts(sets, _frequencies(runs), num, den), "jaccard-posts")

    parts, first = None, 0
    for k in range(ROUNDS):
        labelled = _labelled(posts, parts)
        # Of the largest component on each list, one node drawn for this list and round: a node meets many hubs of its family.
        drawn = F.min_by(F.struct("node", "n", "part", "bits"), F.xxhash64("node", "token", F.lit(k)))
        by_part = labelled.groupBy("token", "part").agg(F.count("*").alias("c"), drawn.alias("h"))
        hubs = by_part.groupBy("token").agg(F.max_by("h", F.struct("c", F.xxhash64("part", "token"))).alias("h"), F.count("*").alias("parts"), F.sum("c").alias("posts")).where("parts > 1")
        hubs = materialize(hubs.select("token", *(F.col(f"h.{c}").alias(f"{c}_b") for c in ("node", "n", "part", "bits")), "posts"), "jaccard-hubs")
        hot = hubs.where(F.col("posts") > HOT).select("token", _deals("posts", HOT).alias("deals"))
        found = _dealt_join(labelled, hubs.drop("posts"), "token", hot, "node").where(_may_link(num, den)).select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()
        links = _verified(found, sets, num, den)
        discard(hubs)
        n = links.count()
        if n:
            parts = _merged(parts, links)
        first = first or n
        if n <= FEW * first:
            break

    # Exact rest: the lists in full, across components only.
    labelled = materialize(_labelled(posts, parts), "jaccard-labelled")
    links = _verified(_across(labelled, num, den), sets, num, den)
    if not links.isEmpty():
        parts = _merged(parts, links)
    discard(labelled, posts, whole, wanted)
    return _named(rows, parts)


def _named(rows: DataFrame, parts: DataFrame | None) -> DataFrame:
    """`rows` with the smallest doc_id of their component."""
    known = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("own"), F.count("*").alias("rows"))
    if parts is None:
        named = known.where("rows > 1").select("node", F.col("own").alias("component_id"))
    else:
        # Only nodes with copies or links are named; a component may be large, so its name is joined, not gathered.
        linked = materialize(known.join(parts, "node", "left").where("rows > 1 or part is not null").select("node", F.coalesce("part", "node").alias("part"), "own"), "jaccard-linked")
        smallest = materialize(linked.groupBy("part").agg(F.min("own").alias("component_id")), "jaccard-smallest")
        named = linked.join(sized_broadcast(smallest, BROADCAST_ROWS), "part").select("node", "component_id")
    named = materialize(named, "jaccard-named")
    return rows.join(sized_broadcast(named, BROADCAST_ROWS), "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "mark")
