"""Phrase collocations: phrases whose words stand together more often than apart, per language.

Three scans of the texts. The first two count hashed words, word pairs and triples in tables of fixed size and keep a bit
for each cell that reaches the least count; no frequent phrase has a cell without its bit, so they only spare work. The
third counts exactly what is left: each task in a HAT-trie of word ids (`hat_trie`), whose largest subtrees are written
out as sorted runs when it grows. Runs are dealt out by language and the first two words of a phrase and merged there.
Counts that reach the least one are rows; cuts and longer phrases meet them in joins on (lang, phrase).
"""

from __future__ import annotations

import heapq
import itertools
import operator
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, sized_broadcast
from .hat_trie import HatTrie
from .substring_dedup import slices

#: Bytes of text whose words are held as objects at once.
_CHUNK = 1 << 21
#: Cells of the hashed counts (words; pairs and triples), as powers of two, and cells that are added up together.
_WORD_BITS, _RUN_BITS, _SLICE_BITS = 24, 26, 20
#: Phrases that a task's trie holds before it writes subtrees out, and words it knows by number.
_HELD, _NAMES = 600_000, 2_000_000
_CELLS = "kind int, slice int, lang string, n long, cells binary, counts binary"
_RUN = "part int, lang string, phrases binary, counts binary"
_MOST = 4
# Every separator of pieces becomes a full stop, a word of its own.
_STOPS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b".........")
_STOP = np.uint64(xxhash.xxh3_64_intdigest(b"."))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def words_of(raw: bytes) -> list[bytes]:
    """Words of a text, A-Z lowered, with b"." between pieces. Only blanks and tabs are left for split() to part at."""
    return raw.lower().translate(_STOPS).replace(b".", b" . ").split()


def word_runs(batch) -> Iterator[tuple[str, list[bytes], int]]:
    """(lang, words, carried) of a batch (lang, raw), some texts at a time; `carried` words were in the run before."""
    by_lang = defaultdict(list)
    for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        by_lang[lang].append(raw or b"")
    for lang, texts in by_lang.items():
        held, size = [], 0
        for raw in texts:
            if held and size + len(raw) > _CHUNK:
                yield lang, words_of(b".".join(held)), 0
                held, size = [], 0
            if len(raw) <= _CHUNK:
                held.append(raw)
                size += len(raw)
                continue
            last: list[bytes] = []
            for part in slices(raw, _CHUNK):
                words = last + words_of(part)
                yield lang, words, len(last)
                last = words[-(_MOST - 1) :]
        if held:
            yield lang, words_of(b".".join(held)), 0


class Hashed:
    """Hashes of a run's words and the cells of its words, pairs and triples, by the place of their first word."""

    def __init__(self, lang: str, words: list[bytes]):
        h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)
        self.word = h != _STOP
        self.h = (h ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))) * _A

    @staticmethod
    def _cell(x: np.ndarray, bits: int) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * _C
        return (x >> np.uint64(64 - bits)).astype(np.int64)

    def words(self) -> np.ndarray:
        return self._cell(self.h, _WORD_BITS)

    def pairs(self, at: np.ndarray) -> np.ndarray:
        return self._cell(self.h[at] * _B + self.h[at + 1], _RUN_BITS)

    def triples(self, at: np.ndarray) -> np.ndarray:
        return self._cell((self.h[at] * _B + self.h[at + 1]) * _B + self.h[at + 2], _RUN_BITS)


class Cells:
    """Counts of hashed cells within one task, no higher than the least count that matters."""

    def __init__(self, bits: int, least: int):
        self.counts, self.least = np.zeros(1 << bits, dtype=np.uint8 if least < 256 else np.uint32), least

    def add(self, cells: np.ndarray) -> None:
        cell, n = np.unique(cells, return_counts=True)
        self.counts[cell] = np.minimum(self.counts[cell] + n, self.least)

    def rows(self, kind: int) -> Iterator[tuple]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for k in range(len(self.counts) >> _SLICE_BITS):
            part = self.counts[k << _SLICE_BITS : (k + 1) << _SLICE_BITS]
            at = np.flatnonzero(part)
            if len(at):
                yield kind, k, None, None, squeeze(np.diff(at, prepend=0).astype(np.uint32).tobytes()), squeeze(part[at].astype(np.uint32).tobytes())


def _row_batch(rows: list[tuple], names: tuple[str, ...], kinds: list):
    import pyarrow as pa

    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], list(names))


def _cells_batch(rows: list[tuple]):
    import pyarrow as pa

    return _row_batch(rows, ("kind", "slice", "lang", "n", "cells", "counts"), [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()])


class Bits:
    """Cells that reach the least count, a bit each; as large as the tables say, whatever the texts."""

    def __init__(self, spark, bits: int, slices_of: dict[int, bytes]):
        empty = bytes(1 << (_SLICE_BITS - 3))
        self.held = spark.sparkContext.broadcast(b"".join(slices_of.get(k, empty) for k in range(1 << (bits - _SLICE_BITS))))

    def has(self, cells: np.ndarray) -> np.ndarray:
        raw = np.frombuffer(self.held.value, dtype=np.uint8)
        return (raw[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 > 0


def _added_up(rows: DataFrame, least: int) -> dict[int, dict[int, bytes]]:
    """Bits of cells by kind and slice: a fixed number of rows of a fixed size."""

    def add(table):
        import pyarrow as pa

        total, plain = np.zeros(1 << _SLICE_BITS, dtype=np.int64), zstandard.ZstdDecompressor().decompress
        for cells, counts in zip(table.column("cells").to_pylist(), table.column("counts").to_pylist(), strict=True):
            total[np.cumsum(np.frombuffer(plain(cells), np.uint32), dtype=np.int64)] += np.frombuffer(plain(counts), np.uint32)
        return pa.Table.from_pydict({"kind": table.column("kind")[:1], "slice": table.column("slice")[:1], "bits": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})

    out: dict[int, dict[int, bytes]] = defaultdict(dict)
    for r in rows.where("kind > 0").groupBy("kind", "slice").applyInArrow(add, "kind int, slice int, bits binary").collect():
        out[r["kind"]][r["slice"]] = bytes(r["bits"])
    return out


def _first_scan(texts: DataFrame, least: int) -> DataFrame:
    """Words of each language (kind 0), cells of words (1) and of pairs (2), a few rows a task."""

    def count(batches):
        n, words, pairs = defaultdict(int), Cells(_WORD_BITS, least), Cells(_RUN_BITS, least)
        for batch in batches:
            for lang, run, carried in word_runs(batch):
                made = Hashed(lang, run)
                new = np.arange(len(run)) >= carried
                n[lang] += int((made.word & new).sum())
                words.add(made.words()[made.word & new])
                pairs.add(made.pairs(np.flatnonzero(made.word[:-1] & made.word[1:] & new[1:])))
        yield _cells_batch([(0, 0, lang, k, None, None) for lang, k in n.items()])
        for row in itertools.chain(words.rows(1), pairs.rows(2)):
            yield _cells_batch([row])

    return texts.mapInArrow(count, _CELLS)


def _linked(made: Hashed, words: Bits, pairs: Bits) -> tuple[np.ndarray, np.ndarray]:
    """(words, pairs by their first word) that may be frequent."""
    known = made.word & words.has(made.words())
    link = np.zeros(len(known), dtype=bool)
    at = np.flatnonzero(known[:-1] & known[1:])
    link[at] = pairs.has(made.pairs(at))
    return known, link


def _second_scan(texts: DataFrame, least: int, words: Bits, pairs: Bits) -> DataFrame:
    """Cells of triples (3) whose pairs may be frequent."""

    def count(batches):
        triples = Cells(_RUN_BITS, least)
        for batch in batches:
            for lang, run, carried in word_runs(batch):
                made = Hashed(lang, run)
                _, link = _linked(made, words, pairs)
                at = np.flatnonzero(link[:-1] & link[1:])
                triples.add(made.triples(at[at + 2 >= carried]))
        for row in triples.rows(3):
            yield _cells_batch([row])

    return texts.mapInArrow(count, _CELLS)


class _Names(dict):
    """Numbers of (lang, word), given in the order they are met."""

    def __init__(self):
        super().__init__()
        self.names: list[tuple[str, bytes]] = []
        self.lang = ""

    def number(self, lang: str, words: Iterator[bytes], n: int) -> np.ndarray:
        self.lang = lang
        return np.fromiter(map(self.setdefault_of, words), dtype=np.int64, count=n)

    def setdefault_of(self, word: bytes) -> int:
        key = (self.lang, word)
        at = self.get(key)
        if at is None:
            at = self[key] = len(self.names)
            self.names.append(key)
        return at


def _phrases(made: Hashed, run: list[bytes], carried: int, lang: str, names: _Names, bits: tuple[Bits, Bits, Bits]) -> Iterator[tuple[list, list]]:
    """(sequences of word numbers, counts) of a run, for each length: phrases that may be frequent, distinct ones."""
    known, link = _linked(made, *bits[:2])
    triple = np.zeros(len(link), dtype=bool)
    at = np.flatnonzero(link[:-1] & link[1:])
    triple[at] = bits[2].has(made.triples(at))
    four = triple.copy()
    four[:-1] &= triple[1:]
    four[-1:] = False
    ids = np.full(len(run), -1, dtype=np.int64)
    at = np.flatnonzero(known)
    ids[at] = names.number(lang, (run[i] for i in at.tolist()), len(at))
    own, n = np.unique(ids[at[at >= carried]], return_counts=True)
    yield [(i,) for i in own.tolist()], n.tolist()
    # A phrase of k words is a known phrase of k - 1 words, by its number, and a word.
    head, columns = ids.copy(), None
    for k, mask in ((2, link), (3, triple), (4, four)):
        at = np.flatnonzero(mask)
        key, place = np.unique(head[at] << 32 | ids[at + k - 1], return_inverse=True)
        first = key >> 32
        columns = [first, key & 0xFFFFFFFF] if columns is None else [*(c[first] for c in columns), key & 0xFFFFFFFF]
        n = np.bincount(place[at + k - 1 >= carried], minlength=len(key))
        held = np.flatnonzero(n)
        yield list(zip(*(c[held].tolist() for c in columns), strict=True)), n[held].tolist()
        head = np.zeros(len(run), dtype=np.int64)
        head[at] = place


def _runs(sequences: Iterator[tuple[tuple, int]], names: list, parts: int):
    """Sequences as sorted runs, one a part and language."""
    import pyarrow as pa

    dealt, squeeze = defaultdict(list), zstandard.ZstdCompressor(level=1).compress
    for sequence, n in sequences:
        lang = names[sequence[0]][0]
        words = [names[i][1] for i in sequence]
        dealt[xxhash.xxh3_64_intdigest(b" ".join(words[:2])) % parts, lang].append((b" ".join(words), n))
    rows = []
    for (part, lang), run in dealt.items():
        run.sort()
        rows.append((part, lang, squeeze(b"\n".join(p for p, _ in run)), np.array([n for _, n in run], dtype="<i8").tobytes()))
    return _row_batch(rows, ("part", "lang", "phrases", "counts"), [pa.int32(), pa.string(), pa.binary(), pa.binary()])


def _third_scan(texts: DataFrame, parts: int, bits: tuple[Bits, Bits, Bits]) -> DataFrame:
    """Sorted runs of phrases of one to four words and their counts."""

    def count(batches):
        trie, names = HatTrie(), _Names()
        for batch in batches:
            for lang, run, carried in word_runs(batch):
                for sequences, counts in _phrases(Hashed(lang, run), run, carried, lang, names, bits):
                    trie.add(sequences, counts)
                if trie.size > _HELD:
                    yield _runs(trie.take(_HELD // 2), names.names, parts)
                if len(names.names) > _NAMES:
                    yield _runs(trie.take(), names.names, parts)
                    names = _Names()
        yield _runs(trie.take(), names.names, parts)

    return texts.mapInArrow(count, _RUN)


def _merged(runs: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, k, f) of phrases that reach the least count, from sorted runs."""

    def merge(table):
        import pyarrow as pa

        plain = zstandard.ZstdDecompressor().decompress
        sorted_runs = [zip(plain(p).split(b"\n"), np.frombuffer(c, "<i8").tolist(), strict=True) for p, c in zip(table.column("phrases").to_pylist(), table.column("counts").to_pylist(), strict=True)]
        phrases, totals = [], []
        for phrase, same in itertools.groupby(heapq.merge(*sorted_runs), key=operator.itemgetter(0)):
            f = sum(n for _, n in same)
            if f >= least:
                phrases.append(phrase)
                totals.append(f)
        lang = table.column("lang")[0].as_py()
        return pa.Table.from_pydict({"lang": pa.array([lang] * len(phrases), pa.string()), "phrase": pa.array(phrases, pa.binary()), "k": pa.array([p.count(b" ") + 1 for p in phrases], pa.int32()), "f": pa.array(totals, pa.int64())})

    return runs.groupBy("part", "lang").applyInArrow(merge, "lang string, phrase binary, k int, f long").select("lang", F.col("phrase").cast("string").alias("phrase"), "k", "f")


def phrase_counts(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(counts of frequent phrases: lang, phrase, k, f; words of each language: lang, n). texts: lang, raw."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("raw")).alias("n")).collect()[0]["n"] or 0
    parts = max(4 * spark.sparkContext.defaultParallelism, size // (1 << 26))
    first = materialize(_first_scan(texts, least), "phrases-cells")
    found = _added_up(first, least)
    words, pairs = Bits(spark, _WORD_BITS, found[1]), Bits(spark, _RUN_BITS, found[2])
    totals = materialize(first.where("kind = 0").groupBy("lang").agg(F.sum("n").alias("n")), "phrases-totals")
    discard(first)
    triples = Bits(spark, _RUN_BITS, _added_up(_second_scan(texts, least, words, pairs), least)[3])
    runs = materialize(_third_scan(texts, parts, (words, pairs, triples)), "phrases-runs")
    counts = materialize(_merged(runs, least), "phrases-counts")
    discard(runs)
    return counts, totals


def _wide(x) -> F.Column:
    return x.cast("decimal(20,0)")


def collocations(table: DataFrame, text: str = "text", lang: str = "lang", *, least: int = 30, top: int = 2000) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lowered, texts split at . , ; : ! ? and line ends into pieces, pieces at blanks and tabs into words. A phrase
    is 2 to 4 words that stand together at least `least` times (a). Each cut of it into two gives l and r, how often the
    parts stand, and floor(2000000 * a / (l + r)); the lowest counts as its score, the first cut at a tie. Phrases within
    a longer one that is at least 80 % as frequent go. Of equal scores the more frequent come first, then the lower
    phrase by its bytes. n counts the language's words. A null language is `und`; null and empty texts hold no words;
    texts are read a slice at a time, so they may have any length; repeated rows all count; other columns are ignored; an
    empty table gives no rows.
    """
    texts = table.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("raw"))
    counts, totals = phrase_counts(texts, least)
    phrases = counts.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cuts = phrases.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k")).alias("rest"))
    of = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    scored = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    scored = scored.withColumn("score", F.expr("2000000BD * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    inner = phrases.where("k > 2").select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("at"))
    around = inner.select("lang", part(F.col("at"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    held = best.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * _wide(F.col("around")) < 80 * _wide(F.col("a"))))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(sized_broadcast(totals, 100_000), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
