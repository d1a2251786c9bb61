"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fitting takes a bounded sample of labelled documents, and all words of these are the terms. How many documents hold
each is counted over all documents. Words that no example holds make a query longer, as words that one document holds,
so cosines are over all words of both texts. Terms whose shares tell the labels apart weigh more; none is left out. The
examples' vectors go into an inverted index of sparse postings that lie in blocks of neighbouring examples, with the
largest weight of each term overall and in each block. A query reads its heaviest terms first, which gives a floor;
the rest is read only in blocks whose bound reaches it. So the k nearest are exact, and the index, bounded by the
sample, is what tasks share.

Votes weigh 1 / (distance + EPSILON), with a prior that a lone far neighbour cannot outvote. A logistic curve, fitted
on votes that leave each example itself out and weighted back to the classes' shares, makes them scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bounds of the sample: examples of either class. Those with the smallest hashes of the id are taken.
MOST_TOXIC, MOST_CLEAN = 2_000, 4_000
#: Standard errors between a term's shares in the classes from which it weighs its contrast's square, not 1.
LEAST_Z = 4.0
NEIGHBOURS, BLOCK, EPSILON, PRIOR_WEIGHT = 12, 64, 0.05, 1.0

_WORD = re.compile(r"[^\W\d_]+")
_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id's digits modulo 3 is 1; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _terms(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def labelled_sample(labels: DataFrame) -> DataFrame:
    """At most MOST_TOXIC + MOST_CLEAN rows (id, toxic) that may be learned from; an id with both labels is toxic."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    most = {1: MOST_TOXIC, 0: MOST_CLEAN}
    parts = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in most.items()]
    return materialize(parts[0].unionByName(parts[1]), "toxic-sample")


def weigh_terms(docs: DataFrame, sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """All terms of the sample, in order, and the weight of each by how far apart its shares in the classes lie."""

    def split(batches):
        import pyarrow as pa

        held = {0: Counter(), 1: Counter()}
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[y].update(set(_terms(text)))
        term = sorted(held[0].keys() | held[1].keys())
        yield pa.RecordBatch.from_pydict({"term": pa.array(term, pa.string()), "a": pa.array([held[1][t] for t in term], pa.int64()), "b": pa.array([held[0][t] for t in term], pa.int64())})

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(sample), "id").select("toxic", "text")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    p, n = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not p or not n:
        return [], np.zeros(0)
    held = texts.mapInArrow(split, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = held.toArrow()  # the words of the sample
    term, a, b = (found.column(c).to_numpy() for c in ("term", "a", "b"))
    order = np.argsort(term)
    a, b = a[order].astype(np.float64), b[order].astype(np.float64)
    share = (a + b + 1) / (p + n + 2)
    z = np.abs(a / p - b / n) / np.sqrt(share * (1 - share) * (1 / p + 1 / n))
    return list(term[order]), np.where((a + b >= 3) & (z >= LEAST_Z), z * z, 1.0)


@cache
def _compressor() -> zstandard.ZstdCompressor:
    """One for each Python worker, which has one thread: making one costs more than a text's counts do."""
    return zstandard.ZstdCompressor(level=1)


def pack(at: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending term numbers, as steps, and their counts, compressed: the counts of all documents are written and dealt once."""
    return _compressor().compress(np.concatenate([np.diff(at, prepend=0), n]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    steps, n = np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(2, -1).astype(np.int64)
    return np.cumsum(steps), n


def term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Sparse counts of each whole text, two kinds of rows.

    Of documents: doc_id, mark (hash of the text), counts (packed term numbers and counts; null if no word is a term),
    far (the sum of (1 + ln count)^2 over words that are no terms). Of tasks (held not null): at, held (documents that
    hold each term).
    """
    shared = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})  # bounded by the sample

    def count(batches):
        import pyarrow as pa

        number, often = shared.value, np.zeros(len(terms), dtype=np.int64)
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        for batch in batches:
            counts, far = [], []
            for text in batch.column(2):
                own, other = {}, 0.0
                for word, times in Counter(_terms(text.as_py())).items():
                    if (k := number.get(word)) is not None:
                        own[k] = times
                    else:
                        other += (1 + math.log(times)) ** 2
                keys = np.array(sorted(own), dtype=np.int64)
                often[keys] += 1
                counts.append(pack(keys, np.array([own[k] for k in keys.tolist()])) if own else None)
                far.append(other)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "mark": batch.column(1), "counts": pa.array(counts, pa.binary()), "far": pa.array(far, pa.float64()), "at": pa.nulls(len(far), ints), "held": pa.nulls(len(far), longs)})
        held = np.flatnonzero(often)
        yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(1, pa.int64()), "mark": pa.nulls(1, pa.int64()), "counts": pa.nulls(1, pa.binary()), "far": pa.nulls(1, pa.float64()), "at": pa.array([held], ints), "held": pa.array([often[held]], longs)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return rows.mapInArrow(count, "doc_id long, mark long, counts binary, far double, at array<int>, held array<long>")


def document_counts(tasks: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term, from the rows of tasks: added up within tasks, then in eight, then here."""

    def add(batches):
        import pyarrow as pa

        often = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            np.add.at(often, batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy())
        held = np.flatnonzero(often)
        yield pa.RecordBatch.from_pydict({"at": pa.array([held], pa.list_(pa.int32())), "held": pa.array([often[held]], pa.list_(pa.int64()))})

    form = "at array<int>, held array<long>"
    parts = tasks.select("at", "held").mapInArrow(add, form).repartition(8).mapInArrow(add, form).toArrow()
    often = np.zeros(n_terms)
    np.add.at(often, parts["at"].combine_chunks().flatten().to_numpy(), parts["held"].combine_chunks().flatten().to_numpy())
    return often


def _vector(at, n, idf: np.ndarray, rest: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    at = np.asarray(at, dtype=np.int64)
    w = (1 + np.log(np.asarray(n, dtype=np.float64))) * idf[at]
    return at, w / np.sqrt(np.sum(w * w) + rest) if len(w) else w


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


class BlockMaxIndex:
    """Inverted index over vectors: sparse postings by term and block of examples, with each term's largest weight overall and in each block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        # Examples with the same heaviest term stand together, so that block bounds are tight.
        self.order = np.array(sorted(range(len(vectors)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]) if len(vectors[i][0]) else n_terms, i)), dtype=np.int64)
        self.n_blocks = -(-len(vectors) // BLOCK)
        sizes = np.array([len(vectors[i][0]) for i in self.order], dtype=np.int64)
        term = np.concatenate([vectors[i][0] for i in self.order] or [np.zeros(0)]).astype(np.int64)
        by = np.argsort(term, kind="stable")  # places stay in order
        term, self.place = term[by], np.repeat(np.arange(len(vectors)), sizes)[by]
        self.weight = np.concatenate([vectors[i][1] for i in self.order] or [np.zeros(0)]).astype(np.float64)[by]
        # An entry is a term's postings in one block.
        key = term * max(1, self.n_blocks) + self.place // BLOCK
        self.start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.size = np.diff(np.r_[self.start, len(key)])
        self.block = self.place[self.start] // BLOCK
        self.most = np.maximum.reduceat(self.weight, self.start) if len(key) else np.zeros(0)
        self.first = np.searchsorted(term[self.start], np.arange(n_terms + 1))
        self.posted = np.searchsorted(term, np.arange(n_terms + 1))
        self.top = np.zeros(n_terms)
        np.maximum.at(self.top, term, self.weight)

    def _read(self, entries: np.ndarray, w: np.ndarray) -> np.ndarray:
        """By place, what the postings of `entries`, whose terms have weights `w` in the query, add to the cosines."""
        size = self.size[entries]
        read = _ranges(self.start[entries], size)
        return np.bincount(self.place[read], np.repeat(w, size) * self.weight[read], len(self.order))

    def _read_terms(self, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        """As `_read`, over all postings of the terms, which lie together."""
        first, last = self.posted[at], self.posted[at + 1]
        parts = [slice(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        place, weight = (np.concatenate([of[p] for p in parts]) for of in (self.place, self.weight))
        return np.bincount(place, np.repeat(w, last - first) * weight, len(self.order))

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine above 0, nearest first, ties by place; exact.

        The heaviest terms are read first; the k-th of their sums is a floor. The others are read only in blocks where
        the largest sum so far and the bound of the other terms together reach it.
        """
        most = w * self.top[at]
        order = np.argsort(-most, kind="stable")
        at, w, most = at[order], w[order], most[order]
        heavy = int(np.searchsorted(np.cumsum(most), most.sum() / 2)) + 1
        scores = self._read_terms(at[:heavy], w[:heavy])
        if without >= 0:
            scores[without] = 0
        floor = float(np.partition(scores, -k)[-k]) - 1e-9 if len(scores) >= k else 0.0
        at, w = at[heavy:], w[heavy:]
        count = self.first[at + 1] - self.first[at]
        entries, w = _ranges(self.first[at], count), np.repeat(w, count)
        block = self.block[entries]
        kept = np.maximum.reduceat(scores, np.arange(0, len(scores), BLOCK)) + np.bincount(block, w * self.most[entries], self.n_blocks) >= floor
        now = kept[block]
        scores += self._read(entries[now], w[now])
        if without >= 0:
            scores[without] = 0
        places = np.flatnonzero((scores > 0) & (scores >= floor) & np.repeat(kept, BLOCK)[: len(scores)])
        scores = scores[places]
        if len(scores) > k:
            near = scores >= np.partition(scores, -k)[-k] - 1e-12
            places, scores = places[near], scores[near]
        best = np.lexsort((places, -np.round(scores, 12)))[:k]
        return self.order[places[best]], np.minimum(scores[best], 1.0)


@dataclass
class ToxicityModel:
    idf: np.ndarray
    ids: list[int]
    toxic: np.ndarray
    index: BlockMaxIndex
    prior: float
    curve: tuple[float, float]
    rare: float  # idf of a word that one document holds

    def _vote(self, at: np.ndarray, w: np.ndarray, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        near, cosines = self.index.nearest(at, w, NEIGHBOURS, without) if len(at) else (np.empty(0, np.int64), np.empty(0))
        weights = cosines / (1 - cosines + EPSILON)
        share = (weights @ self.toxic[near] + PRIOR_WEIGHT * self.prior) / (weights.sum() + PRIOR_WEIGHT)
        return math.log(share / (1 - share)), near, cosines

    def score(self, at, n, far: float = 0.0) -> tuple[float, np.ndarray, np.ndarray]:
        """(score, nearest examples, cosines) of sparse counts; `far` is of the words that are no terms."""
        if not len(self.idf):
            return self.prior, np.empty(0, np.int64), np.empty(0)
        vote, near, cosines = self._vote(*_vector(at, n, self.idf, far * self.rare**2))
        return 1 / (1 + math.exp(-(self.curve[0] * vote + self.curve[1]))), near, cosines


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (0.1 at least) and intercept of a weighted logistic curve, by Newton's steps with a little ridge."""
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - 1e-3 * (beta - [1.0, 0.0])
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return max(0.1, float(beta[0])), float(beta[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> tuple[ToxicityModel, DataFrame]:
    """The model, and the term counts of all `docs` that it was made with (to be scored)."""
    sample = labelled_sample(labels)
    terms, contrast = weigh_terms(docs, sample)
    written = materialize(term_counts(docs, terms), "toxic-counts")
    counts = written.where("held is null").select("doc_id", "mark", "counts", "far")
    total = counts.count()
    idf = contrast * (np.log((1 + total) / (1 + document_counts(written.where("held is not null"), len(terms)))) + 1)
    found = counts.join(F.broadcast(sample), counts["doc_id"] == sample["id"]).groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("counts").alias("counts"))
    rows = found.select("id", "toxic", "counts").toArrow().sort_by("id")  # the sample, bounded
    vectors = [_vector(*(unpack(x) if x else _NONE), idf) for x in rows["counts"].to_pylist()]
    toxic = rows["toxic"].to_numpy().astype(np.float64)
    shares = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).agg(F.avg(F.col("toxic").cast("double"))).collect()[0][0]
    prior = min(0.99, max(0.001, shares if shares is not None else 0.0))
    model = ToxicityModel(idf, rows["id"].to_pylist(), toxic, BlockMaxIndex(vectors, len(terms)), prior, (1.0, 0.0), math.log((1 + total) / 2) + 1)
    if terms and 0 < toxic.sum() < len(toxic):
        place = {int(i): p for p, i in enumerate(model.index.order)}
        votes = np.array([model._vote(*v, without=place[i])[0] for i, v in enumerate(vectors)])
        weight = np.where(toxic == 1, prior / toxic.mean(), (1 - prior) / (1 - toxic.mean()))
        model.curve = _logistic(votes, toxic, weight)
    return model, counts


def score_toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score (0 to 1), predicted (score >= threshold), evidence.

    docs: doc_id, text; labels: doc_id, toxic (0 or 1); other columns are ignored. evidence: the nearest examples with
    doc_id, cosine and toxic. The score is a function of the text alone: equal texts score equally, whatever their ids, and
    a text that is an example finds it; only the curve of the votes is fitted with each example left out of its own vote.
    Null and empty texts, and texts without a word of any example, get the score of no neighbours. Rows that repeat a
    doc_id are scored each by its own text; of equally near examples the first in the index's order count. Without
    labels of both classes every score is the labels' share of toxic rows. An empty table gives no rows.
    """
    model, counts = fit_toxicity(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def score(batches):
        import pyarrow as pa

        model, known = shared.value, {}
        evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for batch in batches:
            scores, near = [], []
            for counts, far in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                key = (xxhash.xxh3_128_digest(counts or b""), far)
                if key not in known:
                    if len(known) >= 50_000:
                        known.clear()
                    s, found, cosines = model.score(*(unpack(counts) if counts else _NONE), far)
                    known[key] = s, [{"doc_id": model.ids[i], "cosine": float(c), "toxic": int(model.toxic[i])} for i, c in zip(found, cosines, strict=True)]
                scores.append(known[key][0])
                near.append(known[key][1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(near, evidence)], ["doc_id", "score", "evidence"])

    # The counts are a fraction of the texts, so fewer files would mean fewer tasks than the scoring is worth.
    tasks = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartition(tasks, "doc_id", "mark").select("doc_id", "counts", "far")
    scored = dealt.mapInArrow(score, "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
