"""K-mers of whole reads: counts, their spectrum, and a mixture that tells k-mers with errors from true ones.

An occurrence of a k-mer has an abundance (how often the k-mer occurs in all reads) and a quality (of the chance that one
of its bases is wrong, by the reported qualities). Abundances of k-mers with errors and of true ones follow a Poisson
distribution each. The share of k-mers with errors at each quality starts at what the quality says, as a Beta prior, and
is learned with the two means. Learning reads a table of abundance x quality alone, however many reads there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.phred import MOST_Q
from ..jobs.tables import materialize
from .read_arrays import _CODE, letters, places

#: Letters that fit in a 64-bit code, two bits each.
MOST_K = 31
#: Pseudo-counts of the Beta prior of each quality, and (shape, rate) of the Gamma priors of both means.
STRENGTH, WRONG_PRIOR, TRUE_PRIOR = 200.0, (2.0, 1.0), (2.0, 1 / 500)
#: Added before qualities are cut to whole numbers, so that one base's quality is its own.
HAIR = 1e-4
#: -ln(1 - p) by quality, as whole numbers, so that sums over bases do not depend on what stands before them in a batch.
_COST = np.array([round(-math.log1p(-min(10 ** (-q / 10), 1 - 2**-32)) * 2**32) for q in range(256)], dtype=np.int64)


def _occurrences(batch, k: int):
    """(row of the read, code, quality) of each k-mer of a batch (columns 0 and 1: seq, qual), in order; those with other letters than ATGC are none."""
    seq, sizes = letters(batch.column(0))
    qual, lengths = letters(batch.column(1))
    if (sizes != lengths).any():
        raise ValueError("a read's qualities are not as long as its sequence")
    n = len(seq) - k + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.int64),) * 3
    code, read = _CODE[seq], np.repeat(np.arange(len(sizes)), sizes)
    other = np.concatenate(([0], np.cumsum(code == 4)))
    held = np.flatnonzero((np.repeat(sizes, sizes) - places(sizes) >= k)[:n] & (other[k:] == other[:n]))
    kmer = np.zeros(n, dtype=np.int64)
    for i in range(k):
        kmer = 4 * kmer + np.minimum(code[i : n + i], 3)
    cost = np.concatenate(([0], np.cumsum(_COST[np.clip(qual.astype(np.int64) - 33, 0, 255)])))
    wrong = -np.expm1(-(cost[k:] - cost[:n])[held] / 2**32)
    with np.errstate(divide="ignore"):
        quality = np.clip(np.floor(-10 * np.log10(wrong) + HAIR), 0, MOST_Q).astype(np.int64)
    return read[held], kmer[held], quality


def _pairs(reads: DataFrame, *more: str) -> DataFrame:
    return reads.select(F.col("seq").cast("binary").alias("seq"), F.col("qual").cast("binary").alias("qual"), *more)


def _checked(k: int) -> None:
    if not 1 <= k <= MOST_K:
        raise ValueError(f"k must be from 1 to {MOST_K}: {k}")


def kmer_cells(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, quality, n): occurrences of each k-mer by quality. reads: seq, qual; null and short sequences have none.

    Each batch is summed before the shuffle, so a k-mer that a third of all reads hold is a few rows a batch.
    """
    _checked(k)

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            _, kmer, quality = _occurrences(batch, k)
            # Sorted by code, then quality; a code may fill 62 bits, so both do not fit in one number.
            order = np.lexsort((quality, kmer))
            kmer, quality = kmer[order], quality[order]
            first = np.flatnonzero(np.concatenate(([True], (kmer[1:] != kmer[:-1]) | (quality[1:] != quality[:-1])))[: len(kmer)])
            n = np.diff(np.concatenate((first, [len(kmer)])))
            yield pa.RecordBatch.from_arrays([pa.array(kmer[first]), pa.array(quality[first], pa.int32()), pa.array(n, pa.int64())], ["kmer", "quality", "n"])

    return _pairs(reads).mapInArrow(count, "kmer long, quality int, n long").groupBy("kmer", "quality").agg(F.sum("n").alias("n"))


def kmer_counts(cells: DataFrame) -> DataFrame:
    """(kmer, abundance) from kmer_cells."""
    return cells.groupBy("kmer").agg(F.sum("n").alias("abundance"))


def kmer_spectrum(counts: DataFrame) -> DataFrame:
    """(abundance, kmers): how many k-mers occur that often."""
    return counts.groupBy("abundance").agg(F.count("*").alias("kmers"))


def kmer_text(code: Column, k: int) -> Column:
    """The letters of a code."""
    return F.concat(*(F.substring(F.lit("ATGC"), (F.shiftright(code, 2 * (k - 1 - i)).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) for i in range(k)))


def occurrence_table(cells: DataFrame) -> DataFrame:
    """(abundance, quality, n): occurrences of k-mers by both; a k-mer has at most one row per quality to put together."""
    own = cells.groupBy("kmer").agg(F.sum("n").alias("abundance"), F.collect_list(F.struct("quality", "n")).alias("each"))
    return own.select("abundance", F.inline("each")).groupBy("abundance", "quality").agg(F.sum("n").alias("n"))


@dataclass
class Mixture:
    """Means of abundance of k-mers with errors and of true ones, and the share of the former by quality."""

    wrong: float
    true: float
    share: list[float]

    def p_error(self, abundance: Column, quality: Column) -> Column:
        """Chance that an occurrence holds an error."""
        share = F.get(F.array(*map(F.lit, self.share)), quality)
        # The factorials of both distributions cancel.
        odds = F.log((1 - share) / share) + abundance * F.lit(math.log(self.true / self.wrong)) - F.lit(self.true - self.wrong)
        return 1 / (1 + F.exp(odds))


def fit_mixture(table: DataFrame, *, rounds: int = 200, tolerance: float = 1e-7) -> Mixture:
    """Expectation maximisation over an occurrence_table, under the priors, until neither mean moves by `tolerance` of itself.

    Sums are made by Spark, a row per quality. Without occurrences all stays at the priors.
    """
    table = materialize(table, "kmer-occurrences")
    prior = [min(10 ** (-q / 10), 1 - 1e-6) for q in range(MOST_Q + 1)]
    mean = table.agg((F.sum(F.col("abundance") * F.col("n").cast("double")) / F.sum("n")).alias("m")).first().m
    now = Mixture(1.0, max(2.0, mean or 0.0), list(prior))
    for _ in range(rounds):
        p, n, a = F.col("p"), F.col("n").cast("double"), F.col("abundance")
        sums = table.withColumn("p", now.p_error(a, F.col("quality"))).groupBy("quality").agg(F.sum(n).alias("n"), F.sum(n * p).alias("w"), F.sum(n * p * a).alias("wa"), F.sum(n * (1 - p) * a).alias("ta"))
        rows = sorted(sums.collect())  # a row per quality
        n, w, wa, ta = (math.fsum(r[c] for r in rows) for c in ("n", "w", "wa", "ta"))
        wrong, true = ((s + prior_[0] - 1) / (m + prior_[1]) for s, m, prior_ in ((wa, w, WRONG_PRIOR), (ta, n - w, TRUE_PRIOR)))
        share = list(prior)
        for r in rows:
            share[r.quality] = (r.w + STRENGTH * prior[r.quality]) / (r.n + STRENGTH)
        last, now = now, Mixture(wrong, max(true, wrong), share)
        if abs(now.wrong - last.wrong) <= tolerance * last.wrong and abs(now.true - last.true) <= tolerance * last.true:
            break
    return now


def read_kmer_errors(reads: DataFrame, counts: DataFrame, mixture: Mixture, k: int) -> DataFrame:
    """(rec, kmers, expected): each read's k-mers and how many of them are expected to hold an error.

    Occurrences meet the k-mers' abundances, one row a k-mer, in one join; a common k-mer's side may be split. Reads
    without k-mers give no row. `rec` must be unique.
    """
    _checked(k)

    def occurrences(batches):
        import pyarrow as pa

        for batch in batches:
            read, kmer, quality = _occurrences(batch, k)
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(read)), pa.array(kmer), pa.array(quality, pa.int32())], ["rec", "kmer", "quality"])

    own = _pairs(reads, "rec").mapInArrow(occurrences, "rec long, kmer long, quality int").join(counts, "kmer")
    return own.groupBy("rec").agg(F.count("*").alias("kmers"), F.sum(mixture.p_error(F.col("abundance"), F.col("quality"))).alias("expected"))
