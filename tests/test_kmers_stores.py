"""K-mers and their mixture against plain versions; stores of counts over restarts, compaction and merging."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from qualspark.operators import kmers
from qualspark.operators.read_arrays import count_reads
from qualspark.streaming import count_store

READS = "rec long, seq string, qual string"


def plain_kmers(reads, k):
    """(rec, k-mer, quality) of each occurrence."""
    out = []
    for rec, seq, qual in reads:
        for i in range(len(seq or "") - k + 1):
            if set(seq[i : i + k]) <= set("ATGC"):
                right = math.prod(1 - min(10 ** (-(ord(c) - 33) / 10), 1 - 2**-32) for c in qual[i : i + k])
                out.append((rec, seq[i : i + k], max(0, min(42, math.floor(-10 * math.log10(1 - right) + kmers.HAIR)))))
    return out


@pytest.mark.parametrize("k", [1, 5, 31])
def test_kmer_cells(spark, k):
    r = random.Random(k)
    reads = [(n, "".join(r.choice("ATGCN"[: 4 + (r.random() < 0.05)]) for _ in range(r.choice([0, 1, k - 1, k, 90]))), None) for n in range(60)]
    reads = [(n, s, "".join(chr(33 + r.choice([0, 2, 13, 27, 41])) for _ in s)) for n, s, _ in reads] + [(99, None, None), (100, reads[7][1], "!" * len(reads[7][1])), (101, "A" * 500, "J" * 500)]
    want = Counter((m, q) for _, m, q in plain_kmers(reads, k))
    cells = kmers.kmer_cells(spark.createDataFrame(reads, READS).repartition(3), k)
    assert {(x.m, x.quality): x.n for x in cells.select(kmers.kmer_text(F.col("kmer"), k).alias("m"), "quality", "n").collect()} == want
    assert kmers.kmer_cells(spark.createDataFrame([], READS), k).count() == 0


def test_kmer_limits(spark):
    for k in (0, 32):
        with pytest.raises(ValueError):
            kmers.kmer_cells(spark.createDataFrame([], READS), k)


def poisson(r, mean):
    limit, n, p = math.exp(-mean), 0, r.random()
    while p > limit:
        n, p = n + 1, p * r.random()
    return n


def test_mixture_recovers_planted_parameters(spark):
    r = random.Random(4)
    planted = {8: 0.5, 20: 0.03, 33: 0.002}
    rows = [(max(1, poisson(r, 1.5 if r.random() < planted[q] else 40)), q, 1) for q in planted for _ in range(8000)]
    found = kmers.fit_mixture(spark.createDataFrame(rows, "abundance long, quality int, n long"))
    assert abs(found.true - 40) < 1 and abs(found.wrong - 1.6) < 0.4  # abundances of 0 stand as 1
    for q, share in planted.items():
        assert abs(found.share[q] - share) < 0.02
    empty = kmers.fit_mixture(spark.createDataFrame([], "abundance long, quality int, n long"))
    assert empty.share[20] == pytest.approx(0.01)


def test_read_kmer_errors(spark):
    """Reads of one ring, so that all of it is covered alike, some with a wrong base: those have as many suspicious k-mers as cover it."""
    r, k = random.Random(9), 11
    genome = "".join(r.choice("ATGC") for _ in range(400))
    reads, wrong = [], {}
    for n in range(600):
        at = r.randrange(400)
        seq, qual = list((genome + genome)[at : at + 60]), ["F"] * 60
        if n % 10 == 0:
            p = r.randrange(60)
            seq[p], qual[p] = "ATGC"[("ATGC".index(seq[p]) + 1) % 4], "-"
            wrong[n] = sum(i <= p < i + k for i in range(60 - k + 1))
        reads.append((n, "".join(seq), "".join(qual)))
    given = spark.createDataFrame(reads, READS)
    cells = kmers.kmer_cells(given, k)
    mixture = kmers.fit_mixture(kmers.occurrence_table(cells))
    assert mixture.wrong < 5 < mixture.true
    got = {x.rec: x for x in kmers.read_kmer_errors(given, kmers.kmer_counts(cells), mixture, k).collect()}
    assert all(x.kmers == 50 for x in got.values()) and len(got) == 600
    assert all(abs(x.expected - wrong.get(x.rec, 0)) < 1 for x in got.values())
    abundance = Counter(m for _, m, _ in plain_kmers(reads, k))
    spectrum = kmers.kmer_spectrum(kmers.kmer_counts(cells)).collect()
    assert {x.abundance: x.kmers for x in spectrum} == Counter(abundance.values())


def store_reads(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        size = r.choice([0, 1, 30])
        seq = "".join(r.choice("ATGCN") for _ in range(size))
        out.append((r.choice(["a", "b", None]), r.random() < 0.5, seq, "".join(chr(33 + r.randrange(43)) for _ in range(size)), "".join(c if r.random() < 0.8 else "A" for c in seq), r.choice([None, 0, 1, 7, 10**12])))
    return out


STORED = "rg string, second boolean, seq string, qual string, corrected string, weight long"


def cells(df):
    return {tuple(x)[:4]: tuple(x)[4:] for x in df.select(*count_store.KEYS, "errors", "total").collect()}


def plain_cells(reads, weighted):
    out = {}
    for rg, second, seq, qual, cor, weight in reads:
        for i, c in enumerate(seq):
            q, before = ord(qual[i]) - 33, seq[i - 1] if i else "N"
            if q >= 6:
                dinuc = 4 * "ATGC".index(before) + "ATGC".index(c) if before in "ATGC" and c in "ATGC" else -1
                w = (weight or 0) if weighted else 1
                e, t = out.get(key := (rg, q, -(i + 1) if second else i, dinuc), (0, 0))
                out[key] = (e + w * (c != cor[i]), t + w)
    return out


@pytest.mark.parametrize("weighted", [False, True])
def test_weighted_counts(spark, weighted):
    reads = store_reads(1, 200)
    assert cells(count_reads(spark.createDataFrame(reads, STORED), weight="weight" if weighted else None)) == plain_cells(reads, weighted)


def test_stores(spark, tmp_path):
    """Three batches, a restart, a batch that is run twice, a half-written one, a compaction and a merge of two stores."""
    given, store, state = f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/state"
    parts = [store_reads(s, 80) for s in (1, 2, 3, 4)]

    def feed(rows):
        spark.createDataFrame(rows, STORED).coalesce(1).write.mode("append").parquet(given)
        stream = spark.readStream.schema(STORED).parquet(given)
        count_store.write_increments(stream, store, state, weight="weight").awaitTermination()

    assert cells(count_store.stored_counts(spark, store)) == {}
    for part in parts[:2]:
        feed(part)
    assert cells(count_store.stored_counts(spark, store)) == plain_cells(parts[0] + parts[1], True)
    # The last batch is lost from the record of what was done, as if the driver had died: it is run again.
    for name in ("1", ".1.crc"):
        (tmp_path / "state" / "commits" / name).unlink()
    feed(parts[2])
    whole = plain_cells(parts[0] + parts[1] + parts[2], True)
    assert cells(count_store.stored_counts(spark, store)) == whole
    spark.createDataFrame([("a", 20, 1, 1, 5, 5)], count_store.SCHEMA).write.parquet(f"{store}/batch-77")
    (tmp_path / "store" / "batch-77" / "_SUCCESS").unlink()
    assert cells(count_store.stored_counts(spark, store)) == whole
    assert count_store.compact(spark, store) == count_store.compact(spark, store) == 2
    assert cells(count_store.stored_counts(spark, store)) == whole
    # Run again after the compaction: the base already holds it.
    for name in ("2", ".2.crc"):
        (tmp_path / "state" / "commits" / name).unlink()
    feed(parts[3])
    assert cells(count_store.stored_counts(spark, store)) == plain_cells(sum(parts, []), True)
    other = count_reads(spark.createDataFrame(parts[0], STORED))
    other.write.parquet(f"{tmp_path}/other/batch-0")
    merged = count_store.merge_counts(count_store.stored_counts(spark, store), count_store.stored_counts(spark, f"{tmp_path}/other"))
    want = plain_cells(sum(parts, []), True)
    for key, (e, t) in plain_cells(parts[0], False).items():
        want[key] = (want.get(key, (0, 0))[0] + e, want.get(key, (0, 0))[1] + t)
    assert cells(merged) == want
