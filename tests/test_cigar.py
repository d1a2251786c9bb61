"""CIGAR walks within the row against a walk by single pairs."""

import random
import time

import pytest

from qualspark.operators import align, aligned, cigar


def pairs(text):
    """(op, read position or None, site or None) one by one."""
    read = ref = 0
    for op, n, _, _ in cigar.walk(text):
        for _ in range(n):
            yield op, read if op in "MIS=X" else None, ref if op in "MDN=X" else None
            read += op in "MIS=X"
            ref += op in "MDN=X"


def some_cigar(r):
    inner = "".join(f"{r.randrange(0 if k else 1, 9)}{op}" for k, op in enumerate(r.choices("MIDNP=X", weights=[6, 2, 2, 1, 1, 1, 1], k=r.randrange(1, 9))))
    return r.choice(["", "2H", "3S", "1H2S"]) + "2M" + inner + r.choice(["", "4S", "1S2H"])


def test_walk():
    assert list(cigar.walk("2S8M2I4M1D3M")) == [("S", 2, 0, 0), ("M", 8, 2, 0), ("I", 2, 10, 8), ("M", 4, 12, 8), ("D", 1, 16, 12), ("M", 3, 16, 13)]
    for bad in ("", "M", "5L", "5M3", "5M 3M", "-5M"):
        with pytest.raises(ValueError, match="CIGAR"):
            list(cigar.walk(bad))


def test_flags():
    r = random.Random(1)
    for _ in range(400):
        text = some_cigar(r)
        moved = list(pairs(text))
        n_ref = sum(x is not None for _, _, x in moved)
        ref, mask = ("".join(r.choice(c) for _ in range(n_ref + 2)) for c in ("ACGT", "0001"))
        n = sum(x is not None for _, x, _ in moved)
        letters, skip = [" "] * n, [False] * n
        deleted = {}
        for op, at, site in moved:
            if op in "M=X":
                letters[at], skip[at] = ref[site + 1], mask[site + 1] == "1"
            elif op == "S":
                skip[at] = True
        before = 0
        for op, k, read_at, ref_at in cigar.walk(text):
            if op == "I":
                for i in range(k):
                    skip[read_at + i] = mask[ref_at] == mask[ref_at + 1] == "1"
            if op in "DN" and read_at and "1" in mask[ref_at + 1 : ref_at + 1 + k]:
                deleted[read_at - 1] = True
            before += k
        for at in deleted:
            skip[at] = True
        assert cigar.flags(text, ref.encode(), mask.encode()) == ("".join(letters).encode(), "".join("01"[s] for s in skip).encode())


def test_trimmed_part():
    r = random.Random(2)
    for _ in range(600):
        text = some_cigar(r)
        moved = list(pairs(text))
        sites = [x for _, _, x in moved if x is not None]
        far, reverse = r.randrange(-2, max(sites) + 3), r.random() < 0.5
        got = cigar.trimmed_part(text, far, reverse)
        if reverse:
            reached = [k for k, (_, _, x) in enumerate(moved) if x is not None and x <= far]
            gone = [p for _, p, _ in moved[: reached[-1] + 1] if p is not None] if reached else []
        else:
            reached = [k for k, (_, _, x) in enumerate(moved) if x is not None and x >= far]
            gone = [p for _, p, _ in moved[reached[0] :] if p is not None] if reached else []
        assert (list(range(*got)) if got else []) == gone, (text, far, reverse)


def test_long_reads_take_linear_time():
    text = "3M1I2M1D" * 100_000
    start = time.time()
    letters, skip = cigar.flags(text, b"A" * 600_002, b"0" * 600_002)
    assert len(letters) == len(skip) == 600_000 and cigar.trimmed_part(text, 300_000, False)
    assert time.time() - start < 20


def test_one_exchange_by_read(spark, tmp_path):
    rows = [(k, "c", 900 + 10 * k, "20M5I75M", "ACGT" * 25) for k in range(40)]
    spark.createDataFrame(rows, "rec long, chrom string, pos int, cigar string, seq string").write.parquet(f"{tmp_path}/reads")
    spark.createDataFrame([("c", k, "A" * align.BIN, "0" * align.BIN) for k in range(4)], "chrom string, bin long, text string, mask string").write.parquet(f"{tmp_path}/bins")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = align.read_errors(spark.read.parquet(f"{tmp_path}/reads"), spark.read.parquet(f"{tmp_path}/bins"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and plan.count("hashpartitioning(rec") == 1
        assert found.count() == 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_flagged_reads_keep_their_columns(spark):
    rows = [(1, "c", 1020, "8M", "ACGTACGT", {"a": "b"}), (2, "c", 5, "2M2D2M", "AAAA", None), (3, "x", 0, "4M", "AAAA", {}), (4, "c", 0, "*", "A", {}), (5, "c", 0, None, "A", {})]
    reads = spark.createDataFrame(rows, "rec long, chrom string, pos int, cigar string, seq string, tags map<string,string>")
    bins = spark.createDataFrame([("c", 0, "A" * 1024, "0" * 7 + "1" * 1017), ("c", 1, "C" * 1024, "0" * 1024)], "chrom string, bin long, text string, mask string")
    got = {x.rec: x for x in align.flag_reads(reads, bins).collect()}
    assert {k: (x.ref, x.skip) for k, x in got.items()} == {1: ("AAAACCCC", "11110000"), 2: ("AAAA", "0111"), 3: ("    ", "0000")}
    assert got[1].tags == {"a": "b"} and got[2].tags is None and got[1].pos == 1020


def test_counts_skip_what_does_not_count(spark):
    read = lambda k, reverse, second, seq, qual, ref, skip, start, end, gone: (k, "g", second, reverse, seq, qual, ref, skip, start, end, *gone)
    rows = [read(1, False, False, "ATGCN", "II#II", "AAGC ", "00000", 0, 5, (None, None)), read(2, True, True, "CAGCG", "IIIII", "CAGCG", "10000", 1, 5, (4, 5)), read(3, False, False, "", "", "", "", 0, 0, (None, None))]
    reads = spark.createDataFrame(rows, "rec long, rg string, second boolean, reverse boolean, seq string, qual string, ref string, skip string, aln_start int, aln_end int, gone_from int, gone_to int")
    from qualspark.operators.read_arrays import count_aligned

    got = sorted(tuple(x) for x in count_aligned(reads).collect())
    code = lambda p: 4 * "ATGC".index(p[0]) + "ATGC".index(p[1])
    # Read 2 is CGCTG in sequencing direction; its last base is skipped and its first one lies in adaptor.
    want = [("g", 40, 0, -1, 0, 1), ("g", 40, 1, code("AT"), 1, 1), ("g", 40, 3, code("GC"), 0, 1), ("g", 40, -2, code("CG"), 0, 1), ("g", 40, -3, code("GC"), 0, 1), ("g", 40, -4, code("CT"), 0, 1)]
    assert got == sorted(want)
    assert aligned.count_aligned is count_aligned
