"""File sources cut anywhere, and the regression against a plain fit."""

import math
import random

import pytest

from qualspark.operators import regression
from qualspark.sources import fastq, sites


@pytest.mark.parametrize("size", ["1m", "90"])
def test_fasta_cut_anywhere(spark, tmp_path, size):
    """Pieces of a file that begin within a contig carry on where the piece before left off."""
    r = random.Random(3)
    want = []
    for name in ("a.fa", "b.fa"):
        lines = []
        for k in range(12):
            chrom, at = f"{name}{k}", 0
            lines.append(f">{chrom} text > more")
            for _ in range(r.choice([0, 1, 2, 30])):
                seq = "".join(r.choice("ACGTacgtN") for _ in range(r.randrange(1, 12)))
                want.append((chrom, at, seq))
                lines += [seq] + [""] * (r.random() < 0.1)
                at += len(seq)
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = sites.read_fasta(spark, str(tmp_path)).collect()
        assert sorted(tuple(x) for x in got) == sorted(want)
        assert {x.seq for x in sites.read_fasta(spark, str(tmp_path), upper=True).collect()} == {s.upper() for *_, s in want}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", ["1m", "200", "71"])
def test_fastq_cut_anywhere(spark, tmp_path, size):
    """Records are found whatever lines a piece begins and ends with; quality lines may begin with @."""
    r = random.Random(9)
    want = []
    for name, blank in (("a.fq", ""), ("b.fq", "\n\n\n"), ("c.fq", "\n" * 5)):
        text = ""
        for k in range(25):
            n = r.randrange(0, 9)
            seq, qual = "".join(r.choice("ACGT") for _ in range(n)), "".join(r.choice("@+I#") for _ in range(n))
            comment = r.choice([None, "a comment"])
            want.append((k, f"{name}{k}", comment, seq, qual))
            text += f"@{name}{k}{' ' + comment if comment else ''}\n{seq}\n+\n{qual}\n"
        (tmp_path / name).write_text(text + blank)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = fastq.read_fastq(spark, str(tmp_path))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
        (tmp_path / "d.fq").write_text("@x\nAC\n+\nI\n")
        with pytest.raises(Exception, match="not a record"):
            fastq.read_fastq(spark, str(tmp_path / "d.fq")).collect()
        (tmp_path / "e.fq").write_text("@x\nAC\n+\n")
        with pytest.raises(Exception, match="not a record"):
            fastq.read_fastq(spark, str(tmp_path / "e.fq")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_fasta_without_a_header_fails(spark, tmp_path):
    (tmp_path / "bad.fa").write_text("ACGT\n>a\nA\n")
    with pytest.raises(Exception, match="without a header"):
        sites.read_fasta(spark, str(tmp_path / "bad.fa")).collect()


def plain_curve(cells, strength):
    """Slope and intercept of a logistic curve, by Newton's steps; half the slope's square counts 1 / strength."""
    a = b = 0.0
    for _ in range(200):
        ga, gb, haa, hab, hbb = a / strength, 0.0, 1 / strength, 0.0, 0.0
        for q, e, n in cells:
            p = 1 / (1 + math.exp(-(a * q + b)))
            d, h = n * p - e, n * p * (1 - p)
            ga, gb, haa, hab, hbb = ga + d * q, gb + d, haa + h * q * q, hab + h * q, hbb + h
        det = haa * hbb - hab * hab
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    return a, b


@pytest.mark.parametrize("strength", [1.0, 0.001])
def test_regression_equals_a_plain_fit(spark, strength):
    cells = [(q, max(0, round(4000 * 10 ** (-q / 11)) + q % 3), 4000 + 10 * q) for q in range(6, 41)]
    a, b = plain_curve(cells, strength)
    want = {}
    for q, _, _ in cells:
        exact = -10 * math.log10(1 / (1 + math.exp(-(a * q + b))))
        want[q] = {int(max(0, min(42, exact - 0.02))), int(max(0, min(42, exact + 0.02)))}
    got = regression.regression_qualities(spark.createDataFrame(cells, "q int, errors long, total long"), strength).collect()
    assert len(got) == len(cells) and all(x.new_q in want[x.q] for x in got)


def pooled(cells):
    """{q: rate} by pooling neighbours whose rates rise, from the lowest quality on."""
    pools = []
    for q, e, n in sorted(cells):
        pools.append([[q], e, n])
        while len(pools) > 1 and pools[-1][1] * pools[-2][2] > pools[-2][1] * pools[-1][2]:
            qs, e, n = pools.pop()
            pools[-1] = [pools[-1][0] + qs, pools[-1][1] + e, pools[-1][2] + n]
    return {q: e / n for qs, e, n in pools for q in qs}


def test_isotonic_equals_pooling(spark):
    r = random.Random(12)
    cells = [(g, q, r.randrange(0, 60), r.randrange(60, 4000)) for g in ("a", "b", None) for q in range(6, 43) if r.random() < 0.8] + [("b", 2, 0, 0), ("c", 9, 0, 5)]
    got = {(x.rg, x.q): x.new_q for x in regression.isotonic_qualities(spark.createDataFrame(cells, "rg string, q int, errors long, total long")).collect()}
    want = {}
    for g in {c[0] for c in cells}:
        for q, p in pooled([c[1:] for c in cells if c[0] == g and c[3]]).items():
            want[g, q] = 42 if p == 0 else max(0, min(42, int(-10 * math.log10(p))))
    assert got == want
    for g in ("a", "b", None):
        own = [got[k] for k in sorted((k for k in got if k[0] == g), key=lambda k: k[1])]
        assert own == sorted(own)
