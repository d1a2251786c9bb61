"""The model applied within rows, and sums of any size."""

import random

import pytest
from pyspark.sql import functions as F

from qualspark.functions import phred
from qualspark.operators import aligned, model, read_arrays
from qualspark.operators.bases import corrected_bases, explode_bases


@pytest.mark.parametrize("times", [1, 10**6, 10**10, 10**13, 10**15])
def test_mean_qualities_of_any_size(spark, times):
    r = random.Random(5)
    cells = [(g, q, r.randrange(1, 900) * times) for g in ("a", "b", None) for q in range(43)] + [("border", q, 1000 * times) for q in (20,)]
    want = {}
    for g in {c[0] for c in cells}:
        own = [(q, n) for x, q, n in cells if x == g]
        total, s = sum(n for _, n in own), sum(int(phred.double_p(q).replace(".", "")) * n for q, n in own)
        want[g] = sum(s <= int(phred.true_p(k).replace(".", "")) * total for k in range(1, 43))
    got = model.mean_qualities(spark.createDataFrame(cells, "rg string, q int, total long"))
    assert {x.rg: x.mean_q for x in got.collect()} == want


def _model(spark, r):
    table = lambda schema, rows: spark.createDataFrame(rows, schema)
    groups = ["a", "b", None]
    rg = [(g, 20, r.randrange(-3, 4)) for g in groups]
    q = [(g, k, r.randrange(-2, 3)) for g in groups for k in range(6, 43) if r.random() < 0.7]
    cycle = [(g, k, c, r.randrange(-2, 3)) for g, k, _ in q for c in range(-30, 25) if r.random() < 0.4]
    dinuc = [(g, k, c, r.randrange(-1, 2)) for g, k, _ in q for c in range(16) if r.random() < 0.5]
    made = model.Model(table("rg string, mean_q int, delta int", rg), table("rg string, q int, delta int", q), table("rg string, q int, cycle int, delta int", cycle), table("rg string, q int, dinuc int, delta int", dinuc))
    return made, {g: m + d for g, m, d in rg}, {x[:2]: x[2] for x in q}, {x[:3]: x[3] for x in cycle}, {x[:3]: x[3] for x in dinuc}


def _expected(whole, by_q, by_cycle, by_dinuc, rg, second, seq, qual):
    out = []
    for k, (b, c) in enumerate(zip(seq, qual)):
        q = ord(c) - 33
        if q < 6:
            out.append(c)
            continue
        pair = seq[k - 1 : k + 1] if k else ""
        code = 4 * "ATGC".index(pair[0]) + "ATGC".index(pair[1]) if len(pair) == 2 and set(pair) <= set("ATGC") else -1
        out.append(chr(33 + whole[rg] + by_q.get((rg, q), 0) + by_cycle.get((rg, q, -(k + 1) if second else k), 0) + by_dinuc.get((rg, q, code), 0)))
    return "".join(out)


def _reads(r, n=60):
    rows = []
    for i in range(n):
        size = r.choice([1, 2, 20, 40])
        rows.append((i, r.choice(["a", "b", None]), r.random() < 0.5, r.random() < 0.5, "".join(r.choice("ATGCN1") for _ in range(size)), "".join(chr(33 + r.randrange(0, 43)) for _ in range(size))))
    return rows


def test_new_qualities(spark):
    r = random.Random(3)
    made, *plain = _model(spark, r)
    rows = _reads(r)
    reads = spark.createDataFrame([*rows, (900, "a", False, False, "", ""), (901, "a", False, False, None, None)], "rec long, rg string, second boolean, reverse boolean, seq string, qual string")
    got = {x.rec: x.qual for x in model.new_qualities(reads, made).collect()}
    assert got == {i: _expected(*plain, rg, second, seq, qual) for i, rg, second, _, seq, qual in rows}
    turned = {x.rec: x.qual for x in aligned.recalibrate_alignments(reads, made).collect()}
    flip = lambda s: s[::-1].translate(str.maketrans("ATGC", "TACG"))
    assert turned == {i: _expected(*plain, rg, second, flip(seq), qual[::-1])[::-1] if reverse else got[i] for i, rg, second, reverse, seq, qual in rows}


def test_a_model_with_few_cells(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    made = model.Model(spark.createDataFrame([("a", 30, 0)], "rg string, mean_q int, delta int"), empty("rg string, q int, delta int"), empty("rg string, q int, cycle int, delta int"), empty("rg string, q int, dinuc int, delta int"))
    reads = spark.createDataFrame([(1, "a", True, "ATGC", "+#+I")], "rec long, rg string, second boolean, seq string, qual string")
    assert [x.qual for x in model.new_qualities(reads, made).collect()] == ["?#??"]


def test_plan_moves_the_model_only(spark, tmp_path):
    r = random.Random(3)
    made, *_ = _model(spark, r)
    path = f"{tmp_path}/reads"
    spark.createDataFrame(_reads(r), "rec long, rg string, second boolean, reverse boolean, seq string, qual string").write.parquet(path)
    for done in (model.new_qualities, aligned.recalibrate_alignments):
        plan = done(spark.read.parquet(path), made)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and not any(x in plan for x in ("Exchange", "Join", "Generate"))


def test_large_models_are_not_broadcast(spark, monkeypatch):
    r = random.Random(3)
    made, *plain = _model(spark, r)
    rows = _reads(r)
    reads = spark.createDataFrame(rows, "rec long, rg string, second boolean, reverse boolean, seq string, qual string")
    monkeypatch.setattr(model, "BROADCAST_BYTES", 0)
    assert {x.rec: x.qual for x in model.new_qualities(reads, made).collect()} == {i: _expected(*plain, rg, second, seq, qual) for i, rg, second, _, seq, qual in rows}


def test_counted_reads(spark):
    """Reads counted in batches give the counts of their bases."""
    r = random.Random(9)
    rows = [(*row[:2], row[2], row[4], row[5], row[4][: r.randrange(len(row[4]) + 1)] + "A" * r.choice([0, 3])) for row in _reads(r, 90)] + [(900, "a", False, "", "", ""), (901, None, False, None, None, None), (902, "a", True, "ATGC", "IIII", None)]
    reads = spark.createDataFrame(rows, "rec long, rg string, second boolean, seq string, qual string, corrected string")
    of = lambda df: sorted((tuple(x) for x in df.collect()), key=repr)
    whole = reads.withColumn("corrected", F.coalesce("corrected", F.lit("")))
    assert of(read_arrays.count_reads(reads)) == of(model.finest_counts(corrected_bases(whole)))
    assert read_arrays.count_reads(reads.limit(0)).collect() == []
    for qual, message in (("IIII", "not as long"), ("LIII" + "I", "above the model's range")):
        with pytest.raises(Exception, match=message):
            read_arrays.count_reads(spark.createDataFrame([("a", False, "ATGCA", qual, "ATGCA")], "rg string, second boolean, seq string, qual string, corrected string")).collect()
    with pytest.raises(Exception, match="not in the model"):
        model.new_qualities(spark.createDataFrame([(1, "z", False, "A", "I")], "rec long, rg string, second boolean, seq string, qual string"), _model(spark, r)[0]).collect()


def test_bases_agree_with_rows(spark):
    """The covariates that counting sees are those that the model is read by."""
    rows = [(1, "a", True, "ATNGC", "+++++")]
    reads = spark.createDataFrame(rows, "rec long, rg string, second boolean, seq string, qual string")
    seen = explode_bases(reads).orderBy("pos").collect()
    table = lambda schema, x: spark.createDataFrame(x, schema)
    for one in seen:
        made = model.Model(table("rg string, mean_q int, delta int", [("a", 20, 0)]), table("rg string, q int, delta int", [("a", 10, 0)]), table("rg string, q int, cycle int, delta int", [("a", 10, one.cycle, 5)]), table("rg string, q int, dinuc int, delta int", [("a", 10, 99, 1)]))
        (got,) = model.new_qualities(reads, made).collect()
        assert [ord(c) - 53 for c in got.qual] == [5 * (k == one.pos) for k in range(5)]
