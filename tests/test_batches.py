"""Steps that work on whole batches, held to their row-by-row forms; what must not be shuffled is not."""

from pyspark.sql import functions as F

from qualspark.jobs import queries, synthetic
from qualspark.operators import align, read_arrays
from qualspark.sources import sites, text_lines


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_reads_of_characters(spark):
    docs = spark.createDataFrame([(1, "en", "é😀a" + "b" * 200), (2, None, ""), (3, "de", None), (4, "de", "x" * 100)], "doc_id long, lang string, text string")
    got = {(r.doc_id, r.k): r for r in synthetic.reads_of(docs, "seq").collect()}
    assert {k: len(r.seq) for k, r in got.items()} == {(1, 0): 100, (1, 1): 100, (1, 2): 3, (4, 0): 100}
    assert got[1, 0].seq.startswith("NN") and "corrected" not in got[1, 0]


def test_strands(spark, sf_dir):
    reads = queries._clipped(spark, sf_dir).where("doc_id < 20")
    keys = ("rg", "cycle", "clip_cycle", "dinuc", "clip_dinuc")
    want = align.aligned_covariates(reads).groupBy(*keys).agg(F.count("*").alias("n"))
    assert rows(read_arrays.count_strands(reads)) == rows(want)


def test_flags(spark):
    flagged = spark.createDataFrame([(1, "ACGT", "AC T", "0010", "IIII"), (2, "AA", "CA", "00", "5I"), (3, "", "", "", "")], "rec long, seq string, ref string, skip string, qual string")
    assert rows(read_arrays.flag_sums(flagged)) == [(1, 4, 0, 1, 2), (2, 2, 1, 0, 0)]
    assert rows(read_arrays.count_flagged(flagged)) == [(20, 1, 1), (40, 0, 4)]


def test_bed_positions_once(spark):
    bed = spark.createDataFrame([("a", 0, 3000), ("a", 5, 10), ("a", 2990, 3005), ("a", 0, 3000), ("b", 7, 7)], "chrom string, start int, end int")
    found = sites.bed_positions(bed)
    assert rows(found) == [("a", p) for p in sorted(range(3005), key=lambda p: repr(("a", p)))]
    assert "pos" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)


def test_lines_stay(spark, tmp_path):
    spark.range(50).select(F.col("id").cast("string")).coalesce(1).write.text(f"{tmp_path}/t")
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a file too large to be sent
    try:
        lines = text_lines.numbered_lines(spark, f"{tmp_path}/t")
        assert [r.line for r in lines.orderBy("line").collect()] == list(range(50))
        assert "BroadcastHashJoin" in lines._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
