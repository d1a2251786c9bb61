"""Shifts that add up to less than 0: letters below that of quality 0, as the SQL has them."""

import os

import pytest
from test_oracle import normal, oracle

from qualspark.functions import phred
from qualspark.jobs import cli
from qualspark.jobs.file_queries import ORACLE_SQL, QUERIES
from qualspark.operators import aligned, model
from qualspark.sources import alignments, report_file


@pytest.fixture(scope="module")
def low_dir(sf_dir, tmp_path_factory):
    """Documents of G (quality 26, no error) with one x (quality 26, an error) at one place, in a context of its own."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    out = tmp_path_factory.mktemp("low")
    for name in os.listdir(sf_dir):
        if name != "documents.parquet":
            os.symlink(f"{sf_dir}/{name}", out / name)
    n = 400
    text = "G" * 30 + "x" + "G" * 29
    columns = {"doc_id": pa.array(range(6, 6 * n + 6, 6), pa.int64()), "text": [text] * n, "lang": ["en"] * n, "source": ["web"] * n, "n_chars": pa.array([len(text)] * n, pa.int64())}
    pq.write_table(pa.table(columns), out / "documents.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["recalibrate", "recalibrate_bam"])
def test_qualities_below_zero_equal_sql(spark, low_dir, name):
    df = QUERIES[name](spark, low_dir)
    rows = [tuple(r) for r in df.collect()]
    columns, want = oracle(low_dir, ORACLE_SQL[name])
    assert normal(df.columns, rows) == normal(columns, want)
    assert len(rows) == 400 and all(ord(r[df.columns.index("qual")][30]) < 33 for r in rows)


@pytest.mark.parametrize("most", [model.BROADCAST_BYTES, 0])
def test_both_ways_write_low_qualities(spark, monkeypatch, most):
    monkeypatch.setattr(model, "BROADCAST_BYTES", most)
    table = lambda schema, rows: spark.createDataFrame(rows, schema)
    own = lambda last: model.Model(table("rg string, mean_q int, delta int", [("a", 20, 0)]), table("rg string, q int, delta int", [("a", 10, -1)]), table("rg string, q int, cycle int, delta int", [("a", 10, 1, -18)]), table("rg string, q int, dinuc int, delta int", [("a", 10, 1, last)]))
    reads = table("rec long, rg string, second boolean, reverse boolean, seq string, qual string", [(1, "a", False, False, "ATG", "+++"), (2, "a", False, True, "CAT", "#++")])
    for last, letter in ((-1, 33), (-2, 32), (-18, 16), (-34, None)):
        if letter is None:
            with pytest.raises(Exception, match="quality cannot be written"):
                model.new_qualities(reads, own(last)).collect()
            continue
        got = {x.rec: [ord(c) for c in x.qual] for x in aligned.recalibrate_alignments(reads, own(last)).collect()}
        assert got == {1: [52, letter, 52], 2: [35, letter, 52]}
    assert [ord(c) for c in spark.range(1).select(*(phred.q_char(phred.F.lit(q)) for q in (-17, -1, 0, 93))).collect()[0]] == [16, 32, 33, 126]


def test_bam_files_hold_them_as_zero(spark, tmp_path):
    seq, qual = "C" * 30 + "A" + "C" * 29, ";" * 60
    ref = "C" * 60
    rows = [f"r{k}\t0\tone\t1\t30\t60M\t*\t0\t0\t{seq}\t{qual}\tRG:Z:g" for k in range(400)]
    (tmp_path / "a.sam").write_text("@SQ\tSN:one\tLN:60\n@RG\tID:g\tPU:unit\n" + "".join(f"{x}\n" for x in rows))
    (tmp_path / "ref.fa").write_text(f">one\n{ref}\n")
    (tmp_path / "v.vcf").write_text("##fileformat=VCFv4.2\none\t60\t.\tC\tT\t.\t.\t.\n")
    at = lambda name: f"{tmp_path}/{name}"
    cli.write_report(spark, at("a.sam"), at("ref.fa"), at("v.vcf"), at("report"), use_original=False)
    reads = aligned.alignment_reads(alignments.read_sam(spark, at("a.sam")), alignments.read_groups(spark, at("a.sam")), False)
    made = {x.rec: x.qual for x in aligned.recalibrate_alignments(reads, aligned.model_of_report(report_file.read_report(spark, at("report")))).collect()}
    assert len(made) == 400 and all(ord(x[30]) < 33 for x in made.values())
    cli.recalibrate_alignments(spark, at("a.sam"), at("report"), at("new.bam"), False)
    got = [x.qual for x in cli._stored(spark, at("new.bam")).collect()]
    assert sorted(got) == sorted(x[:30] + "!" + x[31:] for x in made.values())
