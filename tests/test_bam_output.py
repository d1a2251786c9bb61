"""BAM files written by Spark read back equal, failed jobs leave nothing, and the alignment commands end to end."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from qualspark.jobs import cli
from qualspark.operators import aligned
from qualspark.sources import alignments, report_file
from qualspark.sources.bam_writer import BLOCK, bam_parts, bgzf, region_bin, write_bam

HEADER = "@HD\tVN:1.6\n@SQ\tSN:one\tLN:60000\n@SQ\tSN:two\tLN:900000\n@RG\tID:g\tPU:unit\n@RG\tID:h\tPU:unit2\n"


def lines(n):
    r = random.Random(4)
    for k in range(n):
        size = r.choice([1, 4, 151, 900])
        seq, qual = "".join(r.choice("ACGTN") for _ in range(size)), "".join(chr(33 + r.randrange(2, 42)) for _ in range(size))
        clip = r.randrange(size)
        cigar = f"{clip}S{size - clip}M" if clip else f"{size}M"
        at, mate = r.randrange(1, 50_000), r.choice(["=", "*", "one", "two"])
        ref = r.choice(["one", "two"])
        mate = "=" if mate == ref else mate
        tags = [f"RG:Z:{r.choice('gh')}", f"NM:i:{k}", "MD:Z:10A5"][: r.randrange(4)]
        yield "\t".join([f"r{k}", str(r.choice([0, 16, 99, 147])), ref, str(at), "30", cigar, mate, str(0 if mate == "*" else at), str(r.randrange(-300, 300)), seq, qual, *tags])
    yield "\t".join(["unmapped", "4", "*", "0", "0", "*", "*", "0", "0", "ACG", "*"])
    yield "\t".join(["empty", "4", "*", "0", "0", "*", "*", "0", "0", "*", "*"])


@pytest.fixture(scope="module")
def sam(tmp_path_factory):
    path = tmp_path_factory.mktemp("bam-output") / "a.sam"
    path.write_text(HEADER + "".join(f"{x}\n" for x in lines(900)))
    return path


def rows(df):
    return sorted(tuple(x) for x in df.drop("rec", "file").withColumn("tags", F.array_sort(F.map_entries("tags"))).collect())


def test_round_trip(spark, sam, tmp_path):
    """Many files and blocks; a second job is added beside the first, and overwriting replaces both."""
    stored, out = alignments.read_sam(spark, str(sam)), f"file://{tmp_path}/out.bam"
    want = rows(stored)
    write_bam(stored.repartition(5), out, HEADER)
    assert len(bam_parts(out)) == 5 and len(list((tmp_path / "out.bam").iterdir())) == 5
    assert rows(alignments.read_bam(spark, bam_parts(out), 20_000)) == want
    assert [x.rg_id for x in alignments.bam_read_groups(spark, bam_parts(out)[0]).collect()] == ["g", "h"]
    write_bam(stored.repartition(2), out, HEADER)
    assert rows(alignments.read_bam(spark, bam_parts(out))) == sorted(want * 2)
    write_bam(stored.coalesce(1), out, HEADER, "overwrite")
    assert len(bam_parts(out)) == 1
    assert [tuple(x) for x in alignments.read_bam(spark, bam_parts(out)).orderBy("rec").select("qname").collect()] == [tuple(x) for x in stored.orderBy("rec").select("qname").collect()]
    write_bam(stored.limit(0), f"file://{tmp_path}/none.bam", HEADER)
    assert alignments.read_bam(spark, bam_parts(f"file://{tmp_path}/none.bam")).count() == 0


def test_a_failed_job_leaves_nothing(spark, sam, tmp_path):
    stored, out = alignments.read_sam(spark, str(sam)), f"file://{tmp_path}/out.bam"
    write_bam(stored, out, HEADER)
    before = bam_parts(out)
    bad = stored.repartition(4).withColumn("rname", F.when(F.col("qname") == "r7", "elsewhere").otherwise(F.col("rname")))
    with pytest.raises(Exception, match="elsewhere"):
        write_bam(bad, out, HEADER)
    assert bam_parts(out) == before and [x.name for x in (tmp_path / "out.bam").iterdir() if x.is_dir()] == []
    with pytest.raises(Exception, match="positions begin at 0"):
        write_bam(stored.withColumn("pnext", F.lit(-2)), out, HEADER)
    with pytest.raises(Exception, match="missing|UNRESOLVED"):
        write_bam(stored.drop("cigar"), out, HEADER)


def test_bins_and_blocks():
    """The smallest bin that holds a region, against a search of all; the largest block is one that its size can tell."""
    holds = []
    for level, shift in enumerate((29, 26, 23, 20, 17, 14)):
        holds += [(k << shift, (k + 1) << shift) for k in range(1 << 3 * level)]
    r = random.Random(1)
    for _ in range(150):
        a = r.randrange(1 << 29)
        b = min(a + r.choice([1, 100, 20_000, 1 << 18, 1 << 24]), 1 << 29)
        want = max(k for k, (x, y) in enumerate(holds) if x <= a and b <= y)
        assert region_bin(a, b) == want
    noise = random.Random(2).randbytes(BLOCK)
    assert struct.unpack_from("<H", bgzf(noise), 16)[0] + 1 == len(bgzf(noise))


def test_commands(spark, tmp_path):
    """report, then recalibrate by it: qualities are those of the operators, all else stays as it was and in order."""
    r = random.Random(8)
    ref = "".join(r.choice("ACGT") for _ in range(3000))
    made = []
    for k in range(300):
        at, flag = r.randrange(2900), r.choice([0, 16])
        seq = "".join(c if r.random() < 0.9 else r.choice("ACGT") for c in ref[at : at + 60])
        n = len(seq)
        made.append("\t".join([f"r{k}", str(flag), "one", str(at + 1), "30", f"{n}M", "*", "0", "0", seq, "".join(r.choice("#5?I") for _ in range(n)), f"RG:Z:{r.choice('gh')}"]))
    made.append("\t".join(["last", "4", "*", "0", "0", "*", "*", "0", "0", "ACG", "III", "RG:Z:g"]))
    (tmp_path / "a.sam").write_text(HEADER.replace("LN:60000", "LN:3000") + "".join(f"{x}\n" for x in made))
    (tmp_path / "b.sam").write_text((tmp_path / "a.sam").read_text().replace("RG:Z:", "XX:Z:", 1))  # a read without a group
    (tmp_path / "ref.fa").write_text(f">one\n{ref}\n")
    (tmp_path / "v.vcf").write_text("##fileformat=VCFv4.2\none\t10\t.\tG\tT\t.\t.\t.\n")
    at = lambda name: f"{tmp_path}/{name}"
    cli.write_report(spark, at("a.sam"), at("ref.fa"), at("v.vcf"), at("report"), use_original=False)
    tables = report_file.read_report(spark, at("report"))
    reads = aligned.alignment_reads(alignments.read_sam(spark, at("b.sam")), alignments.read_groups(spark, at("b.sam")), False)
    want = {x.rec: x.qual for x in aligned.recalibrate_alignments(reads.where("rg is not null"), aligned.model_of_report(tables)).collect()}
    assert len(want) == 299
    cli.recalibrate_alignments(spark, at("b.sam"), at("report"), at("new.bam"), False, True)
    stored = alignments.read_sam(spark, at("b.sam")).orderBy("rec").collect()
    got = cli._stored(spark, at("new.bam")).orderBy("file", "rec").collect()
    assert [x.qname for x in got] == [x.qname for x in stored]
    assert [x.qual for x in got] == [want.get(x.rec, x.qual) for x in stored] and any(x.qual != y.qual for x, y in zip(got, stored))
    assert [(x.tags.get("OQ"), x.tags.get("RG"), x.seq, x.pos) for x in got] == [(y.qual if y.rec in want else None, y.tags.get("RG"), y.seq, y.pos) for y in stored]
    # A folder of BAM files is read as one input: by its OQ tags the report is the one of before.
    cli.recalibrate_alignments(spark, at("a.sam"), at("report"), at("whole.bam"), False, True)
    cli.write_report(spark, at("whole.bam"), at("ref.fa"), at("v.vcf"), at("again"), use_original=True)
    same = [spark.read.text(at(x), wholetext=True).collect()[0].value for x in ("report", "again")]
    assert same[0] == same[1]
    with pytest.raises(SystemExit):
        cli.main(["recalibrate", "-b", at("a.sam"), "-o", at("x")])
