"""Small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from qualspark.functions import covariates, names, phred
from qualspark.jobs import cli
from qualspark.operators import align, aligned, bases, calibration, model, report
from qualspark.sources import alignments, fastq, report_file, sites

SAM = """@HD\tVN:1.6\tSO:coordinate
@SQ\tSN:ref\tLN:45
@RG\tID:a\tPU:unit
r001\t99\tref\t7\t30\t8M2I4M1D3M\t=\t37\t39\tTTAGATAAAGGATACTG\t==99=?<*+/5:@A99:
r001\t147\tref\t37\t30\t9M\t=\t7\t-39\tCAGCGGCAT\t><>???>>>\tNM:i:1
"""
FASTA = ">ref\nAGCATGTTAGATAAGATAGCTGTGCTAGTAGGCAGTCAGCGCCAT\n"
VCF = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nref\t10\t.\tG\tT\t.\t.\t.\n"
TABLE = {(9, 42, 1), (10, 42, 1), (14, 42, 1), (20, 42, 1), (24, 42, 3), (25, 42, 2), (27, 42, 2), (28, 42, 1), (29, 42, 5), (30, 6, 4), (31, 42, 1), (32, 42, 1)}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("small")
    texts = {
        "a.sam": SAM,
        "ref.fa": FASTA,
        "v.vcf": VCF,
        "r.bed": "ref\t8\t46\n",
        "a.fq": "@r001/1_x\nTTAGATAAAGGATACTG\n+\n==99=?<*+/5:@A99:\n@r001/2_x\nATGCCGCTG\n+\n>>>???><>\n",
        "foo.fq": "@foo comment\nATG\n+\n((#\n",
        "foo.cor.fq": "@foo:cor\nACG\n+\n((#\n",
    }
    for name, text in texts.items():
        (d / name).write_text(text)
    return d


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).collect()[0]


def test_sites(spark, files):
    assert [tuple(r) for r in align.variant_sites(sites.read_vcf(spark, f"{files}/v.vcf")).collect()] == [("ref", 9)]
    assert sorted(r.pos for r in sites.bed_positions(sites.read_bed(spark, f"{files}/r.bed")).collect()) == list(range(8, 46))
    assert len(sites.reference_bases(sites.read_fasta(spark, f"{files}/ref.fa")).collect()) == 45
    assert [tuple(r) for r in alignments.read_groups(spark, f"{files}/a.sam").collect()] == [("a", "unit", 0)]


def test_read_errors(spark, files):
    rows = alignments.read_sam(spark, f"{files}/a.sam").select("rec", F.col("rname").alias("chrom"), "pos", "cigar", "seq")
    bins = align.site_bins(sites.read_fasta(spark, f"{files}/ref.fa"), align.variant_spans(sites.read_vcf(spark, f"{files}/v.vcf")), sites.read_bed(spark, f"{files}/r.bed"))
    (only,) = bins.collect()
    assert [k for k, c in enumerate(only.mask) if c == "1"] == [*range(8), 9]
    assert only.text.rstrip() == FASTA.splitlines()[1] and len(only.text) == len(only.mask) == align.BIN
    found = align.read_errors(rows, bins).collect()
    assert {(r.rec, r.read_pos) for r in found if r.error} == {(4, 5)}
    assert {(r.rec, r.read_pos) for r in found if r.skip} == {(3, 0), (3, 1), (3, 3)}


@pytest.mark.parametrize("reads", [None, "a.fq"])
def test_benchmark(spark, files, reads):
    got = cli.benchmark(spark, f"{files}/a.sam", f"{files}/ref.fa", f"{files}/v.vcf", f"{files}/r.bed", reads and f"{files}/{reads}", "x")
    assert {(r.predicted_q, r.actual_q, r.n_bases) for r in got.collect()} == TABLE
    lines = [r.value for r in sites.calibration_text(got).collect()]
    assert lines[0] == "9\t42\tx\t1" and len(lines) == len(TABLE)


def test_recalibrate(spark, files, tmp_path):
    cli.recalibrate(spark, f"{files}/foo.fq", f"{files}/foo.cor.fq", f"{tmp_path}/out")
    assert [r.qual for r in fastq.read_fastq(spark, f"{tmp_path}/out").collect()] == ["''#"]


def test_bad_cigar_fails(spark):
    with pytest.raises(Exception, match="CIGAR"):
        align.cigar_ops(spark.createDataFrame([(1, "5L")], "rec long, cigar string")).collect()


def test_phred(spark):
    rates = {0.2: 6, 0.3: 5, 0.4: 3, 0.1: 10, 0.01: 20, 0.001: 30, 0.0: 42}
    for p, q in rates.items():
        assert one(spark, q=phred.p_to_q(F.lit(p))).q == q
    assert one(spark, p=phred.q_to_p(F.lit(6))).p == pytest.approx(0.251188643)


def test_mean_quality_borders(spark):
    """One read group per single quality: the exact sum falls below just where the wide double does."""
    below = {2, 5, 6, 7, 9, 10, 12, 14, 17, 19, 20, 23, 24, 25, 28, 29, 30, 33, 34, 35, 38, 39, 40, 41}
    rows = spark.range(1, 43).select(F.col("id").cast("string").alias("rg"), F.col("id").cast("int").alias("q"), F.lit(1000).cast("long").alias("total"))
    got = {int(r.rg): r.mean_q for r in model.mean_qualities(rows).collect()}
    assert got == {q: q - (q in below) for q in range(1, 43)}


def test_posteriors(spark):
    post = lambda prior, e, n: one(spark, q=phred.posterior_q(F.lit(prior), F.lit(e), F.lit(n))).q
    assert post(10, 0, 1000) == 13 and post(13, 0, 1000) == 15 and post(15, 0, 1000) == 16
    assert post(10, 10, 1000) > 10 and post(20, 200, 1000) < 20 and post(30, 0, 50000) > 30
    assert all(post(q, 0, 0) == q for q in (1, 7, 42))


def test_dinucleotides(spark):
    reads = spark.createDataFrame([(0, "a", False, "ATGCATGC", "+" * 8), (1, "a", True, "ANGCATGC", "++++++#+")], "rec long, rg string, second boolean, seq string, qual string")
    got = {(r.rec, r.pos): (r.dinuc, r.cycle) for r in bases.explode_bases(reads).collect()}
    assert [got[0, k][0] for k in range(8)] == [-1, 1, 6, 11, 12, 1, 6, 11]
    assert [got[1, k][0] for k in range(8)] == [-1, -1, -1, 11, 12, 1, -1, 11]
    assert [got[1, k][1] for k in range(8)] == [-1 - k for k in range(8)]
    codes = [one(spark, d=covariates.dinucleotide(F.lit(a), F.lit(b), F.lit(10))).d for a in "ATGC" for b in "ATGC"]
    assert codes == list(range(16))


def test_context_of_the_aligned_part(spark):
    """A clip before the first aligned base gives it no context, in sequencing direction."""
    rows = [(0, "a", False, True, "CAGCGGCAT", "+" * 9, 2, 9), (1, "a", False, False, "ATGCA", "+" * 5, 2, 5), (2, "a", False, True, "CAGCGGCAT", "+" * 9, 0, 9)]
    reads = spark.createDataFrame(rows, "rec long, rg string, second boolean, reverse boolean, seq string, qual string, aln_start int, aln_end int")
    got = align.aligned_covariates(reads).groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("pos", "clip_dinuc", "dinuc"))).alias("x")).collect()
    clip, whole = ({r.rec: [x[k] for x in r.x] for r in got} for k in ("clip_dinuc", "dinuc"))
    pairs = ["AT", "TG", "GC", "CC", "CG", "GC", "CT", "TG"]
    full = [4 * "ATGC".index(a) + "ATGC".index(b) for a, b in pairs]
    assert clip[2] == whole[2] == [*reversed(full), -1]
    assert clip[0] == [0, 0, *[*reversed(full), -1][2:]]
    assert clip[1] == [0, 0, -1, 11, 12] and whole[1] == [-1, 1, 6, 11, 12]


def test_aligned_part(spark):
    for cigar, n, part in (("9M", 9, (0, 9)), ("2S7M", 9, (2, 9)), ("3H2S4M1D3M2S1H", 11, (2, 9)), ("1M9H", 1, (0, 1)), ("4M5S", 9, (0, 4))):
        start, end = aligned.aligned_part(F.lit(cigar), F.lit(n))
        assert one(spark, a=start, b=end) == part
    assert one(spark, n=aligned.reference_span(F.lit("2S8M2I4M1D3M"))).n == 16


def test_new_qualities_of_alignments(spark):
    row = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    shifts = model.Model(
        row("rg string, mean_q int, delta int", ("0", 10, 1)),
        row("rg string, q int, delta int", ("0", 7, 2)),
        row("rg string, q int, cycle int, delta int", *(("0", 7, k, 3) for k in range(3))),
        row("rg string, q int, dinuc int, delta int", *(("0", 7, k, 5) for k in range(-1, 16))),
    )
    reads = row("rec long, rg string, second boolean, reverse boolean, seq string, qual string", (1, "0", False, False, "ATG", "((#"))
    assert [r.qual for r in aligned.recalibrate_alignments(reads, shifts).collect()] == ["66#"]  # 21, 21, 2


def test_counts_of_a_clipped_alignment(spark, files, tmp_path):
    """One base of original quality 7 on a reference that agrees: one observation, no error, and a report that makes a model."""
    (tmp_path / "c.sam").write_text("@SQ\tSN:ref\tLN:45\n@RG\tID:0\tPU:unit\nclipped\t0\tref\t9\t255\t1M9H\t*\t0\t0\tA\t#\tRG:Z:0\tOQ:Z:(\tOQ:Z:(\n")
    stored = alignments.read_sam(spark, f"{tmp_path}/c.sam")
    reads = aligned.alignment_reads(stored, alignments.read_groups(spark, f"{tmp_path}/c.sam"))
    bins = align.site_bins(sites.read_fasta(spark, f"{files}/ref.fa"), align.variant_spans(sites.read_vcf(spark, f"{files}/v.vcf")))
    counts = aligned.aligned_counts(reads, bins)
    assert [tuple(r) for r in counts.collect()] == [("unit", 7, 0, -1, 0, 1)]
    own = aligned.model_of_report(aligned.alignment_report(reads, bins))
    assert [(r.rg, r.mean_q, r.total) for r in own.rg.collect()] == [("unit", 7.0, 1)]
    assert len(aligned.recalibrate_alignments(reads, own).collect()) == 1
    assert aligned.alignment_reads(stored, use_original=False).collect()[0].qual == "#"


def test_quality_above_the_range_fails(spark):
    rows = spark.createDataFrame([("a", 43, 0, -1, False, False)], "rg string, q int, cycle int, dinuc int, error boolean, skip boolean")
    with pytest.raises(Exception, match="above the model's range"):
        model.finest_counts(rows).collect()


def test_names(spark):
    name = F.lit("r001/2_x:y_RG:Z:foo")
    assert one(spark, a=names.read_group_anywhere(name), b=names.bare_name(name), c=names.second_in_pair(name)) == ("foo", "r001", True)
    assert one(spark, a=names.read_group_field(F.lit("r/1_RG:Z:FOO"))).a == "FOO"
    with pytest.raises(Exception, match="no read group"):
        one(spark, a=names.read_group_field(F.concat(F.lit("r/1_x"), F.col("id").cast("string"))))


def test_adaptor_and_trim(spark):
    no, yes = F.lit(False), F.lit(True)
    ask = lambda start, end, tlen, mate, rev, mate_rev: one(spark, b=align.adaptor_boundary(*map(F.lit, (start, end, tlen, mate)), yes, no, no, F.lit(rev), F.lit(mate_rev))).b
    assert ask(6, 22, 39, 36, False, True) == 45 and ask(36, 45, -39, 6, True, False) == 5
    assert ask(6, 22, 0, 36, False, True) is None and ask(6, 22, 39, 36, False, False) is None
    rows = [(0, 36, "9M", True, 36), (1, 6, "8M2I4M1D3M", False, 21), (2, 6, "8M2I4M1D3M", False, 13), (3, 6, "8M2I4M1D3M", False, 14), (4, 6, "8M2I4M1D3M", False, 18)]
    got = align.trimmed(spark.createDataFrame(rows, "rec long, pos int, cigar string, reverse boolean, boundary int")).groupBy("rec").agg(F.sort_array(F.collect_list("read_pos")).alias("p"))
    assert {r.rec: r.p for r in got.collect()} == {0: [0], 1: [16], 2: list(range(7, 17)), 3: list(range(10, 17)), 4: [14, 15, 16]}


def test_calibration_and_quantized(spark):
    rows = [(3, False), (2, True), (1, True)] + [(1, False)] * 100
    table = calibration.calibration_table(spark.createDataFrame(rows, "q int, error boolean").withColumn("skip", F.lit(False)), "x")
    assert {(r.predicted_q, r.actual_q, r.n_bases) for r in table.collect()} == {(1, 20, 101), (2, 0, 1), (3, 42, 1)}
    scores = calibration.quantized(spark.createDataFrame([(0, 1000)], "q int, total long")).orderBy("quality_score").collect()
    assert [r.quantized_score for r in scores] == [0] + [93] * 93
    with pytest.raises(ValueError):
        calibration.plot_rows(table, "pie")


def test_report_text(spark):
    text = """#:GATKTable:6:2:%s:%s:%.4f:%.4f:%d:%.2f:;
#:GATKTable:RecalTable0:
ReadGroup                   EventType  EmpiricalQuality  EstimatedQReported  Observations  Errors 
HJCMTCCXX160113.5.AAGGATGT  M                   22.0000             24.3199        210398  1382.00
HK2WYCCXX160124.1.AAGGATGT  M                   22.0000             24.3994        196298  1391.00"""
    assert report_file.parse_table(text).text() == text
    whole = report_file.format_report([report_file.parse_table(text)])
    assert report_file.format_report(report_file.parse_report(whole)) == whole
    with pytest.raises(ValueError):
        report_file.parse_report(whole.replace("v1.1:1", "v1.1:2"))


def test_report_round_trip(spark, tmp_path):
    rows = [("a", 10, 0, 1, 2, 100), ("a", 10, -2, 7, 1, 50), ("b", 20, 3, -1, 0, 10)]
    finest = spark.createDataFrame(rows, "rg string, q int, cycle int, dinuc int, errors long, total long")
    tables = report_file.collect_report(report.report_tables(finest))
    (tmp_path / "r.txt").write_text(report_file.format_report(tables))
    back = report.counts_from_report(report_file.read_report(spark, f"{tmp_path}/r.txt"))
    assert {tuple(r) for r in back["cycle"].select("rg", "q", "cycle", "errors", "total").collect()} == {(a, q, c, e, t) for a, q, c, _, e, t in rows}
    assert {tuple(r) for r in back["dinuc"].select("rg", "q", "dinuc", "total").collect()} == {("a", 10, 1, 100), ("a", 10, 7, 50)}


def test_bam_equals_sam(spark, files, tmp_path):
    import struct
    import zlib

    def block(data):
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(data) + packer.flush()
        return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))

    def record(flag, pos, cigar, mate, tlen, seq, qual, tags):
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(16 * a + b for a, b in zip(codes[::2], codes[1::2]))
        ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar)
        body = struct.pack("<iiBBHHHIiii", 0, pos, 5, 30, 0, len(cigar), flag, len(seq), 0, mate, tlen) + b"r001\0" + ops + packed + bytes(ord(c) - 33 for c in qual) + tags
        return struct.pack("<i", len(body)) + body

    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 4) + b"ref\0" + struct.pack("<i", 45)
    first = record(99, 6, [(8, "M"), (2, "I"), (4, "M"), (1, "D"), (3, "M")], 36, 39, "TTAGATAAAGGATACTG", "==99=?<*+/5:@A99:", b"")
    second = record(147, 36, [(9, "M")], 6, -39, "CAGCGGCAT", "><>???>>>", b"NMi" + struct.pack("<i", 1))
    data = head + first + second
    (tmp_path / "a.bam").write_bytes(block(data[:70]) + block(data[70:]) + block(b""))
    same = lambda df: sorted(tuple(r) for r in df.drop("rec").withColumn("tags", F.map_entries("tags")).collect())
    assert same(alignments.read_bam(spark, [f"file://{tmp_path}/a.bam"])) == same(alignments.read_sam(spark, f"{files}/a.sam"))
