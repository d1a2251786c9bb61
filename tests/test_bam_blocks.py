"""One BAM file over many tasks gives the rows of its SAM text, wherever ranges and blocks cut it."""

import random
import struct
import zlib

import pytest

from qualspark.sources import alignments, bam_blocks

LETTERS = "=ACMGRSVTWYHKDBN"


def block(data):
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(r, k):
    n = r.choice([1, 5, 60, 151, 900])
    seq, qual = "".join(r.choice("ACGTN") for _ in range(n)), [r.randrange(0, 42) for _ in range(n)]
    name, pos = f"read{k}", r.randrange(10_000)
    codes = [LETTERS.index(c) for c in seq] + [0] * (n % 2)
    packed = bytes(16 * a + b for a, b in zip(codes[::2], codes[1::2]))
    tags = b"RGZgroup\0" + b"NMC" + bytes([k % 200])
    body = struct.pack("<iiBBHHHIiii", k % 2, pos, len(name) + 1, 30, 0, 1, 16 * (k % 2), n, -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", n << 4) + packed + bytes(qual) + tags
    line = "\t".join([name, str(16 * (k % 2)), ("one", "two")[k % 2], str(pos + 1), "30", f"{n}M", "*", "0", "0", seq, "".join(chr(q + 33) for q in qual), "RG:Z:group", f"NM:i:{k % 200}"])
    return struct.pack("<i", len(body)) + body, line


@pytest.fixture(scope="module")
def stored(tmp_path_factory):
    r, d = random.Random(6), tmp_path_factory.mktemp("bam")
    text = "@HD\tVN:1.6\n@SQ\tSN:one\tLN:20000\n@SQ\tSN:two\tLN:20000\n@RG\tID:group\tPU:unit\n@RG\tID:other\tPU:unit2\n"
    head = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", 2) + b"".join(struct.pack("<i", 4) + n + b"\0" + struct.pack("<i", 20000) for n in (b"one", b"two"))
    made = [record(r, k) for k in range(1500)]
    data, at, blocks = head + b"".join(x for x, _ in made), 0, []
    while at < len(data):
        n = r.choice([3, 40, 700, 5000, 20000])  # blocks end within records, length fields included
        blocks.append(block(data[at : at + n]))
        at += n
    (d / "a.bam").write_bytes(b"".join(blocks) + block(b""))
    (d / "a.sam").write_text(text + "".join(line + "\n" for _, line in made))
    return d


def rows(df, *drop):
    from pyspark.sql import functions as F

    return sorted(tuple(x) for x in df.drop(*drop).withColumn("tags", F.array_sort(F.map_entries("tags"))).collect())


@pytest.mark.parametrize("size", [1 << 30, 40_000, 9_000])
def test_ranges(spark, stored, size):
    path = f"file://{stored}/a.bam"
    ranges = bam_blocks.found_ranges(spark, [path], size).collect()
    if size < 1 << 30:
        assert len(ranges) >= 8 and all(x.n > 0 for x in ranges)
    got = alignments.read_bam(spark, [path], size)
    assert rows(got, "rec") == rows(alignments.read_sam(spark, f"{stored}/a.sam"), "rec")
    assert [(x.rec, x.qname) for x in got.orderBy("rec").collect()] == [(k, f"read{k}") for k in range(1500)]


def test_ranges_smaller_than_records(spark, stored):
    got = alignments.read_bam(spark, [f"file://{stored}/a.bam"], 1500)
    assert [(x.rec, x.qname) for x in got.orderBy("rec").select("rec", "qname").collect()] == [(k, f"read{k}") for k in range(1500)]


def test_a_wrong_guess_is_noticed(spark, stored, monkeypatch):
    """A range that begins at a wrong place makes its file be read from the start, with the same rows."""
    found = bam_blocks.find_records

    def shifted(path, k, start, stop):
        first, total, over, n = found(path, k, start, stop)
        return (first + 5 if k == 3 else first), total, over, n

    path = f"file://{stored}/a.bam"
    monkeypatch.setattr(bam_blocks, "find_records", shifted)
    (only,) = bam_blocks.found_ranges(spark, [path], 30_000).collect()
    assert (only.start, only.first, only.n) == (0, -1, -1)
    assert alignments.read_bam(spark, [path], 30_000).count() == 1500


def test_unsound_records_are_read_by_lengths(spark, tmp_path):
    """A position below -1 is no reason to lose a file's records, the first one's or a later one's."""
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", 4) + n + b"\0" + struct.pack("<i", 20000) for n in (b"one", b"two"))
    r = random.Random(2)
    made = [record(r, k)[0] for k in range(60)]
    for at in (0, 40):
        odd = [x if k != at else x[:8] + struct.pack("<i", -7) + x[12:] for k, x in enumerate(made)]
        (tmp_path / f"{at}.bam").write_bytes(b"".join(block(x) for x in [head, *odd, b""]))
        for size in (1 << 30, 3_000):
            got = alignments.read_bam(spark, [f"file://{tmp_path}/{at}.bam"], size).orderBy("rec").collect()
            assert [x.qname for x in got] == [f"read{k}" for k in range(60)] and got[at].pos == -7


def test_bam_read_groups(spark, stored):
    assert [tuple(x) for x in alignments.bam_read_groups(spark, f"file://{stored}/a.bam").collect()] == [("group", "unit", 0), ("other", "unit2", 1)]


def test_no_records_and_other_files(spark, tmp_path):
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 0)
    (tmp_path / "empty.bam").write_bytes(block(head) + block(b""))
    (tmp_path / "no.bam").write_bytes(block(b"something else") + block(b""))
    assert alignments.read_bam(spark, [f"file://{tmp_path}/empty.bam"]).collect() == []
    with pytest.raises(Exception, match="not a BAM file"):
        alignments.read_bam(spark, [f"file://{tmp_path}/no.bam"]).collect()
