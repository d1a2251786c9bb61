"""Vector codes, removal of repeated passages and phrases: parts on their own, and small tables with odd rows."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from qualspark.llm import collocations, substring_dedup, vector_codes
from qualspark.llm.hat_trie import Branch, HatTrie

DOCS = "doc_id long, text string, lang string, source string, id string, mark long, at string, raw string, k int"


def docs(spark, rows):
    """Rows (doc_id, text, lang) with columns that clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, "s", "x", 1, "y", "z", 3) for i, t, lang in rows], DOCS)


# --- vector codes ---------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [1, 2, 4, 8, 32])
def test_sequency(n):
    rows = vector_codes.sequency_transform(np.eye(n, dtype=np.int64)).T
    assert [int((a[1:] != a[:-1]).sum()) for a in rows] == list(range(n))
    assert (rows @ rows.T == n * np.eye(n)).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 12), st.integers(0, 2**31), st.sampled_from([2, 40, 10**6, 10**30]))
def test_nearest_is_exact(width, k, seed, most):
    r = random.Random(seed)
    draw = lambda n: [[r.randint(-most, most) for _ in range(width)] for _ in range(n)]
    x, entries = draw(7), draw(k)
    codes, far = vector_codes.assign(np.array(x, dtype=object), np.array([entries], dtype=object))
    want = [min((sum((a - b) ** 2 for a, b in zip(v, e)), j) for j, e in enumerate(entries)) for v in x]
    assert [(int(d), int(c)) for d, c in zip(far[:, 0], codes[:, 0])] == want


def test_vector_codes_edges(spark):
    r = random.Random(4)
    vector = lambda: [r.uniform(-2, 2) for _ in range(32)]
    same = vector()
    rows = [(i, vector(), i % 3) for i in range(150)] + [(7, same, None), (7, same, None), (7, vector(), 1), (None, vector(), None), (-1, [1e5] * 32, 2)]
    rows += [(200, None, 1), (201, [], 1), (202, [None] + same[1:], 1), (203, [float("nan")] + same[1:], 1), (204, [float("-inf")] + same[1:], 1)]
    rows += [(300 + i, same, 9) for i in range(60)]
    table = spark.createDataFrame([(i, v, x, "c", 1) for i, v, x in rows], "vec_id long, embedding array<double>, label int, code string, error int")
    got = vector_codes.encode_vectors(table.repartition(5))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute.vector_codes(rows))
    few = rows[:5]
    assert Counter(tuple(r) for r in vector_codes.encode_vectors(spark.createDataFrame(few, "vec_id long, embedding array<float>, label string")).collect()) == Counter(brute.vector_codes([(i, [float(np.float32(x)) for x in v], x) for i, v, x in few]))
    assert vector_codes.encode_vectors(table.limit(0)).collect() == []
    assert vector_codes.encode_vectors(table.where("vec_id in (200, 203)")).collect() == []
    with pytest.raises(Exception, match="one length"):
        vector_codes.encode_vectors(spark.createDataFrame([(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)], "vec_id long, embedding array<double>, label int").coalesce(1)).collect()


# --- passages -------------------------------------------------------------------------------------------------------
def test_cover():
    assert substring_dedup.is_cover((0, 1, 3, 9), 13) and substring_dedup.is_cover((0, 1, 3), 7) and not substring_dedup.is_cover((0, 1, 2), 13)
    # Equal windows share an aligned anchor wherever they stand.
    for i in range(13):
        for j in range(13):
            assert any((i + d) % 13 in (0, 1, 3, 9) and (j + d) % 13 in (0, 1, 3, 9) for d in range(13))


def test_slices():
    raw = b"ab  cd\tefghijkl\nm " * 50
    for size in (1, 3, 7, 1000):
        parts = list(substring_dedup.slices(raw, size))
        assert b"".join(parts) == raw and [w for p in parts for w in p.split()] == raw.split()


def _passage_rows():
    r = random.Random(8)
    w = lambda n, v=50_000: " ".join(f"w{r.randrange(v)}" for _ in range(n))
    passage, other, short = w(55), w(30), w(19)
    long = w(4000)
    edited = long.split()
    edited[100] = edited[2000] = "changed"
    rows = [(i, f"{w(r.randrange(40))} {passage} {w(r.randrange(40))}", "a") for i in range(40, 60)]
    rows += [(1, long, "a"), (2, " ".join(edited), "b"), (3, f"{w(13)} {long}", None), (4, f"{passage}\n{passage}\t{other}", "a"), (5, other, "a"), (6, short, "a"), (7, short, "a")]
    rows += [(8, None, "a"), (9, "", "a"), (10, " \t\r\n", "a"), (11, "one", "a"), (12, "x " * 400, "a"), (13, "é " + "x " * 90, "a")]
    rows += [(20, passage, "a"), (20, passage, "a"), (20, f"{w(20)} {passage}", "b"), (None, passage, "a"), (None, f"{passage} {other}", "a"), (-5, other + " tail", "a")]
    return rows


def test_passages_edges(spark, monkeypatch):
    rows = _passage_rows()
    got = substring_dedup.remove_repeats(docs(spark, rows).repartition(4))
    want = Counter(brute.passages([(i, t) for i, t, _ in rows]))
    assert Counter(tuple(r)[:4] for r in got.collect()) == want
    assert substring_dedup.remove_repeats(docs(spark, []).limit(0)).collect() == []
    other = substring_dedup.remove_repeats(docs(spark, rows), window=9, period=7, cover=(0, 1, 3))
    assert Counter(tuple(r)[:4] for r in other.collect()) == Counter(brute.passages([(i, t) for i, t, _ in rows], 9))
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(docs(spark, rows), cover=(0, 1))


def test_kept_text(spark):
    rows = _passage_rows()
    for r in substring_dedup.remove_repeats(docs(spark, rows)).collect():
        assert len(bytes(r.kept).split()) == r.n_words - r.n_removed


# --- phrases --------------------------------------------------------------------------------------------------------
@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=4).map(tuple), max_size=300), st.integers(1, 5))
def test_hat_trie(sequences, burst):
    trie = HatTrie(burst)
    for low in range(0, len(sequences), 50):
        trie.add(sequences[low : low + 50], [2] * len(sequences[low : low + 50]))
    want = Counter(sequences)
    assert trie.size == len(want)
    if len({s for s in want if s[0] == 3}) > burst:
        assert type(trie.root[3]) is Branch
    taken = list(trie.take(len(want) // 2))
    assert trie.size <= len(want) // 2 or not taken
    heads = {s[0] for s, _ in taken}
    rest = list(trie.take())
    assert not heads & {s[0] for s, _ in rest}  # whole subtrees leave
    assert dict(taken + rest) == {s: 2 * n for s, n in want.items()} and trie.size == 0


def _phrase_rows():
    r = random.Random(2)
    words = [f"w{k}" for k in range(40)] + ["New", "york", "CITY", "état", "Ä", "x\x1fy"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ". ", "\n", " ,", "! "]) for _ in range(n))
    rows = [(i, text(120) + " new york city is big. of the Of the", r.choice(["en", "de", None, "und"])) for i in range(120)]
    rows += [(500, None, "en"), (501, "", None), (502, ". . ,", "fr"), (503, "of the " * 3000, "en"), (503, "of the " * 3000, "en"), (504, "a" * 3000 + " b", "es")]
    return rows


@pytest.mark.parametrize("chunk", [1 << 21, 64])
def test_phrases_edges(spark, monkeypatch, chunk):
    rows = _phrase_rows()
    want = Counter(brute.phrases([(t, lang) for _, t, lang in rows], 4, 25))
    assert len(want) > 50
    for name, value in (("_CHUNK", chunk), ("_HELD", 200), ("_NAMES", 30)):
        monkeypatch.setattr(collocations, name, value)
    table = docs(spark, rows).repartition(3)
    got = collocations.collocations(table, least=4, top=25)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert collocations.collocations(docs(spark, []).limit(0)).collect() == []


def test_runs_in_slices(monkeypatch):
    """Word runs of a text cut into slices count every phrase once."""
    import pyarrow as pa

    monkeypatch.setattr(collocations, "_CHUNK", 30)
    text = " ".join(f"v{k % 7}" for k in range(200)) + ". " + " ".join(f"v{k % 3}" for k in range(50))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text.encode()])], ["lang", "raw"])
    got = Counter()
    for _, words, carried in collocations.word_runs(batch):
        for k in range(1, 5):
            got.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1) if i + k > carried and b"." not in words[i : i + k])
    want = Counter()
    for piece in text.encode().split(b"."):
        w = piece.split()
        for k in range(1, 5):
            want.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    assert got == want


def test_cells_keep_what_is_frequent():
    cells = collocations.Cells(20, 30)
    for _ in range(3):
        cells.add(np.array([5] * 12 + [9] * 9))
    (row,) = cells.rows(1)
    import zstandard

    plain = zstandard.ZstdDecompressor().decompress
    at, n = np.cumsum(np.frombuffer(plain(row[4]), np.uint32)), np.frombuffer(plain(row[5]), np.uint32)
    assert at.tolist() == [5, 9] and n.tolist() == [30, 27]
