"""Each registered query on whole given tables, against its plain version or its held-out accuracy."""

from collections import Counter, defaultdict

import brute
import pytest

from qualspark.llm import queries as q


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def test_op1(spark, sf_dir, docs):
    want = brute.token_ids(docs, q._tokenizer(), 1)
    got = q.op1_token_ids(spark, sf_dir).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(docs)


def test_op2(spark, sf_dir, docs):
    got = q.op2_ngram_jaccard(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard(docs, 4, 85, 100)


def test_op3(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest tables hold too few toxic rows to learn from
    got = q.op3_toxicity(spark, sf_dir).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    pairs = [(a > b) + 0.5 * (a == b) for a, y in held if y for b, z in held if not z]
    assert not pairs or sum(pairs) / len(pairs) > 0.8


def test_op4(spark, sf_dir, docs):
    want = {i: brute.secrets(t) for i, t in docs}
    got = q.op4_secrets(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got} == want


def test_op5(spark, sf_dir, docs):
    """What an alignment of every item with every whole text finds, and its scores."""
    from test_operators import plain_scores

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {}
    for (doc, item), score in plain_scores(docs, items).items():
        if score >= 0.6:
            want.setdefault(doc, {})[item] = score
    got = q.op5_decontaminate(spark, sf_dir).collect()
    assert {r.doc_id: (r.item_ids, r.score) for r in got} == {d: (sorted(s), max(s.values())) for d, s in want.items()}


def test_op6(spark, sf_dir, docs):
    got = q.op6_quality_rules(spark, sf_dir).collect()
    want = {i: brute.quality_stats(t) for i, t in docs}
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == want
    assert not any(r.kept and r.base_failed for r in got)


def test_op7(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(q._tokenizer())
    tokenizer.encode_special_tokens = True
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in docs}
    assert {r.doc_id: r.n_tokens for r in q.op7_token_counts(spark, sf_dir).collect()} == want


def test_op8(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert Counter(tuple(r) for r in q.op8_warc(spark, sf_dir).collect()) == brute.warc(pages)


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    got = con.execute(q.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert Counter(got.fetchall()) == Counter(tuple(r[c] for c in names) for r in q.QUERIES[name](spark, sf_dir).collect())


def test_op9(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()
    size = {r.doc_id: len(brute.WORD.findall(r.text or "")) for r in rows}
    by_source = defaultdict(int)
    for r in rows:
        by_source[r.source] += size[r.doc_id]
    want, taken = brute.targets(by_source), defaultdict(int)
    got = q.op9_mix(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == by_source[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    longest = max(size.values())
    assert all(abs(taken[s] - want[s]) <= longest for s in want)
    again = {r.doc_id: r.taken for r in q.op9_mix(spark, sf_dir).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_op10(spark, sf_dir):
    got = q.op10_site_quality(spark, sf_dir).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    known = [(r.kept, labels[r.doc_id]) for r in got if r.doc_id in labels]
    assert sum(k == (y == 1) for k, y in known) >= 0.9 * len(known)
