"""Registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A tokenizer file known by name to the public tokenizer package, used by the token queries.
TOKENIZER = "word_bpe_49k.json"
#: An id that ordinary text never encodes to when special strings count as text.
END_OF_DOCUMENT = 49407


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import encode_documents

    return encode_documents(spark, _table(spark, sf_dir, "documents"), _tokenizer(), end_id=1)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), width=4, num=85, den=100).drop("mark")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_report

    return secret_report(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contaminated document: doc_id, item_ids (benchmark items), score (the best alignment, 0 to 1)."""
    from .decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "item_ids", "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_quality_rules, fit_quality_rules

    docs = _table(spark, sf_dir, "documents")
    rules = fit_quality_rules(docs, _table(spark, sf_dir, "labels"))
    stats = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return apply_quality_rules(docs.select("doc_id", "text"), rules).select("doc_id", *(F.col(f"stats.{c}").alias(c) for c in stats), "base_failed", "kept", "rule")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from flat u16 files without an index: doc_id, ordinal (in its file), start, n_tokens."""
    from .common import materialize
    from .token_counts import scan_separators
    from .token_store import write_store

    manifest = write_store(_table(spark, sf_dir, "documents"), _tokenizer(), END_OF_DOCUMENT, dtype="<u2", special_as_text=True, index=False, ordered=False)
    keys = manifest.select("path", F.posexplode("keys").alias("ordinal", "doc_id"))
    found = materialize(scan_separators(manifest.select("path"), END_OF_DOCUMENT, dtype="<u2"), "token-counts")
    return keys.join(found, ["path", "ordinal"]).select("doc_id", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("ordinal").cast("long").alias("ordinal"), "start", "n_tokens")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_zip import read_packages, write_packages

    return read_packages(write_packages(_table(spark, sf_dir, "pages")))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_to_weights

    return mix_to_weights(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its own and its site's quality; a source is a host, a language of it a path."""
    from .site_quality import site_quality

    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return site_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), F.col("source"), path)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import encode_vectors

    return encode_vectors(_table(spark, sf_dir, "embeddings"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_ids": op1_token_ids,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_toxicity": op3_toxicity,
    "op4_secrets": op4_secrets,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_counts": op7_token_counts,
    "op8_warc": op8_warc,
    "op9_mix": op9_mix,
    "op10_site_quality": op10_site_quality,
    "op11_vector_codes": op11_vector_codes,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_collocations": op13_collocations,
}

# Vector codes: assignments a1, a2, a3 (distance and index in one number) and codebooks e0, e1, e2.
_ASSIGN_SQL = "a{n} AS (SELECT r, p, min(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) * 64 + k) AS m FROM parts JOIN e{e} USING (p) GROUP BY r, p)"
_REFINE_SQL = """s{n} AS (SELECT p, k, i, sum(y) AS s, count(*) AS n FROM (SELECT p, m % 64 AS k, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{n} JOIN parts USING (r, p)) GROUP BY p, k, i),
    e{n} AS (SELECT p, k, coalesce(u.c, e{e}.c) AS c FROM e{e} LEFT JOIN (SELECT p, k, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{n} GROUP BY p, k) u USING (p, k))"""
_CODES_SQL = ",\n    ".join(
    [
        "v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS z FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS (SELECT r, p, z[p * len(z) // 16 + 1 : (p + 1) * len(z) // 16] AS x FROM (SELECT r, z, unnest(range(16)) AS p FROM v))",
        "e0 AS (SELECT p, k, x AS c FROM parts JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v ORDER BY vec_id LIMIT 64) USING (r))",
        _ASSIGN_SQL.format(n=1, e=0),
        _REFINE_SQL.format(n=1, e=0),
        _ASSIGN_SQL.format(n=2, e=1),
        _REFINE_SQL.format(n=2, e=1),
        _ASSIGN_SQL.format(n=3, e=2),
    ]
)

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard": """WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS x FROM documents),
    shingles AS (SELECT DISTINCT r, unnest(CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 4 THEN [array_to_string(x, ' ')]
      ELSE list_transform(range(1, len(x) - 2), lambda k: array_to_string(list_slice(x, k, k + 3), ' ')) END) AS s FROM w),
    sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
    shared AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r),
    links AS (SELECT a, b FROM shared JOIN sizes p ON p.r = a JOIN sizes q ON q.r = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
    reach AS (SELECT r, doc_id AS c FROM w UNION SELECT l.b, reach.c FROM reach JOIN links l ON l.a = reach.r)
    SELECT w.doc_id, coalesce(n, 0) AS n_shingles, min(c) AS component_id FROM w JOIN reach USING (r) LEFT JOIN sizes USING (r) GROUP BY w.r, w.doc_id, n""",
    "op11_vector_codes": f"""WITH {_CODES_SQL},
    coded AS (SELECT p, r, m % 64 AS k, m // 64 AS d FROM a3),
    rows AS (SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM coded GROUP BY r),
    sums AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM rows JOIN v USING (r) GROUP BY label)
    SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, k, i)) FROM (SELECT p, k, unnest(c) AS x, unnest(range(len(c))) AS i FROM e2)) AS codebooks_sha256
    FROM rows JOIN v USING (r) JOIN sums ON sums.label IS NOT DISTINCT FROM v.label""",
    "op12_substring_dedup": """WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS x FROM documents),
    windows AS (SELECT r, doc_id, u.s AS s, u.k AS k FROM (SELECT r, doc_id, unnest(list_transform(range(1, len(x) - 18), lambda s: struct_pack(s := s, k := array_to_string(list_slice(x, s, s + 19), ' ')))) AS u FROM w)),
    judged AS (SELECT r, s, (doc_id, s) > min((doc_id, s)) OVER (PARTITION BY k) AS later FROM windows),
    gone AS (SELECT DISTINCT r, unnest(range(s, s + 20)) AS p FROM judged WHERE later),
    words AS (SELECT r, unnest(x) AS word, unnest(range(1, len(x) + 1)) AS p FROM w),
    kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
    SELECT doc_id, len(x) AS n_words, len(x) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)""",
    "op13_collocations": """WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
    runs AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_slice(w, i, i + k - 1))) AS w FROM (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM pieces) WHERE len(w) >= k),
    f AS (SELECT lang, k, w, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 30),
    totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
    cuts AS (SELECT lang, k, w, f AS a, unnest(range(1, k)) AS c FROM f WHERE k > 1),
    scored AS (SELECT c.lang, c.w, c.a, c.c, l.f AS l, r.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score FROM cuts c
      JOIN f l ON l.lang = c.lang AND l.w = list_slice(c.w, 1, c.c) JOIN f r ON r.lang = c.lang AND r.w = list_slice(c.w, c.c + 1, c.k)),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, c) = 1),
    parts AS (SELECT lang, f, w, k, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, f, w, k, unnest(range(2, k)) AS m FROM f WHERE k > 2)),
    around AS (SELECT lang, list_slice(w, i, i + m - 1) AS w, max(f) AS f FROM parts GROUP BY ALL),
    held AS (SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.w = b.w WHERE o.f IS NULL OR 100 * CAST(o.f AS HUGEINT) < 80 * CAST(b.a AS HUGEINT))
    SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM (SELECT *, array_to_string(w, ' ') AS phrase FROM held)) JOIN totals USING (lang) WHERE rank <= 2000""",
    "op8_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    first AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
    hex AS (SELECT p.page_id, p.html, f.first, sha1(p.html) AS h FROM p JOIN first f ON f.html = p.html)
    SELECT page_id, strlen(html) AS payload_bytes,
      list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(k // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) % 32 + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
      CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM hex""",
}
