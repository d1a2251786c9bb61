"""Benchmark decontamination: rare shared n-grams join passages to items, Smith-Waterman scores them.

1. The word n-grams of all benchmark items are looked up in the corpus in one pass; hits keep their places, and their
   number is how common an n-gram is.
2. An alignment that scores `threshold` keeps, of an item of L words, at least t = (2 * threshold - 1) * L - 2 of its
   n-grams of 3 words where words were replaced or left out, as each such edit costs a share of the score and breaks
   few of them. So two (one if t is 1) of an item's n-grams without its t - 2 commonest open a passage: a line that many
   items and documents share is among the commonest and opens none, unless it makes up most of what an item may keep.
3. Openings of a document on an item are gathered by block of diagonals. Blocks overlap by the length that insertions can
   add, and a passage is its block with that much and the item's length around it, so an alignment lies whole within one.
4. The passage is aligned with the item by Smith-Waterman over words, edited and paraphrased words costing little, and
   its score is a share of what the item scores with itself. Passages that hold too few of the item's words are passed by.

Seeds meet the corpus in an ordinary equi-join, so Spark broadcasts a benchmark below its size threshold and shuffles a
larger one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sized_broadcast

MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of an item from which seeds of SEED words tell its copies; shorter items need SHORT_SEED words in a row.
LONG_ITEM, SEED, SHORT_SEED = 12, 3, 5
#: Rows up to which the list of candidate documents is broadcast; above, the join is shuffled.
BROADCAST_ROWS = 1_000_000


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null: none."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), "")


def grams(words: str, n: int) -> Column:
    """Hashes of the word n-grams of array column `words`; none if it is shorter."""
    own = lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n)))
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), own)).otherwise(F.array().cast("array<bigint>"))


def seed_hits(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """Every place where a document holds an n-gram of an item: doc_id, mark (of the text), at, gram, written out."""
    wanted = items.select(F.explode("grams").alias("gram")).distinct()
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), plain_words(F.col("text")).alias("words"))
    held = words.select("doc_id", "mark", F.posexplode(grams("words", n)).alias("at", "gram"))
    return materialize(held.join(wanted, "gram").distinct(), "leak-hits")


def openings(items: DataFrame, hits: DataFrame, n: int, threshold: float) -> DataFrame:
    """Blocks of diagonals where enough of an item's rarer n-grams stand: doc_id, mark, item_id, start, length (the passage)."""
    common = hits.groupBy("gram").agg(F.count("*").alias("df"))
    size = F.size("words")
    # Edits of short items (sought by their longer n-grams) may leave one.
    need = F.when(size >= LONG_ITEM, F.greatest(F.lit(1), F.ceil(F.lit(2 * threshold - 1) * size).cast("int") - (n - 1))).otherwise(1)
    placed = items.select("item_id", size.alias("size"), need.alias("need"), F.least(need, F.lit(2)).alias("open"), F.size("grams").alias("n_grams"), F.posexplode("grams").alias("k", "gram")).join(common, "gram", "left")
    rarity = Window.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "gram", "k")
    rarer = placed.withColumn("rank", F.row_number().over(rarity)).where((F.col("rank") <= F.col("n_grams") - F.col("need") + F.col("open")) & (F.col("df") > 0))
    shift, step = F.col("at") - F.col("k"), 2 * F.col("size")
    slack = F.ceil(F.lit(2 - 2 * threshold) * F.col("size")).cast("int")
    met = hits.join(rarer.select("item_id", "size", "open", "k", "gram"), "gram")
    blocks = met.select("doc_id", "mark", "item_id", "size", "open", "k", F.explode(F.sequence(F.floor((shift - slack - 1) / step), F.floor(shift / step))).alias("block"))
    enough = blocks.groupBy("doc_id", "mark", "item_id", "size", "open", "block").agg(F.size(F.collect_set("k")).alias("held")).where(F.col("held") >= F.col("open"))
    start = F.greatest(F.col("block") * step - slack, F.lit(0))
    end = (F.col("block") + 1) * step + 2 * slack + F.col("size")
    return enough.select("doc_id", "mark", "item_id", start.cast("long").alias("start"), F.greatest(end - start, F.lit(0)).cast("int").alias("length"))


def align(a: np.ndarray, b: np.ndarray) -> int:
    """Best local alignment score of two sequences of word numbers, a row at a time."""
    best = 0
    ramp = GAP * np.arange(len(b) + 1)
    last = np.zeros(len(b) + 1, dtype=np.int64)
    for word in a:
        row = np.zeros(len(b) + 1, dtype=np.int64)
        row[1:] = np.maximum(0, np.maximum(last[:-1] + np.where(b == word, MATCH, MISMATCH), last[1:] + GAP))
        # Gaps within the row: a running maximum of scores with the gap cost taken out.
        row = np.maximum(np.maximum.accumulate(row - ramp) + ramp, 0)
        best = max(best, int(row.max()))
        last = row
    return best


def leak_scores(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.6) -> DataFrame:
    """Passages that score `threshold` or more: doc_id, mark, item_id, start (where the passage that was aligned begins, a
    word), score (to 1), the best per document and item; of equal scores the first passage.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Null or empty texts on either side match
    nothing. Items of fewer than 5 words are sought as wholes, word for word; those of fewer than 12 need 5 words in a
    row. Longer items are found, at the score of an alignment with the whole text, wherever words were replaced or left
    out, and with insertions as long as two runs of 4 words of those rarer stay. Rows that repeat an item or a document
    give their results once. A long text is aligned in its passages alone, each a few times the item's length.
    """
    bench = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), plain_words(F.col("text")).alias("words")).where("size(words) > 0")
    # An id with several texts stands for each of them: they are told apart while passages are sought.
    bench = bench.distinct().select(F.struct("item_id", F.xxhash64("words").alias("version")).alias("item_id"), "words")
    bench = materialize(bench, "leak-items")
    length = F.size("words")
    width = F.when(length >= LONG_ITEM, SEED).when(length >= SHORT_SEED, SHORT_SEED).otherwise(length)
    found = None
    for n, long in sorted((r[0], r[1]) for r in bench.select(width, length >= LONG_ITEM).distinct().collect()):  # at most 6 rows
        part = bench.where((width == n) & ((length >= LONG_ITEM) == F.lit(long))).withColumn("grams", grams("words", n))
        own = openings(part, seed_hits(docs, part, n), n, threshold)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, mark long, item_id long, start long, score double")
    passages = materialize(found, "leak-passages")
    ids = passages.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m")).distinct()
    cond = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_m"))
    texts = docs.select("doc_id", "text").join(sized_broadcast(ids, BROADCAST_ROWS), cond).select(F.col("_d").alias("doc_id"), F.col("_m").alias("mark"), "text").dropDuplicates(["doc_id", "mark"])
    texts = texts.select("doc_id", "mark", plain_words(F.col("text")).alias("words"))
    right = bench.select("item_id", F.col("words").alias("item_words"))
    passage = F.slice("words", (F.col("start") + 1).cast("int"), F.col("length")).alias("passage")
    met = passages.join(texts, passages["doc_id"].eqNullSafe(texts["doc_id"]) & (passages["mark"] == texts["mark"])).select(passages["doc_id"], passages["mark"], "item_id", "start", passage)
    cut = met.join(right, "item_id").select("doc_id", "mark", F.col("item_id.item_id").alias("item_id"), "start", "passage", "item_words")

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            at, out = [], []
            for row, (passage, item) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                held = set(passage)
                # Every matched word of the item stands in the passage: fewer than its share cannot reach the score.
                if sum(w in held for w in item) < threshold * len(item):
                    continue
                number = {}
                a, b = (np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64) for words in (item, passage))
                if (best := align(a, b) / (MATCH * len(a))) >= threshold:
                    at.append(row)
                    out.append(best)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[:4]), pa.array(out, pa.float64())], ["doc_id", "mark", "item_id", "start", "score"])

    scored = cut.mapInArrow(score, "doc_id long, mark long, item_id long, start long, score double")
    best = scored.groupBy("doc_id", "mark", "item_id").agg(F.max(F.struct("score", (-F.col("start")).alias("s"))).alias("b"))
    return best.select("doc_id", "mark", "item_id", (-F.col("b.s")).alias("start"), F.col("b.score").alias("score"))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.6, **options) -> DataFrame:
    """Documents with a passage that scores `threshold` or more: doc_id, mark, item_ids, score (the highest)."""
    scores = leak_scores(docs, benchmark, threshold=threshold, **options)
    return scores.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("score").alias("score"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` without contaminated documents; all columns stay, and so do rows with null or empty texts."""
    from .common import packed

    bad = materialize(contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m")), "leak-documents")
    own = packed(docs, F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_mark"))
    kept = own.join(sized_broadcast(bad, BROADCAST_ROWS), F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_mark") == F.col("_m")), "left_anti")
    return kept.select("_row.*")
