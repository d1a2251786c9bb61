"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Within a source every document expects the same number of copies, target / size of the source. The expected copies
are summed up along the source's documents from one random offset on, and a document is emitted once for each integer
that its step crosses: 0 to 3 times. Documents stand in the order of their sizes, so that any stretch of picks has its
share of long and short ones and the taken words stay near the target.

The running sum of a large source is split: documents fall into cells (source, size class, salt), each numbered within
itself, and the cells' counts are summed per source. A cell is what one task sorts. Rows that repeat a document are one
row with a count there, so no repeated row fills a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, packed, sized_broadcast, words_of

#: Cells per size class of a source, whatever the table's size, so that the order of documents never depends on it.
SALTS = 64
#: Rows up to which the plan of a mix is broadcast to the texts; above, the join is shuffled.
BROADCAST_ROWS = 2_000_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Targets of sources: source, source_size, target, from one row per source (source, source_size).

    Sources by code point, null last, weigh `weights`, repeating, and share the sum of all sizes. A target stops at
    `most` times its source's size; the excess goes to the others by weight until none is above. That end state is
    target = min(cap, level * weight): with sources by cap / weight, those before some point are capped and the level
    of the rest follows from what is left, so running sums find it without iterating. One row per source meets in a
    window here, never documents.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    kind = F.pmod(F.row_number().over(ranked) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), kind + 1)
    own = sizes.select("source", "source_size", weight.alias("w"), (F.col("source_size") * most).cast("double").alias("cap"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    stepped = own.select("*", level.alias("level"), F.row_number().over(by_cap).alias("at"))
    # The first source in this order that its level leaves below its cap sets the level for all: by its place, as several may
    # have the same cap / weight, and the levels of the others there take the first one for capped.
    free = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("at", "level"))).over(everything)
    return stepped.select("source", "source_size", F.when(free.isNull(), F.col("cap")).otherwise(F.least("cap", free["level"] * F.col("w"))).alias("target"))


def _offset(seed: int) -> Column:
    """One number in [0, 1) per source, fixed by the seed."""
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("source"), F.lit("\0null"))), F.lit(1 << 52)).cast("double") / float(1 << 52)


def mix_to_weights(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), *, most: float = 3.0, seed: int = 17) -> DataFrame:
    """How often each document is taken: doc_id, source, size (words), source_size, target, copies, taken.

    docs: doc_id long, text string, source string; other columns are ignored. One row per input row. Null texts have
    size 0. A null source is one more source, last. Rows that repeat a doc_id are sampled each on its own. A source
    without words has target 0, and none of its documents is taken. The same rows and seed give the same result.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("mark"))
    cell = [F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("s"), F.floor(4 * F.log2(F.col("size") + F.lit(1.0))).cast("int").alias("c"), F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SALTS)).cast("int").alias("k")]
    sized = materialize(sized.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("n")).select("*", *cell), "mix-sizes")
    cells = sized.groupBy("s", "c", "k").agg(F.first("source").alias("source"), F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("size"))
    cells = materialize(cells, "mix-cells")
    sources = source_targets(cells.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    named = sources.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("s"), "source_size", "target", _offset(seed).alias("offset"))
    earlier = Window.partitionBy("s").orderBy("c", "k").rowsBetween(Window.unboundedPreceding, -1)
    counted = cells.select("s", "c", "k", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = counted.join(named, "s")
    within = Window.partitionBy("s", "c", "k").orderBy("size", F.xxhash64("doc_id", "mark"), "doc_id", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = sized.withColumn("at", F.sum("n").over(within)).join(placed, ["s", "c", "k"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    each = numbered.select("doc_id", "source", "size", "source_size", "target", "mark", "offset", rate.alias("rate"), F.explode(F.sequence(F.col("before") + F.col("at") - F.col("n") + 1, F.col("before") + F.col("at"))).alias("last"))
    copies = F.floor(F.col("offset") + F.col("last") * F.col("rate")) - F.floor(F.col("offset") + (F.col("last") - 1) * F.col("rate"))
    return each.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "mark")


def emit_mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), *, most: float = 3.0, seed: int = 17) -> DataFrame:
    """`docs` itself with each row as often as the mix takes it; all its columns stay, whatever their names.

    Rows that repeat doc_id, source and text are interchangeable: one of them stands for all of their copies. Only such
    rows move; the others meet the plan where they are, unless the plan is too large to broadcast.
    """
    plan = mix_to_weights(docs, weights, most=most, seed=seed)
    plan = plan.groupBy("doc_id", "source", "mark").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    plan = materialize(plan.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("mark").alias("_m"), F.col("_copies").cast("int").alias("_copies"), "_rows").where("_copies > 0"), "mix-plan")
    own = packed(docs, "doc_id", "source").withColumn("_mark", F.xxhash64(F.col("_row.text")))
    taken = lambda of: own.join(sized_broadcast(of, BROADCAST_ROWS), F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_mark") == F.col("_m")))
    hit = taken(plan.where("_rows = 1")).select("_row", "_copies")
    again = plan.where("_rows > 1")
    if not again.isEmpty():
        hit = hit.unionByName(taken(again).groupBy("_d", "_s", "_m", "_copies").agg(F.first("_row").alias("_row")).select("_row", "_copies"))
    return hit.select("_row", F.explode(F.sequence(F.lit(1), "_copies"))).select("_row.*")
