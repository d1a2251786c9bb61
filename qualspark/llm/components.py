"""Connected components of an edge table by repeated contraction; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

_MOST_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a long, b long), root the smallest node of its component.

    Each round every node points at its neighbour with the smallest hash of the round, itself included, and edges are
    rewritten by these pointers: a random order, so a constant share of the nodes is expected to go, along chains too.
    Self-loops and repeats are fine, nulls are not.
    """
    edges = materialize(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b"), "cc-edges")
    roots = None
    for k in range(_MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        drawn = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        point = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(drawn("a")), F.min(drawn("b"))).alias("x")).select("node", "x.to")
        point = materialize(point, "cc-point")
        if roots is None:
            roots = point.select("node", F.col("to").alias("root"))
        else:
            old, moved = roots, roots.join(point.withColumnRenamed("node", "root"), "root", "left")
            roots = materialize(moved.select("node", F.coalesce("to", "root").alias("root")), "cc-roots")
            if hasattr(old, "scratch_path"):
                discard(old)
        left, right = (point.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        done = edges
        edges = materialize(edges.join(left, "a").join(right, "b").where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "cc-edges")
        discard(done)
        if edges.isEmpty():
            least = roots.groupBy("root").agg(F.min("node").alias("least"))
            named = materialize(roots.join(least, "root").select("node", F.least("least", "root").alias("root")), "components")
            discard(edges, point, *([roots] if hasattr(roots, "scratch_path") else []))
            return named
    raise RuntimeError("components did not converge")
