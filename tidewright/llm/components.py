"""Connected components of an edge table, by alternating star contractions.

Each round hangs the larger neighbours of every node on its smallest one
(large star), then the smaller ones (small star). Neighbours never meet in one task as a list: a
round is one aggregate of minima, combined before its shuffle, and one join with those, in which the few nodes
that have a large share of all edges are broadcast. Every round ends in a table in the
shared folder, so a lost executor repeats one round at most; the table before it is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import join_keyed, materialize, release


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One contraction of edges (a, b) with a > b; ``total``: at most the number of them."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    joined = join_keyed(both, low, ["a"], "n", total)
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
    return moved.distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a and b, any order, repeats and loops allowed, no nulls.
    Returns node, root: the smallest node that each node with a link can reach, for all but the roots."""
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state[0] == 0 or state == before:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out.tidewright_path = now.tidewright_path
            return out
        before = state
        swung = materialize(_star(now, large=True, total=2 * state[0]))
        after = materialize(_star(swung, large=False, total=2 * state[0]))
        release(now, swung)
        now = after
