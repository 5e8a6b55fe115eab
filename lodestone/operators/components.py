"""Connected components by alternating star contraction, in grouped minima and joins only.

No step gathers a node's neighbours in one place: a group's minimum is a partial aggregate, and it returns to the edges by a
join that the adaptive planner can split.  Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut, release


def _key(node: Column) -> Column:
    """A join key that the grouping before isn't partitioned by, so that a hot partition of the join can be split."""
    return F.xxhash64(node, F.lit("join"))


def _with_minimum(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(_key(F.col("u")).alias("_k"), F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return edges.withColumn("_k", _key(F.col("u"))).join(least, "_k").filter("u = _u").select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` run from the larger end u to the smaller v."""
    joined = _with_minimum(edges)
    moved = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(joined.select("u", F.col("m").alias("v"))).distinct()


def star_forest(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of ``edges`` (u, v) the least node that it can reach; the least ones have no row.

    Self-loops, repeated edges and null ends may occur: edges with a null end are left out, and a self-loop gives no row.  An empty table gives no rows.  The graph must settle in ``max_rounds``, else it is an error.
    """
    e = cut(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        e = cut(_small_star(_large_star(e)))
        release(edges.sparkSession)
        # A star forest is a fixed point; its edges are as many as before and their ends sum to the same.
        row = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (row.n, row.s) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = (row.n, row.s)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``star_forest`` and a row for each least node, its own component."""
    found = star_forest(edges, max_rounds)
    return found.union(found.select("component", "component").distinct())
