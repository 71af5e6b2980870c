"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _minima(arcs: DataFrame) -> DataFrame:
    """Each u's smallest neighbour. Written out, so that the join that follows
    shuffles both of its sides itself and Spark may split a hub's rows."""
    return cut(arcs.groupBy("u").agg(F.min("v").alias("m")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60, few: int = 0) -> DataFrame:
    """Rows (node, component) for every node of the undirected edges (u, v) of any
    orderable type; component is the smallest node reachable, the node itself for
    nodes that only link to themselves. Nulls, repeated edges and loops are
    allowed: an edge with a null end is no edge. No edges give no rows.

    Each round: large-star links a node's larger neighbours to its smallest
    neighbour, small-star its smaller ones. Both are an aggregation and an equi
    join, no neighbourhood is gathered. The rounds end when nothing changes, all
    nodes then hang on their smallest (in O(log^2 n) rounds, mostly 2 to 5). Of `few`
    edges or less, rounds run in one task."""
    edges = edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL")
    loops = edges.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _state(now)
    held = (lambda df: df.coalesce(1)) if seen[0] <= few else lambda df: df
    now = held(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = held(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = both.join(held(_minima(both)), "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        now = held(cut(large.distinct()))
        small = now.join(held(_minima(now)), "u")
        hung = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = held(cut(held(hung.unionByName(small.select("u", F.col("m").alias("v")))).distinct()))
        was, seen = seen, _state(now)
        if was == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.join(now.select(F.explode(F.array("u", "v")).alias("node")), "node", "left_anti")
    return stars.unionByName(roots).unionByName(alone).distinct()
