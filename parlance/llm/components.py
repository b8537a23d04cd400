"""Distributed union-find on DataFrames: alternating large-star and small-star steps.

Each step joins every node with the least of its neighbours (an aggregate that combines before the
shuffle, so a hub costs no more than its edges) and rewrites edges towards that least node, until
every edge is (node, least node of its component). Edges are written to the shared folder after each
round. Whether they are like that already is one aggregate, so edges that are so from the start, as most
links of pairs are, take no round, and none is made to see that nothing changes; nothing but one row per
round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import cut


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """pairs (u, v), u != v. Large star takes both directions and moves neighbours above u; small
    star takes v < u and moves those and u itself."""
    if larger_only:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        moved = both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        moved = down.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def _are_stars(pairs: DataFrame) -> bool:
    """Whether each node of pairs (u, v; distinct, u > v) has one v alone or is a v alone: each component's edges lead to its least node."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(2).alias("way")), F.struct(F.col("v").alias("node"), F.lit(1).alias("way")))).alias("x"))
    # 1: nothing but a v; 2: a u, once; 3: both.
    nodes = ends.select("x.node", "x.way").groupBy("node").agg(F.bit_or("way").alias("ways"), F.sum(F.when(F.col("way") == 2, 1).otherwise(0)).alias("n"))
    return not nodes.agg(F.bool_or(F.expr("ways = 3 OR n > 1"))).first()[0]


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): each node that has an edge, with the least node it reaches.

    Loops, repeated and reversed edges are fine, edges with a null end are ignored. No edges give an
    empty table.
    """
    pairs = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where(F.col(left) != F.col(right)).distinct()
    pairs = cut(pairs, "edges")
    while not _are_stars(pairs):
        pairs = cut(_star(_star(pairs, True), False), "edges")
    tops = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops.select("node", F.col("node").alias("component")))


def merged_components(found: DataFrame, links: DataFrame, left: str, right: str) -> DataFrame:
    """found (node, component) after links between components. A node that found hasn't is a component of its own. Only the graph of
    components is resolved, which is smaller than that of the nodes."""
    over = cut(connected_components(links, left, right), "over")
    named = over.select(F.col("node").alias("was"), F.col("component").alias("now"))
    moved = found.join(named, F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component"))
    return cut(moved.union(over.join(found.select("node"), "node", "left_anti")), "components")
