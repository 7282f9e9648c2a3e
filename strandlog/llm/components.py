"""Connected components of a graph given as an edge table, by alternating large-star and small-star rounds.

Every round is a few joins and minima over edges that Spark partitions by node; nothing is gathered on the driver but a
yes or no for each round. A node with very many neighbours is pre-aggregated before the shuffle (its least
neighbour) and its join is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandlog.llm.common import Scratch


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: then each component is a star around its least node."""
    more = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
    inner = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
    return more.isEmpty() and inner.isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is the least node reachable."""
    e = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _are_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = scratch.cut(large, "large-star")
        least = _least(large)
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        new = scratch.cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        scratch.drop(e)
        scratch.drop(large)
        e = new
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
