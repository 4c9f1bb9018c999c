"""Connected components by alternating large-star and small-star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrest.llm._scratch import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node in the edges (a, b); component is its smallest reachable node.

    Every step writes its table, so a lost executor costs one step. Minima are
    pre-aggregated, and the joins read plain shuffles, which adaptive execution splits
    where a node has very many neighbours. An empty edge table gives no rows.
    """
    now = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(now)
    while before[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = scratch.cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "large")
        large = scratch.cut(both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        low2 = scratch.cut(large.groupBy("a").agg(F.min("b").alias("m")), "small")
        small = large.join(low2, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low2.select("a", F.col("m").alias("b"))).distinct()
        after_edges = scratch.cut(small, "small-star")
        after = _state(after_edges)
        scratch.drop(now, low, large, low2)
        now = after_edges
        if after == before:
            break
        before = after
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def extended(found: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) after links (a, b) were added to those that gave found; only components that a new link touches are gone through again."""
    ends = more.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = scratch.cut(ends.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.col("component").isNull().alias("new")), "ends")
    side = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    edges = more.join(side("a"), "a").join(side("b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    renamed = connected_components(edges, scratch).select(F.col("node").alias("component"), F.col("component").alias("now"))
    every = found.unionByName(known.where("new").drop("new"))
    return scratch.cut(every.join(renamed, "component", "left").select("node", F.coalesce("now", "component").alias("component")), "components")
