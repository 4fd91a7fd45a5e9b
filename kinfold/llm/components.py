"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import stage

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``: the root is the smallest node of its component.

    A large-star step hangs every larger neighbour on a node's smallest one, a small-star step does so
    for the smaller ones; both only take minima and joins. The table is written after each round, and
    rounds end when a round changes nothing (about log squared of the longest path).
    """
    now = stage(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct(), "star")
    mark = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.filter(F.col("root") > F.col("node")).join(least, "node").select(F.col("root").alias("node"), F.col("m").alias("root")).distinct()
        small_least = large.groupBy("node").agg(F.min("root").alias("m"))
        joined = large.join(small_least, "node")
        # each neighbour below a node, and the node itself, hangs on the smallest of them
        small = joined.select(F.col("root").alias("node"), F.col("m").alias("root")).unionByName(small_least.select("node", F.col("m").alias("root")))
        now = stage(small.filter(F.col("node") != F.col("root")).distinct(), "star")
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")).alias("h")).first()
        if (found["n"], found["h"]) == mark:
            return now.unionByName(now.select(F.col("root").alias("node"), "root").distinct())
        mark = (found["n"], found["h"])
    raise ValueError(f"components don't settle within {MAX_ROUNDS} rounds")


def extended(groups: DataFrame, more: DataFrame) -> DataFrame:
    """``groups`` (as ``components`` returns them) with the links ``more(a, b)``: only these pass through rounds, between the groups."""
    names = groups.select(F.col("node").alias("x"), F.col("root").alias("y"))
    ends = more.select("a", "b").join(names, F.col("a") == F.col("x"), "left").select(F.coalesce("y", "a").alias("a"), "b")
    ends = ends.join(names, F.col("b") == F.col("x"), "left").select("a", F.coalesce("y", "b").alias("b"))
    merged = components(ends).select(F.col("node").alias("x"), F.col("root").alias("y"))
    moved = groups.join(merged, F.col("root") == F.col("x"), "left").select("node", F.coalesce("y", "root").alias("root"))
    fresh = merged.join(groups.select("node"), F.col("x") == F.col("node"), "left_anti").select(F.col("x").alias("node"), F.col("y").alias("root"))
    return stage(moved.unionByName(fresh), "groups")
