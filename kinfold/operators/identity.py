"""Identity graph: connected components of clusters and the identities they carry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.formats import reason_list
from kinfold.functions.text import clean_identity
from kinfold.operators.ranking import _null_safe_join
from kinfold.session import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Minima combine map-side, so a hub node is one partial aggregate per task."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        linked = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return linked.filter("u != v").distinct()


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` with the smallest node as the component, by alternating star steps.

    Rounds grow with the logarithm of the longest path. Each round is written to the
    checkpoint folder, so a lost executor costs that round only; two numbers per
    round reach the driver.
    """
    state = durable(edges.select(F.col("u"), F.col("v")).filter("u != v").distinct())
    previous = None
    for _ in range(max_rounds):
        state = durable(_star(_star(state, True), False))
        seen = state.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if (seen["n"], seen["h"]) == previous:
            break
        previous = (seen["n"], seen["h"])
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = state.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.select("node").distinct().join(roots, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )


def identity_edges(manifest: DataFrame) -> DataFrame:
    """Distinct ``(cluster_id, identity)`` pairs with a usable identity."""
    return manifest.select("cluster_id", clean_identity(F.col("identity")).alias("identity")).filter(
        F.col("identity").isNotNull()).distinct()


def cluster_components(manifest: DataFrame) -> DataFrame:
    """``(cluster_id, component)``; a cluster without identity is its own component."""
    edges = identity_edges(manifest)
    tag = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    nodes = manifest.select(tag("c:", "cluster_id").alias("node"), "cluster_id").distinct()
    graph = edges.select(tag("c:", "cluster_id").alias("u"), tag("i:", "identity").alias("v"))
    found = connected_components(nodes, graph)
    return nodes.join(found, "node").select("cluster_id", "component")


def component_tables(manifest: DataFrame, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(component summary, excluded clusters with reasons).

    A component is excluded when it spans clusters or holds a cluster with a conflict.
    Counts are plain aggregates; the sorted member lists are the one output that is as
    wide as its component, because the summary is defined to list its members.
    """
    members = cluster_components(manifest) if members is None else members
    facts = manifest.groupBy("cluster_id").agg(
        F.countDistinct("row_id").alias("n_rows"),
        F.max(F.coalesce(F.col("identity_conflict"), F.lit(False))).alias("conflict"),
    )
    edges = identity_edges(manifest)
    clusters = members.join(facts, "cluster_id")
    text = F.col("cluster_id").cast("string")
    base = clusters.groupBy("component").agg(
        F.count("*").alias("n_clusters"), F.sum("n_rows").alias("n_rows"),
        F.sum(F.col("conflict").cast("int")).alias("n_conflict_clusters"),
        F.array_sort(F.collect_set(text)).alias("cluster_ids"),
        F.array_sort(F.collect_set(F.when(F.col("conflict"), text))).alias("conflict_cluster_ids"),
    )
    names = members.join(edges, "cluster_id").groupBy("component").agg(
        F.countDistinct("identity").alias("n_identities"), F.array_sort(F.collect_set("identity")).alias("identities")
    )
    kinds = manifest.select("cluster_id", "label", "parent").distinct().join(members, "cluster_id").groupBy("component").agg(
        F.array_sort(F.collect_set("label")).alias("labels"), F.array_sort(F.collect_set("parent")).alias("parents")
    )
    summary = base.join(names, "component", "left").join(kinds, "component", "left").select(
        "*", (F.col("n_conflict_clusters") > 0).alias("has_conflict"), (F.col("n_clusters") > 1).alias("spans_clusters"),
    ).withColumn("n_identities", F.coalesce("n_identities", F.lit(0))).withColumn(
        "identities", F.coalesce("identities", F.array().cast("array<string>"))
    ).withColumn("excluded", F.col("has_conflict") | F.col("spans_clusters"))
    digest = F.sha2(F.to_json(F.struct("cluster_ids", "identities")), 256)
    summary = summary.withColumn("component_id", F.concat(F.lit("component_"), F.substring(digest, 1, 16)))
    excluded = clusters.join(
        summary.filter("excluded").select("component", "component_id", "has_conflict", "spans_clusters", "n_clusters", "n_identities"),
        "component",
    ).select(
        "cluster_id", "component_id", "n_rows", "conflict", "has_conflict", "spans_clusters", "n_clusters", "n_identities",
        reason_list(
            (F.col("conflict"), "within_cluster_conflict"),
            (F.col("has_conflict"), "component_contains_conflict"),
            (F.col("spans_clusters"), "component_spans_clusters"),
        ).alias("reason"),
    )
    return summary.drop("component"), excluded


# fixed values: audited role pairs
ROLE_PAIRS = (
    ("train", "test_known"), ("train", "calibration"), ("calibration", "test_known"),
    ("train", "test_ood"), ("calibration", "test_ood"), ("test_known", "test_ood"),
)


def isolation_audit(manifest: DataFrame, splits: DataFrame, excluded: DataFrame | None = None,
                    design: str = "cluster_grouped") -> DataFrame:
    """Identities shared by two roles of a cell after exclusion, one row per (seed, fold).

    The join runs on distinct (cluster, role) pairs, not on rows, and each identity
    keeps its few roles in a set; pairs are tested on that set.
    """
    cell = ["seed", "fold"]
    edges, used = identity_edges(manifest), splits.filter(F.col("design") == design)
    if excluded is not None:
        drop = excluded.select("cluster_id").distinct()
        edges, used = edges.join(drop, "cluster_id", "left_anti"), used.join(drop, "cluster_id", "left_anti")
    repeated = edges.groupBy("identity").agg(F.countDistinct("cluster_id").alias("n")).filter("n > 1").agg(
        F.count("*").alias("repeated_identities"))
    links = used.groupBy(*cell, "cluster_id", "role").agg(F.count("*").alias("__rows")).join(edges, "cluster_id")
    flags = lambda group: links.groupBy(*cell, group).agg(F.collect_set("role").alias("r"))
    shared = lambda a, b: F.sum((F.array_contains("r", a) & F.array_contains("r", b)).cast("int"))
    any_pair = F.lit(False)
    for a, b in ROLE_PAIRS:
        any_pair = any_pair | (F.array_contains("r", a) & F.array_contains("r", b))
    by_identity = flags("identity").groupBy(*cell).agg(
        F.count("*").alias("n_identities"), *[shared(a, b).alias(f"{a}__{b}__identity_overlap") for a, b in ROLE_PAIRS],
        F.sum(any_pair.cast("int")).alias("any_overlap"),
    )
    by_cluster = flags("cluster_id").groupBy(*cell).agg(
        F.count("*").alias("n_clusters"), *[shared(a, b).alias(f"{a}__{b}__cluster_overlap") for a, b in ROLE_PAIRS]
    )
    joined = _null_safe_join(by_identity, by_cluster, cell).join(F.broadcast(repeated), F.lit(True))
    return joined.withColumn("passed", (F.col("repeated_identities") == 0) & (F.col("any_overlap") == 0))


def exclusion_summary(components: DataFrame) -> DataFrame:
    """Counts of components, clusters and rows, kept and excluded."""
    when = lambda rule, value: F.sum(F.when(rule, value).otherwise(0))
    out = F.col("excluded")
    return components.agg(
        F.count("*").alias("components"), when(out, 1).alias("excluded_components"),
        when(F.col("spans_clusters"), 1).alias("spanning_components"), when(F.col("has_conflict"), 1).alias("conflict_components"),
        F.sum("n_clusters").alias("clusters"), when(out, F.col("n_clusters")).alias("excluded_clusters"),
        F.sum("n_rows").alias("rows"), when(out, F.col("n_rows")).alias("excluded_rows"),
        F.max("n_clusters").alias("largest_component"),
    )
