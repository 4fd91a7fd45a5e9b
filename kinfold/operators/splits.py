"""Leak-free, leaky and source hold-out splits; roles come from hashed ranks.

Fold membership is round robin over the hash order of clusters (or rows) within a
label, so a label is spread over the folds within one unit. It is a function of
(seed, id) alone: no row order, no random generator, nothing to collect.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.hashing import hash_key
from kinfold.operators.ranking import hash_rank, largest_group
from kinfold.schema import assert_empty, require_columns

COLUMNS = ["row_id", "cluster_id", "label", "parent", "seed", "design", "fold", "role"]


def _seeds(df: DataFrame, seeds: Iterable[int]) -> DataFrame:
    return df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))


def _folds(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def cluster_folds(rows: DataFrame, seeds: Iterable[int], k: int, largest: int | None = None) -> DataFrame:
    """``(seed, label, cluster_id, test_fold)``: whole clusters, balanced within each label.

    ``largest`` bounds the clusters of a label; it is measured when not given.
    """
    clusters = rows.select("label", "cluster_id").distinct()
    if largest is None:
        largest = largest_group(clusters, ["label"])
    ranked = hash_rank(
        _seeds(clusters, seeds), ["seed", "label"], hash_key(F.col("seed"), F.col("cluster_id")), ["cluster_id"], "__r",
        largest=largest,
    )
    return ranked.select("seed", "label", "cluster_id", ((F.col("__r") - 1) % k).cast("int").alias("test_fold"))


def calibration_clusters(training: DataFrame, fraction: float = 0.2, largest: int | None = None) -> DataFrame:
    """Add ``role`` to ``(seed, fold, label, cluster_id)``: ceil(fraction x n) calibrate, never all of them."""
    token = hash_key(F.lit("calibration"), F.col("seed"), F.col("fold"), F.col("cluster_id"))
    ranked = hash_rank(training, ["seed", "fold", "label"], token, ["cluster_id"], "__r", "__n", largest=largest)
    wanted = F.greatest(F.lit(1), F.ceil(F.col("__n") * F.lit(fraction)))
    n_cal = F.when(wanted >= F.col("__n"), F.greatest(F.lit(1), F.col("__n") - 1)).otherwise(wanted)
    return ranked.withColumn("role", F.when(F.col("__r") <= n_cal, "calibration").otherwise("train")).drop("__r", "__n")


def grouped_splits(known: DataFrame, ood: DataFrame | None, seeds: Iterable[int], k: int,
                   design: str = "cluster_grouped", largest: int | None = None) -> DataFrame:
    """Whole clusters to test, calibration or train; out-of-distribution rows join every fold."""
    seeds = list(seeds)
    if largest is None:
        largest = label_shape(known).largest_clusters
    folds = _folds(cluster_folds(known, seeds, k, largest), k)
    test = folds.filter(F.col("fold") == F.col("test_fold")).withColumn("role", F.lit("test_known"))
    rest = calibration_clusters(folds.filter(F.col("fold") != F.col("test_fold")), largest=largest)
    roles = test.unionByName(rest).select("seed", "fold", "label", "cluster_id", "role")
    out = known.select("row_id", "cluster_id", "label", "parent").join(roles, ["label", "cluster_id"])
    out = out.withColumn("design", F.lit(design)).select(*COLUMNS)
    if ood is None:
        return out
    unknown = _folds(_seeds(ood.select("row_id", "cluster_id", "label", "parent"), seeds), k)
    return out.unionByName(
        unknown.withColumn("design", F.lit(design)).withColumn("role", F.lit("test_ood")).select(*COLUMNS)
    )


def row_random_splits(known: DataFrame, seeds: Iterable[int], k: int, fraction: float = 0.2,
                      largest: int | None = None) -> DataFrame:
    """Rows dealt to folds within a label regardless of cluster: leaky by design, used for contrast."""
    base = known.select("row_id", "cluster_id", "label", "parent")
    if largest is None:
        largest = label_shape(known).largest_rows
    ranked = hash_rank(
        _seeds(base, seeds), ["seed", "label"], hash_key(F.col("seed"), F.col("row_id")), ["row_id"], "__r", largest=largest
    )
    cells = _folds(ranked.withColumn("test_fold", ((F.col("__r") - 1) % k).cast("int")).drop("__r"), k)
    # ranking test rows next to the rest keeps one pass; their rank is simply not used
    token = hash_key(F.lit("calibration"), F.col("seed"), F.col("fold"), F.col("row_id"))
    sided = cells.withColumn("__test", F.col("fold") == F.col("test_fold"))
    sided = hash_rank(sided, ["seed", "fold", "label", "__test"], token, ["row_id"], "__r", "__n", largest=largest)
    role = F.when(F.col("__test"), "test_known").when(
        F.col("__r") <= F.ceil(F.col("__n") * F.lit(fraction)), "calibration").otherwise("train")
    return sided.withColumn("role", role).withColumn("design", F.lit("row_random")).select(*COLUMNS)


def sensitivity_splits(known: DataFrame, seeds: Iterable[int], k: int, largest: int | None = None) -> DataFrame:
    """Closed-set stress test: train and test only, k limited by the smallest label."""
    folds = _folds(cluster_folds(known, seeds, k, largest), k).withColumn(
        "role", F.when(F.col("fold") == F.col("test_fold"), "test_known").otherwise("train")
    )
    return (
        known.select("row_id", "cluster_id", "label", "parent")
        .join(folds.drop("test_fold"), ["label", "cluster_id"])
        .withColumn("design", F.lit("cluster_grouped_sensitivity")).select(*COLUMNS)
    )


class LabelShape(NamedTuple):
    labels: int
    smallest_clusters: int
    largest_clusters: int
    largest_rows: int


def label_shape(rows: DataFrame) -> LabelShape:
    """Number of labels, their smallest and largest cluster count, largest row count: four numbers."""
    per = rows.groupBy("label", "cluster_id").agg(F.count("*").alias("r")).groupBy("label").agg(
        F.count("*").alias("c"), F.sum("r").alias("r"))
    row = per.agg(F.count("*"), F.min("c"), F.max("c"), F.max("r")).first()
    return LabelShape(*[int(x or 0) for x in row])


def build_splits(manifest: DataFrame, seeds: Iterable[int], k: int = 5, check: bool = True) -> DataFrame:
    require_columns(manifest, ["row_id", "cluster_id", "label", "parent", "analysis_set"], "manifest")
    seeds = list(seeds)
    known = manifest.filter(F.col("analysis_set") == "primary_known")
    ood = manifest.filter(F.col("analysis_set") == "ood")
    shape = label_shape(known)
    if shape.labels < 2:
        raise ValueError("at least two known labels are required")
    if shape.smallest_clusters < k:
        raise ValueError(f"a known label has only {shape.smallest_clusters} clusters for {k} folds")
    parts = [
        grouped_splits(known, ood, seeds, k, largest=shape.largest_clusters),
        row_random_splits(known, seeds, k, largest=shape.largest_rows),
    ]
    if "sensitivity_known" in manifest.columns:
        stress = manifest.filter("sensitivity_known")
        wide = label_shape(stress)
        parts.append(sensitivity_splits(stress, seeds, min(k, wide.smallest_clusters), wide.largest_clusters))
    splits = parts[0]
    for part in parts[1:]:
        splits = splits.unionByName(part)
    if check:
        assert_empty(split_violations(splits), "invalid splits")
    return splits


def split_violations(splits: DataFrame) -> DataFrame:
    """Repeated rows in a cell, clusters in two known roles, and unknown labels used for fitting."""
    cell = ["design", "seed", "fold"]
    out = lambda df, key, rule: df.select(
        *cell, F.col(key).cast("string").alias("item"), F.lit(rule).alias("rule")
    )
    repeated = splits.groupBy(*cell, "row_id").count().filter("count > 1")
    known = splits.filter((F.col("role") != "test_ood") & (F.col("design") != "row_random"))
    shared = known.groupBy(*cell, "cluster_id").agg(F.countDistinct("role").alias("n")).filter("n > 1")
    fitting = F.max(F.col("role").isin("train", "calibration").cast("int"))
    unknown = F.max((F.col("role") == "test_ood").cast("int"))
    leaked = splits.groupBy(*cell, "label").agg(fitting.alias("f"), unknown.alias("u")).filter("f = 1 AND u = 1")
    return (
        out(repeated, "row_id", "repeated row")
        .unionByName(out(shared, "cluster_id", "cluster in two roles"))
        .unionByName(out(leaked, "label", "unknown label used for fitting"))
    )


def role_overlap(splits: DataFrame) -> DataFrame:
    """Clusters present in a pair of roles of the same cell, counted per pair.

    Each cluster carries its few roles as an array; pairs come from that array, not
    from a self-join.
    """
    roles = splits.groupBy("design", "seed", "fold", "cluster_id").agg(
        F.array_sort(F.collect_set("role")).alias("r")
    ).filter(F.size("r") > 1)
    pairs = F.flatten(
        F.transform("r", lambda a, i: F.transform(
            F.slice(F.col("r"), i + 2, F.size("r")), lambda b: F.struct(a.alias("role_a"), b.alias("role_b"))
        ))
    )
    return (
        roles.select("design", "seed", "fold", F.explode(pairs).alias("p"))
        .groupBy("design", "seed", "fold", F.col("p.role_a").alias("role_a"), F.col("p.role_b").alias("role_b"))
        .agg(F.count("*").alias("overlap"))
    )


def missing_rows(ids: DataFrame, manifest: DataFrame, key: str = "row_id") -> DataFrame:
    """Split ids the manifest does not know."""
    return ids.select(key).distinct().join(manifest.select(key), key, "left_anti")


def source_cohorts(manifest: DataFrame, holdouts: Iterable[str], min_nonheld: int = 5,
                   min_held: int = 2) -> tuple[DataFrame, DataFrame]:
    """Whole-cluster source hold-outs: a cluster is held when any of its rows has the source.

    Returns (clusters of the labels that qualify, per-label counts), one block per hold-out.
    """
    require_columns(manifest, ["row_id", "cluster_id", "label", "source"], "manifest")
    names = F.array(*[F.lit(str(h)) for h in holdouts])
    per_source = manifest.groupBy("cluster_id", "source").agg(
        F.min("label").alias("label"), F.count("*").alias("n")
    )
    clusters = (
        per_source.withColumn("holdout", F.explode(names))
        .groupBy("holdout", "cluster_id")
        .agg(
            F.min("label").alias("label"), F.sum("n").alias("total_rows"),
            F.sum(F.when(F.col("source") == F.col("holdout"), F.col("n")).otherwise(0)).alias("held_rows"),
            F.count("source").alias("source_count"),
        )
        .withColumn("is_held", F.col("held_rows") > 0)
        .withColumn("other_rows", F.col("total_rows") - F.col("held_rows"))
        .withColumn("mixed_source", F.col("source_count") > 1)
    )
    counts = (
        clusters.groupBy("holdout", "label")
        .agg(F.sum(F.col("is_held").cast("long")).alias("held_clusters"), F.count("*").alias("total_clusters"))
        .withColumn("nonheld_clusters", F.col("total_clusters") - F.col("held_clusters"))
        .withColumn("included", (F.col("held_clusters") >= min_held) & (F.col("nonheld_clusters") >= min_nonheld))
    )
    cohort = clusters.join(
        counts.filter("included").select("holdout", "label"), ["holdout", "label"], "left_semi"
    ).withColumn("source_role", F.when(F.col("is_held"), "test_source").otherwise("nonheld_pool"))
    return cohort, counts


def source_splits(manifest: DataFrame, cohort: DataFrame, seeds: Iterable[int], fraction: float = 0.2) -> DataFrame:
    """Held clusters test; of the rest floor(fraction x n) calibrate (at least one, never all)."""
    held = _seeds(cohort.filter("is_held").select("holdout", "label", "cluster_id"), seeds).withColumn(
        "role", F.lit("test_source")
    )
    pool = _seeds(cohort.filter("NOT is_held").select("holdout", "label", "cluster_id"), seeds)
    token = hash_key(F.col("seed"), F.col("holdout"), F.col("label"), F.col("cluster_id"))
    ranked = hash_rank(pool, ["seed", "holdout", "label"], token, ["cluster_id"], "__r", "__n")
    n_cal = F.least(F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(fraction))), F.col("__n") - 1)
    rest = ranked.withColumn("role", F.when(F.col("__r") <= n_cal, "calibration").otherwise("train")).drop("__r", "__n")
    roles = held.unionByName(rest).drop("label")
    return manifest.select("row_id", "cluster_id", "label", "parent", "source").join(roles, "cluster_id").select(
        "holdout", "seed", "row_id", "cluster_id", "label", "parent", "source", "role"
    )


def source_split_violations(splits: DataFrame) -> DataFrame:
    """Breaches of the six hold-out rules, one row each."""
    cell = ["holdout", "seed"]
    out = lambda df, item, rule: df.select(*cell, item.cast("string").alias("item"), F.lit(rule).alias("rule"))
    repeated = splits.groupBy(*cell, "row_id").count().filter("count > 1")
    clusters = splits.groupBy(*cell, "cluster_id").agg(
        F.countDistinct("role").alias("roles"),
        F.max((F.col("role") == "test_source").cast("int")).alias("test"),
        F.max((F.col("role") != "test_source").cast("int")).alias("other"),
        F.max((F.col("source") == F.col("holdout")).cast("int")).alias("target"),
    )
    roles = splits.groupBy(*cell).agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
    fitted = splits.filter((F.col("role") != "test_source") & (F.col("source") == F.col("holdout")))
    parts = [
        out(repeated, F.col("row_id"), "repeated row"),
        out(clusters.filter("roles > 1"), F.col("cluster_id"), "cluster in two roles"),
        out(roles.filter("roles != 'calibration,test_source,train'"), F.col("roles"), "incomplete roles"),
        out(clusters.filter("test = 1 AND target = 0"), F.col("cluster_id"), "test cluster without the source"),
        out(fitted, F.col("row_id"), "held source used for fitting"),
        out(clusters.filter("test = 1 AND other = 1"), F.col("cluster_id"), "cluster in test and fitting"),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
