"""What remains of the leakage and open-set results once identity-linked clusters are excluded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.text import label_type
from kinfold.operators import identity as idn
from kinfold.operators import metrics as me
from kinfold.operators import rates as rt
from kinfold.operators.audits import set_difference
from kinfold.operators.manifest import exclude_clusters
from kinfold.operators.ranking import _null_safe_join
from kinfold.schema import assert_empty


def cohort_check(known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per run: rows of each design, rows found in one design only, rows with unequal truth."""
    on = lambda d: F.max((F.col("design") == d).cast("int"))
    per = known.groupBy(*keys, "row_id").agg(
        on("row_random").alias("r"), on("cluster_grouped").alias("g"), F.countDistinct("label").alias("labels")
    )
    return per.groupBy(*keys).agg(
        F.sum("r").alias("random_rows"), F.sum("g").alias("grouped_rows"),
        F.sum(((F.col("r") == 1) & (F.col("g") == 0)).cast("int")).alias("random_only"),
        F.sum(((F.col("r") == 0) & (F.col("g") == 1)).cast("int")).alias("grouped_only"),
        F.sum((F.col("labels") > 1).cast("int")).alias("label_conflicts"),
    ).withColumn("passed", (F.col("random_only") == 0) & (F.col("grouped_only") == 0) & (F.col("label_conflicts") == 0))


def clean_leakage(known: DataFrame, cluster_predictions: DataFrame, excluded: DataFrame, keys: Sequence[str] = ("seed",),
                  check: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(metrics, deltas, summary, cohort check) on the clusters that are not excluded, without refitting.

    Both designs must hold the same rows; ``check`` raises when they do not.
    """
    keys = list(keys)
    rows, clusters = exclude_clusters(known, excluded), exclude_clusters(cluster_predictions, excluded)
    cohorts = cohort_check(rows, keys)
    if check:
        assert_empty(cohorts.filter("NOT passed"), "the designs hold different rows")
        assert_empty(set_difference(rows, clusters, [*keys, "design", "cluster_id"]), "row and cluster predictions differ")
    metrics = me.leakage_metrics(rows, [*keys, "design"], cluster_predictions=clusters)
    deltas = me.design_deltas(metrics, keys)
    return metrics, deltas, me.delta_summary(deltas, []), cohorts


OUTCOMES = ("confidence_only_accept", "corrected_accept", "corrected_parent_report", "corrected_unidentified", "set_contains_true")


def label_sensitivity(decisions: DataFrame, excluded: DataFrame, keys: Sequence[str] = ("model",),
                      kind=None, outcomes: Sequence[str] = OUTCOMES) -> tuple[DataFrame, DataFrame]:
    """Reporting by label type: known rows pooled per seed, unknown rows per (seed, fold).

    Returns (one row per instance, summary over instances).
    """
    rows = exclude_clusters(decisions.filter(F.col("role").isin("test_known", "test_ood")), excluded)
    typed = rows.withColumn("label_type", label_type(F.col("label")) if kind is None else kind)
    known, near, far = F.col("role") == "test_known", F.col("ood_distance") == "near", F.col("ood_distance") == "far"
    typed = typed.withColumn("instance_fold", F.when(~known, F.col("fold")))
    values = [*outcomes, "label_set_size"]
    per_cluster = typed.groupBy(*keys, "role", "ood_distance", "label_type", "seed", "instance_fold", "cluster_id").agg(
        *[F.avg(F.col(v).cast("double")).alias(f"m_{v}") for v in values],
        *[F.sum(F.col(v).cast("double")).alias(f"s_{v}") for v in values], F.count("*").alias("n"),
        F.avg((F.col("corrected_accept") & F.col("corrected_label_correct")).cast("double")).alias("m_hit"),
        F.sum((F.col("corrected_accept") & F.col("corrected_label_correct")).cast("double")).alias("s_hit"),
    )
    names = F.array(
        F.when(known, F.lit("known")), F.when(~known, F.lit("all_ood")), F.when(~known & near, F.lit("same_parent_ood")),
        F.when(~known & far, F.lit("different_parent_ood")),
    )
    group = [*keys, "selector", "label_type", "seed", "instance_fold"]
    selected = per_cluster.withColumn("selector", F.explode(F.filter(names, lambda n: n.isNotNull())))
    instances = selected.groupBy(*group).agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_clusters"),
        *[m for v in values for m in (
            (F.sum(f"s_{v}") / F.sum("n")).alias(f"{v}__row"), F.avg(f"m_{v}").alias(f"{v}__cluster"))],
        F.try_divide(F.sum("s_hit"), F.sum("s_corrected_accept")).alias("label_accuracy__row"),
        F.try_divide(F.sum("m_hit"), F.sum("m_corrected_accept")).alias("label_accuracy__cluster"),
    )
    metrics = [c for c in instances.columns if "__" in c]
    return instances, rt.numeric_summary(instances, [*keys, "selector", "label_type"], metrics)


def exclusion_study(manifest: DataFrame, splits: DataFrame, known: DataFrame, cluster_predictions: DataFrame,
                    decisions: DataFrame) -> dict[str, DataFrame]:
    """Components, exclusions, isolation audit, clean leakage and label sensitivity, by name."""
    components, excluded = idn.component_tables(manifest)
    metrics, deltas, summary, cohorts = clean_leakage(known, cluster_predictions, excluded)
    instances, sensitivity = label_sensitivity(decisions, excluded)
    return {
        "components": components, "excluded": excluded, "counts": idn.exclusion_summary(components),
        "isolation": idn.isolation_audit(manifest, splits, excluded), "leakage": metrics, "leakage_deltas": deltas,
        "leakage_summary": summary, "cohorts": cohorts, "sensitivity": instances, "sensitivity_summary": sensitivity,
    }
