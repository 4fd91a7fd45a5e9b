"""Report tables (data only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.metrics import confusion
from kinfold.operators.ranking import quantiles
from kinfold.operators.rates import mean_sd


def composition(manifest: DataFrame) -> DataFrame:
    """Rows, clusters and labels of each analysis population."""
    far, near = F.col("ood_distance") == "far", F.col("ood_distance") == "near"
    populations = F.array(
        F.lit("all"), F.when(F.col("primary_known"), F.lit("known")), F.when(F.col("primary_ood"), F.lit("ood")),
        F.when(F.col("primary_ood") & near, F.lit("near_ood")), F.when(F.col("primary_ood") & far, F.lit("far_ood")),
        F.when(F.col("ood_singleton"), F.lit("singleton_ood")),
    )
    exploded = manifest.withColumn("population", F.explode(F.filter(populations, lambda p: p.isNotNull())))
    return exploded.groupBy("population").agg(
        F.count("*").alias("n_rows"), F.countDistinct("cluster_id").alias("n_clusters"), F.countDistinct("label").alias("n_labels")
    )


def model_summary(seed_metrics: DataFrame, values: Sequence[str]) -> DataFrame:
    return mean_sd(seed_metrics, ["design", "model"], values)


def split_performance(summary: DataFrame, value: str = "macro_f1_mean") -> DataFrame:
    """Model x design table with the difference."""
    wide = summary.groupBy("model").pivot("design", ["row_random", "cluster_grouped"]).agg(F.first(value))
    delta = F.col("row_random") - F.col("cluster_grouped")
    return wide.select("model", *[F.round(c, 4).alias(n) for n, c in (
        ("row_random", F.col("row_random")), ("cluster_grouped", F.col("cluster_grouped")), ("difference", delta))])


def open_set_performance(summary: DataFrame, values: Sequence[str]) -> DataFrame:
    return summary.filter(F.col("design") == "cluster_grouped").select("model", *[F.round(v, 4).alias(v) for v in values])


def evaluation_group(df: DataFrame) -> DataFrame:
    return df.filter(F.col("role").isin("test_known", "test_ood")).withColumn(
        "evaluation_group", F.when(F.col("role") == "test_known", "known").otherwise(F.concat(F.col("ood_distance"), F.lit(" ood")))
    )


def selective_acceptance(df: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    return evaluation_group(df).groupBy(*keys, "evaluation_group").agg(
        F.avg(F.col("accepted").cast("double")).alias("acceptance_rate"))


def frequent_confusions(df: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most frequent wrong pairs; equal counts are ordered by name."""
    wrong = confusion(df.filter(F.col("predicted") != F.col("label")), [])
    return wrong.orderBy(F.desc("n"), "true_label", "predicted_label").limit(n)


# fixed values: letter-value levels
LETTER_LEVELS = {"q03": 0.03125, "q06": 0.0625, "q12": 0.125, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q87": 0.875,
                 "q94": 0.9375, "q97": 0.96875}


def confidence_distribution(df: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Letter values of confidence per group; exact for groups of any size."""
    return quantiles(evaluation_group(df), [*keys, "evaluation_group"], "confidence", LETTER_LEVELS)


def study_flow(manifest: DataFrame) -> DataFrame:
    """Counts along the study flow: all rows, known and unknown labels and clusters."""
    inside = lambda rule, c: F.countDistinct(F.when(rule, F.col(c)))
    known, ood = F.col("analysis_set") == "primary_known", F.col("analysis_set") == "ood"
    return manifest.agg(
        F.count("*").alias("n_rows"), inside(known, "label").alias("known_labels"), inside(known, "cluster_id").alias("known_clusters"),
        inside(ood, "label").alias("ood_labels"), inside(ood, "cluster_id").alias("ood_clusters"),
    )


def endpoint_table(endpoints: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Add ``supported``: adjusted p below alpha and an estimate beyond the null."""
    beyond = F.col("estimate") > F.coalesce("null_value", F.lit(0.0))
    return endpoints.withColumn("supported", (F.col("holm_adjusted_p") < alpha) & beyond)
