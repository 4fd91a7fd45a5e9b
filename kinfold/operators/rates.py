"""Rates at several averaging levels, selectors, and numeric summaries over runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.text import is_explicit_binomial

# fixed values: population names
SELECTORS = (
    "calibration", "known", "all_ood", "same_parent_ood", "different_parent_ood", "singleton_ood",
    "known_explicit_binomial", "known_sp_only",
    "same_parent_ood_explicit_binomial", "same_parent_ood_sp_only",
    "different_parent_ood_explicit_binomial", "different_parent_ood_sp_only",
)


def selector_names(explicit: Column | None = None) -> Column:
    """Array of the populations a decision row belongs to."""
    named = is_explicit_binomial(F.col("label")) if explicit is None else explicit
    known, ood = F.col("role") == "test_known", F.col("role") == "test_ood"
    near, far = ood & (F.col("ood_distance") == "near"), ood & (F.col("ood_distance") == "far")
    rules = {
        "calibration": F.col("role") == "calibration", "known": known, "all_ood": ood,
        "same_parent_ood": near, "different_parent_ood": far, "singleton_ood": ood & F.col("ood_singleton"),
        "known_explicit_binomial": known & named, "known_sp_only": known & ~named,
        "same_parent_ood_explicit_binomial": near & named, "same_parent_ood_sp_only": near & ~named,
        "different_parent_ood_explicit_binomial": far & named, "different_parent_ood_sp_only": far & ~named,
    }
    names = F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])
    return F.filter(names, lambda n: n.isNotNull())


def by_selector(df: DataFrame, explicit: Column | None = None) -> DataFrame:
    """One copy of a row per population it belongs to (at most five)."""
    return df.withColumn("selector", F.explode(selector_names(explicit)))


def _double(column: str) -> Column:
    return F.col(column).cast("double")


def cluster_rates(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean over the clusters of each cluster's mean, for all value columns at once."""
    per = df.groupBy(*keys, "cluster_id").agg(*[F.avg(_double(v)).alias(v) for v in values])
    return per.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def label_macro_rates(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean over labels of the mean over clusters of the cluster means."""
    per = df.groupBy(*keys, "label", "cluster_id").agg(*[F.avg(_double(v)).alias(v) for v in values])
    labels = per.groupBy(*keys, "label").agg(*[F.avg(v).alias(v) for v in values])
    return labels.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


TRAITS = ("role", "ood_distance", "ood_singleton", "label", "cluster_id")


def cluster_totals(df: DataFrame, keys: Sequence[str], values: Sequence[str], traits: Sequence[str] = ("label", "cluster_id")) -> DataFrame:
    """Per cluster: mean, sum and count of every value column."""
    return df.groupBy(*keys, *traits).agg(
        *[F.avg(_double(v)).alias(f"m_{v}") for v in values],
        *[F.sum(_double(v)).alias(f"s_{v}") for v in values],
        *[F.count(F.col(v)).alias(f"n_{v}") for v in values],
    )


def rates_from_totals(per: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    labels = per.groupBy(*keys, "label").agg(
        *[F.avg(f"m_{v}").alias(f"l_{v}") for v in values],
        *[F.sum(f"m_{v}").alias(f"cs_{v}") for v in values],
        *[F.count(f"m_{v}").alias(f"cn_{v}") for v in values],
        *[F.sum(f"s_{v}").alias(f"s_{v}") for v in values],
        *[F.sum(f"n_{v}").alias(f"n_{v}") for v in values],
    )
    return labels.groupBy(*keys).agg(
        *[
            metric
            for v in values
            for metric in (
                F.try_divide(F.sum(f"s_{v}"), F.sum(f"n_{v}")).alias(f"{v}__row"),
                F.try_divide(F.sum(f"cs_{v}"), F.sum(f"cn_{v}")).alias(f"{v}__cluster"),
                F.avg(f"l_{v}").alias(f"{v}__label_macro"),
            )
        ]
    )


def rates_at_levels(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``v__row``, ``v__cluster`` and ``v__label_macro`` in one pass over the rows.

    The row level is carried as sums and counts through the cluster level, so the table
    is scanned and shuffled once, not once per level.
    """
    return rates_from_totals(cluster_totals(df, keys, values), keys, values)


def rates_by_selector(df: DataFrame, keys: Sequence[str], values: Sequence[str], explicit: Column | None = None) -> DataFrame:
    """The three rates per run and population.

    Populations depend on cluster traits only, so rows are reduced to clusters before
    a cluster is copied into the populations it belongs to.
    """
    per = by_selector(cluster_totals(df, keys, values, TRAITS), explicit)
    return rates_from_totals(per, [*keys, "selector"], values)


def instance_mean(df: DataFrame, keys: Sequence[str], instance: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Label-macro rate within each model instance, then the mean over instances."""
    per = label_macro_rates(df, [*keys, *instance], values)
    return per.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("n_instances"))


def average_over_folds(ood: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """An unknown row is scored once per fold; average those before any cluster mean."""
    return ood.groupBy(*keys, "row_id", "cluster_id", "label", "parent", "ood_distance").agg(
        *[F.avg(_double(v)).alias(v) for v in values]
    )


def cluster_scores(df: DataFrame, keys: Sequence[str], score: str = "confidence") -> DataFrame:
    """Mean score per cluster and side (known or unknown): the input of the ranking metrics.

    Scores are added as decimals and the mean is rounded to 12 digits, so that it doesn't depend on the
    order of the rows and equal means tie.
    """
    mean = F.sum(_double(score).cast("decimal(38,15)")).cast("double") / F.count(score)
    return (
        df.filter(F.col("role").isin("test_known", "test_ood"))
        .groupBy(*keys, "cluster_id", (F.col("role") == "test_ood").alias("is_ood"))
        .agg(F.round(mean, 12).alias(score))
    )


def conditional_accuracy(df: DataFrame, keys: Sequence[str], accepted: str, correct: str) -> DataFrame:
    """Correct among accepted: pooled over rows, and with equal cluster weight."""
    a = F.col(accepted).cast("double")
    c = (F.col(accepted) & F.col(correct)).cast("double")
    per = df.groupBy(*keys, "cluster_id").agg(
        F.sum(a).alias("a"), F.sum(c).alias("c"), F.avg(a).alias("am"), F.avg(c).alias("cm")
    )
    return per.groupBy(*keys).agg(
        F.try_divide(F.sum("c"), F.sum("a")).alias("accuracy__row"),
        F.try_divide(F.sum("cm"), F.sum("am")).alias("accuracy__cluster"),
    )


def to_long(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    wide = df.select(*keys, *[_double(v).alias(v) for v in values])
    return wide.unpivot(list(keys), list(values), "metric", "value")


def numeric_summary(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """n, mean, sample SD, min and max of each metric over runs; NULLs are left out."""
    return (
        to_long(df, keys, values).filter(F.col("value").isNotNull())
        .groupBy(*keys, "metric")
        .agg(
            F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
            F.min("value").alias("minimum"), F.max("value").alias("maximum"),
        )
    )


def mean_sd(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and sample SD per metric as columns; NULL keys form their own group."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_runs"),
        *[m for v in values for m in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd"))],
    )
