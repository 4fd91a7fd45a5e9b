"""Score calibration and conformal thresholds, for all runs at once.

Four order-statistic rules live here side by side because they differ on purpose:
finite-sample (ceil((n+1)c), 1.0 beyond the sample), lower empirical (floor((n-1)q)),
retained fraction (floor((1-t)n)) and, for intervals, linear interpolation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import arrays as ar
from kinfold.operators.ranking import _null_safe_join, group_median, order_statistic

MIN_CLASS_ROWS = 20  # fixed value


def finite_sample_quantile(df: DataFrame, keys: Sequence[str], score: str, coverage: float = 0.95,
                           out: str = "threshold") -> DataFrame:
    """Order statistic ceil((n+1) x coverage); 1.0 when it lies beyond the sample."""
    rank = F.greatest(F.ceil((F.col("n") + 1) * F.lit(coverage)), F.lit(1))
    return order_statistic(df, keys, score, rank, out).withColumn(out, F.coalesce(F.col(out), F.lit(1.0)))


def lower_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, out: str = "threshold") -> DataFrame:
    """Sorted value at index floor((n-1) x q)."""
    return order_statistic(df, keys, value, F.floor((F.col("n") - 1) * F.lit(q)) + 1, out)


def acceptance_threshold(df: DataFrame, keys: Sequence[str], score: str = "confidence", target: float = 0.95,
                         out: str = "tau") -> DataFrame:
    """One median per calibration cluster, then the lower (1 - target) quantile of the medians."""
    medians = group_median(df, [*keys, "cluster_id"], score, "__median")
    return lower_quantile(medians, keys, "__median", 1.0 - target, out)


def retained_fraction_threshold(df: DataFrame, keys: Sequence[str], score: str = "score", target: float = 0.95,
                                out: str = "threshold") -> DataFrame:
    """Largest cluster-median cutoff that keeps at least the target share of clusters."""
    medians = group_median(df, [*keys, "cluster_id"], score, "__median")
    index = F.floor(F.lit(1.0 - target) * F.col("n") + F.lit(1e-12))
    index = F.least(F.greatest(index, F.lit(0)), F.col("n") - 1)
    return order_statistic(medians, keys, "__median", index + 1, out, count="n").withColumnRenamed("n", "n_clusters")


def nonconformity(df: DataFrame, classes: list[str], probability: str = "probability", label: str = "label",
                  out: str = "score") -> DataFrame:
    return df.withColumn(out, F.lit(1.0) - ar.value_at_label(F.col(probability), ar.class_array(classes), F.col(label)))


def class_thresholds(calibration: DataFrame, keys: Sequence[str], classes: list[str], score: str = "score",
                     label: str = "label", coverage: float = 0.95, min_rows: int = MIN_CLASS_ROWS) -> DataFrame:
    """Threshold per (run, class): its own with enough rows, otherwise the pooled one.

    Every class of the run gets a row, also one without any calibration row.
    """
    keys = list(keys)
    pooled = finite_sample_quantile(calibration, keys, score, coverage, "global_threshold").withColumnRenamed("n", "__all")
    own = finite_sample_quantile(calibration, [*keys, label], score, coverage, "__own").withColumnRenamed("n", "n_rows")
    own = own.select(*keys, F.col(label).alias("class"), "__own", "n_rows")
    grid = pooled.withColumn("class", F.explode(ar.class_array(classes)))
    enough = F.coalesce(F.col("n_rows"), F.lit(0)) >= min_rows
    return _null_safe_join(grid, own, [*keys, "class"], "left").select(
        *keys, "class", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.when(enough, F.col("__own")).otherwise(F.col("global_threshold")).alias("threshold"), "global_threshold",
        F.when(enough, "class-conditional").otherwise("pooled-fallback").alias("threshold_source"),
    )


def pack_thresholds(thresholds: DataFrame, keys: Sequence[str], out: str = "thresholds") -> DataFrame:
    """Thresholds of a run as an array in class order (length: number of classes)."""
    return thresholds.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("class", "threshold"))).alias("__t")
    ).select(*keys, F.transform("__t", lambda t: t["threshold"]).alias(out))


def parent_probability(df: DataFrame, classes: list[str], class_parent: dict[str, str],
                       probability: str = "probability", out: str = "parent_probability") -> tuple[DataFrame, list[str]]:
    """Parent probability as the double-precision sum of its children's; parents sorted by name."""
    missing = sorted(set(classes) - set(class_parent))
    if missing:
        raise ValueError(f"classes without a parent: {missing}")
    parents = sorted({class_parent[c] for c in classes})
    return df.withColumn(out, ar.grouped_sum(F.col(probability), [class_parent[c] for c in classes], parents)), parents


def fit_temperature(df: DataFrame, keys: Sequence[str], classes: list[str], logits: str = "logits",
                    weight: str = "weight", steps: int = 41, rounds: int = 4) -> DataFrame:
    """Temperature per run minimising the weighted log loss over log T in [-4, 4].

    The loss is convex in 1/T, so a grid search that zooms in on its best point finds
    the minimum. All grid points of a round are aggregated in one pass: each row is
    expanded to its ``steps`` losses and summed map-side by (run, step).
    """
    keys = list(keys)
    if not keys:
        whole = df.withColumn("__run", F.lit(0))
        return fit_temperature(whole, ["__run"], classes, logits, weight, steps, rounds).drop("__run")
    true = ar.value_at_label(F.col(logits), ar.class_array(classes), F.col("label"))
    rows = df.select(
        *keys, F.col(logits).alias("__z"), F.array_max(logits).alias("__top"), F.col(weight).cast("double").alias("__w"),
        true.alias("__y"),
    )
    best = rows.select(*keys).distinct().withColumn("__mid", F.lit(0.0))
    half = 4.0
    for _ in range(rounds):
        step = 2 * half / (steps - 1)
        grid = F.transform(
            F.sequence(F.lit(0), F.lit(steps - 1)),
            lambda i: F.least(F.greatest(F.col("__mid") - half + i * step, F.lit(-4.0)), F.lit(4.0)),
        )
        at = _null_safe_join(rows, best.select(*keys, "__mid"), keys).select(
            *keys, "__z", "__top", "__w", "__y", F.explode(F.array_distinct(grid)).alias("__lt")
        ).withColumn("__scale", F.exp("__lt"))
        mass = F.aggregate("__z", F.lit(0.0), lambda acc, z: acc + F.exp((z - F.col("__top")) / F.col("__scale")))
        nll = F.ln(mass) + (F.col("__top") - F.col("__y")) / F.col("__scale")
        losses = at.groupBy(*keys, "__lt").agg((F.sum(nll * F.col("__w")) / F.sum("__w")).alias("loss"))
        best = losses.groupBy(*keys).agg(F.min(F.struct("loss", "__lt")).alias("__b")).select(
            *keys, F.col("__b.__lt").alias("__mid"), F.col("__b.loss").alias("loss")
        )
        half = step
    return best.select(*keys, F.exp("__mid").alias("temperature"), F.col("__mid").alias("log_temperature"), "loss")


def calibration_support(calibration: DataFrame, keys: Sequence[str], classes: list[str], parents: list[str],
                        declared: DataFrame | None = None, coverage: float = 0.95) -> DataFrame:
    """Per run, level and label: calibration rows and clusters, threshold source and value.

    ``calibration`` has probability and parent_probability arrays. ``declared`` may hold
    ``declared_threshold`` per run, compared with the recomputed pooled one.
    """
    keys = list(keys)
    blocks = []
    for level, names, vector, label in (
        ("label", classes, "probability", "label"), ("parent", parents, "parent_probability", "parent"),
    ):
        scored = nonconformity(calibration, names, vector, label)
        table = class_thresholds(scored, keys, names, "score", label, coverage)
        clusters = scored.groupBy(*keys, F.col(label).alias("class")).agg(F.countDistinct("cluster_id").alias("n_clusters"))
        blocks.append(
            _null_safe_join(table, clusters, [*keys, "class"], "left")
            .withColumn("level", F.lit(level)).withColumn("n_clusters", F.coalesce("n_clusters", F.lit(0)))
        )
    support = blocks[0].unionByName(blocks[1])
    if declared is None:
        return support
    joined = _null_safe_join(support, declared, keys, "left")
    gap = F.abs(F.col("declared_threshold") - F.col("global_threshold"))
    return joined.withColumn("declared_gap", F.when(F.col("level") == "label", gap)).withColumn(
        "declared_threshold", F.when(F.col("level") == "label", F.col("declared_threshold"))
    )
