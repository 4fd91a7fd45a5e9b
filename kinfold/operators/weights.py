"""Row weights that stop replicates and large labels from dominating."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.ranking import _null_safe_join


def training_weights(rows: DataFrame, keys: Sequence[str] = (), out: str = "weight") -> DataFrame:
    """Equal mass per label, per cluster in a label and per row in a cluster; mean weight is one.

    The raw weights of one label sum to one, so the scale factor is rows / labels.
    """
    keys = list(keys)
    clusters = rows.groupBy(*keys, "label", "cluster_id").agg(F.count("*").alias("__rows"))
    labels = clusters.groupBy(*keys, "label").agg(
        F.count("*").alias("__clusters"), F.sum("__rows").alias("__label_rows")
    )
    overall = labels.groupBy(*keys).agg(F.count("*").alias("__labels"), F.sum("__label_rows").alias("__all"))
    table = _null_safe_join(clusters, labels.drop("__label_rows"), [*keys, "label"])
    table = _null_safe_join(table, overall, keys).select(
        *keys, "label", "cluster_id",
        (F.col("__all") / F.col("__labels") / (F.col("__clusters") * F.col("__rows"))).alias(out),
    )
    return _null_safe_join(rows, table, [*keys, "label", "cluster_id"])


def evaluation_weights(rows: DataFrame, keys: Sequence[str] = (), out: str = "weight") -> DataFrame:
    """Every cluster has the same total weight, split over its rows; weights sum to one."""
    keys = list(keys)
    clusters = rows.groupBy(*keys, "cluster_id").agg(F.count("*").alias("__rows"))
    overall = clusters.groupBy(*keys).agg(F.count("*").alias("__clusters"))
    table = _null_safe_join(clusters, overall, keys).select(
        *keys, "cluster_id", (F.lit(1.0) / F.col("__rows") / F.col("__clusters")).alias(out)
    )
    return _null_safe_join(rows, table, [*keys, "cluster_id"])
