"""Peak tables to sparse, normalised feature tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.schema import require_columns


def _finite(column):
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf"))


def valid_peaks(peaks: DataFrame, mass_min: float, mass_max: float, rows: DataFrame | None = None) -> DataFrame:
    """Peaks on the grid with a finite, positive intensity; optionally only for known rows.

    NaN sorts above every number in Spark, so ``> 0`` alone would let it through.
    """
    require_columns(peaks, ["row_id", "mass", "intensity"], "peak table")
    kept = peaks.filter(
        _finite(F.col("mass")) & (F.col("mass") >= mass_min) & (F.col("mass") < mass_max)
        & _finite(F.col("intensity")) & (F.col("intensity") > 0)
    )
    return kept.join(rows.select("row_id"), "row_id", "left_semi") if rows is not None else kept


def normalise_total(features: DataFrame, value: str = "value") -> DataFrame:
    """Divide by the row total. A row holds at most one entry per bin, so the window is bounded by the grid."""
    total = F.sum(value).over(W.partitionBy("row_id"))
    return features.withColumn(value, F.when(total > 0, F.col(value) / total).otherwise(0.0))


def sum_bins(peaks: DataFrame, mass_min: float, bin_width: float) -> DataFrame:
    """Intensity by (row, bin); combines map-side before the shuffle."""
    at = F.floor((F.col("mass") - F.lit(float(mass_min))) / F.lit(float(bin_width))).cast("int")
    return peaks.groupBy("row_id", at.alias("bin")).agg(F.sum("intensity").alias("value"))


def bin_peaks(
    peaks: DataFrame, *, mass_min: float, mass_max: float, bin_width: float, rows: DataFrame | None = None
) -> DataFrame:
    """Fixed-grid feature table ``(row_id, bin, value)``; the values of a row sum to one."""
    n_bins = int(round((mass_max - mass_min) / bin_width))
    if n_bins < 1:
        raise ValueError("the mass grid is empty")
    binned = sum_bins(valid_peaks(peaks, mass_min, mass_max, rows), mass_min, bin_width)
    return normalise_total(binned.filter((F.col("bin") >= 0) & (F.col("bin") < n_bins)))


def rebin(features: DataFrame, *, source_width: float, target_width: float, n_bins: int) -> DataFrame:
    """Merge neighbouring bins; the incomplete bin at the end of the grid is dropped."""
    if target_width < source_width:
        raise ValueError("a finer grid needs the original peaks")
    ratio = target_width / source_width
    factor = int(round(ratio))
    if not math.isclose(ratio, factor, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError("the target width must be a whole multiple of the source width")
    usable = n_bins - n_bins % factor
    return (
        features.filter(F.col("bin") < usable)
        .groupBy("row_id", F.floor(F.col("bin") / F.lit(factor)).cast("int").alias("bin"))
        .agg(F.sum("value").alias("value"))
    )


def row_sum_violations(features: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows whose values are not finite or do not sum to one."""
    return (
        features.groupBy("row_id")
        .agg(
            F.sum("value").alias("row_sum"),
            F.max(F.when(_finite(F.col("value")), 0).otherwise(1)).alias("not_finite"),
        )
        .filter((F.col("not_finite") == 1) | (F.abs(F.col("row_sum") - 1.0) > tolerance))
    )


def density(features: DataFrame, rows: DataFrame, n_bins: int) -> DataFrame:
    """One row: table shape, number of non-zero entries and filled share."""
    filled = features.filter(F.col("value") != 0).agg(F.count("*").alias("nnz"))
    shape = rows.agg(F.count("*").alias("n_rows"))
    return shape.join(filled, F.lit(True)).select(
        "n_rows", F.lit(n_bins).cast("long").alias("n_bins"), "nnz",
        (F.col("nnz") / (F.col("n_rows") * F.lit(n_bins))).alias("density"),
    )


def l2_normalise(features: DataFrame, keys: Sequence[str] = ("row_id",), value: str = "value") -> DataFrame:
    """Scale each vector to unit length; an all-zero vector stays zero. Vectors are bounded by the grid."""
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)).over(W.partitionBy(*keys)))
    return features.withColumn(value, F.when(norm > 0, F.col(value) / norm).otherwise(F.col(value)))


def explode_vectors(df: DataFrame, vector: str, keep: Sequence[str]) -> DataFrame:
    """Array vectors to long form, values widened to double before any sum."""
    return df.select(*keep, F.posexplode(vector).alias("bin", "value")).withColumn(
        "value", F.col("value").cast("double")
    )


def pack_vectors(features: DataFrame, keys: Sequence[str], out: str = "vector") -> DataFrame:
    """Long form back to arrays ordered by bin (dense input; bounded by the grid)."""
    return (
        features.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "value"))).alias("__v"))
        .select(*keys, F.transform("__v", lambda e: e["value"]).alias(out))
    )
