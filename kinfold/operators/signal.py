"""Profile preprocessing: square root, smoothing, baseline, binning, peak detection.

A profile is the points of one ``row_id`` ordered by mass; its length is bounded by the
instrument's grid, so per-profile windows are bounded too.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.operators.features import normalise_total, sum_bins

MAD_SCALE = 1.4826  # fixed value: makes the MAD match a normal SD


def square_root(points: DataFrame, value: str = "intensity") -> DataFrame:
    return points.withColumn(value, F.sqrt(value))


@lru_cache(maxsize=8)
def smoothing_rows(half: int, degree: int = 3) -> tuple[tuple[float, ...], ...]:
    """Least-squares polynomial weights: row r gives the fitted value at offset r of a 2*half+1 window."""
    x = np.arange(-half, half + 1, dtype=float)
    design = np.vander(x / max(half, 1), degree + 1, increasing=True)
    return tuple(tuple(row) for row in design @ np.linalg.pinv(design))


def smooth(points: DataFrame, half: int = 10, value: str = "intensity") -> DataFrame:
    """Savitzky-Golay smoothing; the ends use the polynomial of the first and last full window.

    Profiles shorter than one window pass unchanged.
    """
    width = 2 * half + 1
    order = W.partitionBy("row_id").orderBy("mass")
    around = F.collect_list(value).over(order.rowsBetween(-2 * half, 2 * half))
    at = F.row_number().over(order) - 1
    n = F.count("*").over(W.partitionBy("row_id"))
    held = points.select("*", around.alias("__w"), at.alias("__at"), n.cast("int").alias("__n"))
    start = F.least(F.greatest(F.col("__at") - half, F.lit(0)), F.col("__n") - width)
    offset = start - F.greatest(F.col("__at") - 2 * half, F.lit(0))
    weights = F.array(*[F.array(*[F.lit(float(c)) for c in row]) for row in smoothing_rows(half)])
    pairs = F.zip_with(F.slice("__w", offset + 1, F.lit(width)), F.get(weights, F.col("__at") - start), lambda y, c: y * c)
    fitted = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)
    return held.withColumn(value, F.when(F.col("__n") >= width, fitted).otherwise(F.col(value))).drop("__w", "__at", "__n")


def _clip_baseline(values: np.ndarray, iterations: int) -> np.ndarray:
    """Iterative peak clipping from the widest half-window to the narrowest."""
    base = values.astype(float).copy()
    for i in range(min(iterations, (len(base) - 1) // 2), 0, -1):
        base[i:-i] = np.minimum(base[i:-i], (base[: -2 * i] + base[2 * i:]) / 2.0)
    return base


def remove_baseline(points: DataFrame, iterations: int = 100) -> DataFrame:
    """Subtract the clipped baseline of each profile and set negative values to zero."""

    def per_profile(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("mass", kind="stable")
        y = part["intensity"].to_numpy(dtype=float)
        return part.assign(intensity=np.maximum(y - _clip_baseline(y, iterations), 0.0))

    columns = points.select("row_id", "mass", "intensity")
    kinds = {f.name: f.dataType.simpleString() for f in columns.schema.fields}
    return columns.groupBy("row_id").applyInPandas(
        per_profile, f"row_id {kinds['row_id']}, mass {kinds['mass']}, intensity double"
    )


def bin_profile(points: DataFrame, mass_min: float, mass_max: float, bin_width: float) -> DataFrame:
    """Processed points to bins summing to one per profile."""
    n_bins = int(round((mass_max - mass_min) / bin_width))
    finite = F.col("intensity").isNotNull() & ~F.isnan("intensity") & (F.abs("intensity") < float("inf"))
    return normalise_total(
        sum_bins(points.filter(finite), mass_min, bin_width).filter((F.col("bin") >= 0) & (F.col("bin") < n_bins))
    )


def detect_peaks(points: DataFrame, half: int = 10, snr: float = 2.0) -> DataFrame:
    """Points that are the maximum of their +-half neighbourhood and exceed SNR x MAD noise."""
    middle = points.groupBy("row_id").agg(F.median("intensity").alias("__mid"))
    spread = points.join(middle, "row_id").groupBy("row_id").agg(
        (F.median(F.abs(F.col("intensity") - F.col("__mid"))) * F.lit(MAD_SCALE)).alias("noise")
    )
    near = W.partitionBy("row_id").orderBy("mass").rowsBetween(-half, half)
    peaks = points.withColumn("__top", F.max("intensity").over(near)).filter("intensity = __top").drop("__top")
    return peaks.join(spread, "row_id").filter(F.col("intensity") > F.lit(snr) * F.col("noise"))


def profile_stats(points: DataFrame, peaks: DataFrame) -> DataFrame:
    """Point count, mass range and peak count per profile."""
    counts = peaks.groupBy("row_id").agg(F.count("*").alias("peak_count"))
    return points.groupBy("row_id").agg(
        F.count("*").alias("point_count"), F.min("mass").alias("min_mass"), F.max("mass").alias("max_mass")
    ).join(counts, "row_id", "left").fillna(0, ["peak_count"])


def preprocess(points: DataFrame, half: int = 10, iterations: int = 100) -> DataFrame:
    return remove_baseline(smooth(square_root(points), half), iterations)
