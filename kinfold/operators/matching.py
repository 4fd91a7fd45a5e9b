"""Published peak lists against local peaks: unambiguous identities and nearest masses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.operators.ranking import _null_safe_join, quantiles


def unambiguous_clusters(rows: DataFrame, identity: str = "identity") -> DataFrame:
    """``(identity, cluster_id)`` for identities carried by exactly one cluster."""
    return rows.groupBy(identity).agg(
        F.min("cluster_id").alias("cluster_id"), F.max("cluster_id").alias("__last")
    ).filter("cluster_id = __last").drop("__last")


def ambiguous_identities(references: DataFrame, rows: DataFrame, identity: str = "identity") -> DataFrame:
    """Reference identities with no cluster or several, and how many."""
    counts = rows.groupBy(identity).agg(F.countDistinct("cluster_id").alias("matched_clusters"))
    return references.select(identity).distinct().join(counts, identity, "left").withColumn(
        "matched_clusters", F.coalesce("matched_clusters", F.lit(0))).filter("matched_clusters != 1")


def nearest_mass(references: DataFrame, local: DataFrame, group: Sequence[str], mass: str = "mass",
                 bucket_width: float = 64.0) -> DataFrame:
    """Distance from each reference mass to the nearest local mass of its group; NULL without one.

    The mass axis is cut into buckets. A reference looks at the local masses of its own
    bucket, sorted together, plus the last local mass before and the first after the
    bucket, which come from one bucket-level minimum and maximum. No pair is formed,
    and a hot group is spread over its buckets.
    """
    group = list(group)
    cut = F.floor(F.col(mass) / F.lit(float(bucket_width))).cast("long").alias("__cut")
    tag = lambda df, kind: df.select(*group, F.col(mass).cast("double").alias("__m"), cut, F.lit(kind).alias("__k"))
    both = tag(local, 0).unionByName(tag(references, 1))
    extremes = both.groupBy(*group, "__cut").agg(
        F.min(F.when(F.col("__k") == 0, F.col("__m"))).alias("__lo"), F.max(F.when(F.col("__k") == 0, F.col("__m"))).alias("__hi")
    )
    along = W.partitionBy(*group).orderBy("__cut")
    borders = extremes.select(
        *group, "__cut",
        F.last("__hi", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias("__before"),
        F.first("__lo", ignorenulls=True).over(along.rowsBetween(1, W.unboundedFollowing)).alias("__after"),
    )
    inside = W.partitionBy(*group, "__cut").orderBy("__m", "__k")
    own = F.when(F.col("__k") == 0, F.col("__m"))
    near = both.withColumn("__left", F.last(own, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))).withColumn(
        "__right", F.first(own, ignorenulls=True).over(inside.rowsBetween(0, W.unboundedFollowing))
    ).filter("__k = 1")
    joined = _null_safe_join(near, borders, [*group, "__cut"], "left")
    distance = F.least(*[F.abs(F.col(c) - F.col("__m")) for c in ("__left", "__right", "__before", "__after")])
    return joined.select(*group, F.col("__m").alias(mass), distance.alias("distance"))


def match_quality(distances: DataFrame, keys: Sequence[str], tolerance: float = 2.0) -> DataFrame:
    """Peaks matched within the tolerance, their share, and median and largest error."""
    keys = list(keys)
    found = F.col("distance").isNotNull()
    base = distances.groupBy(*keys).agg(
        F.count("*").alias("n_peaks"), F.sum((found & (F.col("distance") <= tolerance)).cast("long")).alias("matched"),
        F.avg(F.when(found, (F.col("distance") <= tolerance).cast("double"))).alias("match_share"),
        F.max("distance").alias("max_error"),
    )
    cut = F.floor(F.ln(F.col("distance") + F.lit(1e-9)) * 8).cast("int")
    medians = quantiles(distances, keys, "distance", {"median_error": 0.5}, bucket=cut).drop("n")
    return _null_safe_join(base, medians, keys, "left")


def quality_summary(quality: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    cut = F.floor(F.col("match_share") * 256).cast("int")
    middle = quantiles(quality, keys, "match_share", {"median_match_share": 0.5}, count="n_clusters", bucket=cut)
    least = quality.groupBy(*keys).agg(F.min("match_share").alias("min_match_share"), F.max("max_error").alias("max_error"))
    return _null_safe_join(middle, least, list(keys))
