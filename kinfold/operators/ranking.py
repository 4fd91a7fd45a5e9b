"""Exact ranks, running totals and order statistics that survive hot groups.

A plain window sorts each group in one task. Here a group above ``HOT_ROWS`` is cut
into ordered buckets, each bucket is ranked on its own, and the sizes of the buckets
before it are added. Groups below the limit take the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000


def hash_fraction(hexed: Column) -> Column:
    """Position of a hex digest in [0, 1); increases with the digest."""
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def logit_bucket(score: Column, per_unit: int = 16) -> Column:
    """Non-decreasing integer bucket that keeps resolution near 0 and near 1.

    Values outside [0, 1] fall in the end buckets, so the order is still right.
    """
    p = F.least(F.greatest(score.cast("double"), F.lit(1e-15)), F.lit(1.0 - 1e-15))
    return F.floor(F.ln(p / (F.lit(1.0) - p)) * per_unit).cast("int")


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"__r_{k}"])
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the largest group: one map-side-combined aggregate, one number to the driver."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n")) if keys else df.agg(F.count("*").alias("n"))
    return int(sizes.agg(F.max("n")).first()[0] or 0)


def rank_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    position: Column | str,
    out: str = "rank",
    size: str | None = None,
    hot_rows: int = HOT_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """1-based row number within ``keys`` by ``order``; ``size`` also names a group-size column.

    The largest group is measured first (or given by a caller that knows a bound). When it
    fits one task, a plain window does the work. Otherwise groups above ``hot_rows`` are cut:
    ``position`` is a value in [0, 1) that never decreases along ``order[0]`` and decides
    where; the name of a numeric column means its place between the group's own minimum
    and maximum. The table of hot groups has at most rows / hot_rows entries and that of their
    cuts a few times as many, which bounds what is sent to every task.
    """
    keys = list(keys)
    if not keys:
        whole = df.withColumn("__table", F.lit(0))
        return rank_in_group(whole, ["__table"], order, position, out, size, hot_rows, largest).drop("__table")
    if (largest_group(df, keys) if largest is None else largest) <= hot_rows:
        ranked = df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))
        return ranked.withColumn(size, F.count("*").over(W.partitionBy(*keys))) if size else ranked
    bounds = []
    if isinstance(position, str):
        bounds = [F.min(position).alias("__lo"), F.max(position).alias("__hi")]
        position = (F.col(position) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n"), *bounds)
    hot = sizes.filter(F.col("__n") > hot_rows).withColumn("__cuts", F.ceil(F.col("__n") / F.lit(hot_rows)).cast("int") * 2).drop("__n")
    sizes = sizes.drop("__lo", "__hi")
    cut = _null_safe_join(df, F.broadcast(hot), keys, "left").withColumn(
        "__cut", F.coalesce(F.floor(position * F.col("__cuts")).cast("int"), F.lit(0))
    )
    before = (
        cut.filter(F.col("__cuts") > 1)
        .groupBy(*keys, "__cut").agg(F.count("*").alias("__m"))
        .withColumn(
            "__before",
            F.sum("__m").over(W.partitionBy(*keys).orderBy("__cut").rowsBetween(W.unboundedPreceding, -1)),
        )
        .drop("__m")
    )
    ranked = cut.withColumn("__rn", F.row_number().over(W.partitionBy(*keys, "__cut").orderBy(*order)))
    ranked = (
        _null_safe_join(ranked, F.broadcast(before), [*keys, "__cut"], "left")
        .withColumn(out, (F.col("__rn") + F.coalesce(F.col("__before"), F.lit(0))).cast("long"))
        .drop("__cuts", "__cut", "__rn", "__before", "__lo", "__hi")
    )
    return _null_safe_join(ranked, sizes.withColumnRenamed("__n", size), keys, "left") if size else ranked


def hash_rank(df: DataFrame, keys: Sequence[str], token: Column, tie: Sequence[str], out: str = "rank",
              size: str | None = None, hot_rows: int = HOT_ROWS, largest: int | None = None) -> DataFrame:
    """1-based rank within ``keys`` in the order of a hash key."""
    with_token = df.withColumn("__token", token)
    return rank_in_group(
        with_token, keys, ["__token", *tie], hash_fraction(F.col("__token")), out, size, hot_rows, largest
    ).drop("__token")


def add_group_size(df: DataFrame, keys: Sequence[str], out: str = "group_size") -> DataFrame:
    """Attach the row count of each group by aggregate-and-join.

    Unlike ``count over (partition by ...)`` the counts combine map-side, and adaptive
    execution can split the join for a hot group.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias(out))
    return _null_safe_join(df, sizes, list(keys), "left")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    totals: dict[str, Column],
    descending: bool = False,
    bucket: Column | None = None,
) -> DataFrame:
    """Per distinct ``value``: its totals, totals up to and including it, and group totals.

    Ties are summed first, so a popular value is one row. ``bucket`` (non-decreasing in
    ``value``) cuts each group into pieces that are accumulated independently; the
    default suits scores in [0, 1].
    Columns: keys, value, t, t__cum, t__all for every total t.
    """
    keys = list(keys)
    cut = bucket if bucket is not None else logit_bucket(F.col(value))
    grouped = df.groupBy(*keys, value).agg(*[c.alias(t) for t, c in totals.items()]).withColumn("__cut", cut)
    direction = lambda name: F.desc(name) if descending else F.asc(name)
    pieces = grouped.groupBy(*keys, "__cut").agg(*[F.sum(t).alias(f"__p_{t}") for t in totals])
    earlier = W.partitionBy(*keys).orderBy(direction("__cut")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(*keys)
    offsets = pieces.select(
        *keys, "__cut",
        *[F.coalesce(F.sum(f"__p_{t}").over(earlier), F.lit(0)).alias(f"__before_{t}") for t in totals],
        *[F.sum(f"__p_{t}").over(everything).alias(f"{t}__all") for t in totals],
    )
    inside = W.partitionBy(*keys, "__cut").orderBy(direction(value)).rowsBetween(W.unboundedPreceding, 0)
    local = grouped.select("*", *[F.sum(t).over(inside).alias(f"__in_{t}") for t in totals])
    joined = _null_safe_join(local, offsets, [*keys, "__cut"])
    return joined.select(
        *keys, value, *totals,
        *[(F.col(f"__in_{t}") + F.col(f"__before_{t}")).alias(f"{t}__cum") for t in totals],
        *[f"{t}__all" for t in totals],
    )


def order_statistic(
    df: DataFrame, keys: Sequence[str], value: str, rank: Column, out: str = "threshold", count: str = "n",
    bucket: Column | None = None,
) -> DataFrame:
    """Value at a 1-based rank that may depend on ``n`` (the group's row count).

    One row per group; ``out`` is NULL when the rank lies outside 1..n.
    """
    totals = running_totals(df.filter(F.col(value).isNotNull()), keys, value, {"__c": F.count("*")}, bucket=bucket)
    wanted = totals.withColumn(count, F.col("__c__all")).withColumn("__rank", rank)
    hit = (F.col("__rank") > F.col("__c__cum") - F.col("__c")) & (F.col("__rank") <= F.col("__c__cum"))
    return wanted.groupBy(*keys).agg(F.max(count).alias(count), F.max(F.when(hit, F.col(value))).alias(out))


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, levels: dict[str, float], count: str = "n",
    bucket: Column | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles for groups of any size, one column per level."""
    totals = running_totals(df.filter(F.col(value).isNotNull()), keys, value, {"__c": F.count("*")}, bucket=bucket)
    high, size = F.col("__c__cum"), F.col("__c__all")
    low = high - F.col("__c")
    picks = []
    for name, q in levels.items():
        place = (size - 1) * F.lit(float(q)) + 1
        for tag, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picks.append(F.max(F.when((at > low) & (at <= high), F.col(value))).alias(f"__{name}_{tag}"))
    n = F.col(count)
    result = totals.groupBy(*keys).agg(F.max("__c__all").alias(count), *picks)
    place = lambda q: (n - 1) * F.lit(float(q))
    return result.select(
        *keys, count,
        *[
            (
                F.col(f"__{name}_lo")
                + (F.col(f"__{name}_hi") - F.col(f"__{name}_lo")) * (place(q) - F.floor(place(q)))
            ).alias(name)
            for name, q in levels.items()
        ],
    )


def group_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return quantiles(df, keys, value, {out: 0.5}, count="__n").drop("__n")
