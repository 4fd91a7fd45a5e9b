"""Audits: each returns a table of violations, empty when all is well."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import arrays as ar


def grid(spark: SparkSession, axes: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of a few short axes (a run grid: hundreds of rows)."""
    names = list(axes)
    table = spark.createDataFrame([(list(axes[names[0]]),)], [names[0]]).select(F.explode(names[0]).alias(names[0]))
    for name in names[1:]:
        table = table.withColumn(name, F.explode(F.array(*[F.lit(v) for v in axes[name]])))
    return table


def set_difference(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, tagged ``missing`` or ``unexpected``; one shuffle for both directions."""
    tag = lambda df, e, o: df.select(*keys).distinct().select(*keys, F.lit(e).alias("e"), F.lit(o).alias("o"))
    both = tag(expected, 1, 0).unionByName(tag(observed, 0, 1))
    return both.groupBy(*keys).agg(F.max("e").alias("e"), F.max("o").alias("o")).filter("e != o").select(
        *keys, F.when(F.col("e") == 1, "missing").otherwise("unexpected").alias("problem")
    )


def same_members(df: DataFrame, keys: Sequence[str], side: str, left: str, right: str, member: str) -> DataFrame:
    """Members found under one value of ``side`` only, per key."""
    on = lambda v: F.max((F.col(side) == v).cast("int"))
    return df.groupBy(*keys, member).agg(on(left).alias("l"), on(right).alias("r")).filter("l != r").select(
        *keys, member, F.when(F.col("l") == 1, left).otherwise(right).alias("only_in")
    )


def invalid_probabilities(df: DataFrame, n_classes: int, probability: str = "probability", tolerance: float = 1e-6) -> DataFrame:
    """Rows whose array is not a distribution over the classes."""
    p = F.col(probability)
    return df.filter(p.isNull() | (F.size(p) != n_classes) | ~F.coalesce(ar.is_distribution(p, tolerance), F.lit(False)))


def out_of_fold_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows predicted more than once, or with more than one truth, in a pooled run."""
    per = df.groupBy(*keys, "row_id").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"))
    return per.filter("n > 1 OR labels > 1").select(
        *keys, "row_id", F.when(F.col("labels") > 1, "inconsistent label").otherwise("duplicate prediction").alias("problem")
    )


def dependency_violations(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """Values of ``determinant`` with more than one ``dependent`` value."""
    return df.groupBy(determinant).agg(F.countDistinct(dependent).alias("n_values")).filter("n_values > 1")


def coverage_violations(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys present in one table only, or repeated in either."""
    tag = lambda df, l, r: df.groupBy(key).agg(F.count("*").alias("n")).select(
        key, (F.col("n") * l).alias("l"), (F.col("n") * r).alias("r"))
    both = tag(left, 1, 0).unionByName(tag(right, 0, 1)).groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return both.filter("l != 1 OR r != 1").select(key, F.col("l").alias("left_rows"), F.col("r").alias("right_rows"))


def reconcile(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Ledger against inventory: ``missing``, ``extra`` or ``changed`` paths, with both digests."""
    d = declared.select("path", F.col("bytes").alias("declared_bytes"), F.col("sha256").alias("declared_sha256"))
    a = actual.select("path", F.col("bytes").alias("actual_bytes"), F.col("sha256").alias("actual_sha256"))
    changed = ~(F.col("declared_bytes").eqNullSafe(F.col("actual_bytes")) & F.col("declared_sha256").eqNullSafe(F.col("actual_sha256")))
    status = (
        F.when(F.col("actual_sha256").isNull(), "missing").when(F.col("declared_sha256").isNull(), "extra")
        .when(changed, "changed")
    )
    return d.join(a, "path", "full").withColumn("status", status).filter(F.col("status").isNotNull())


def reconcile_cells(expected: DataFrame, stored: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Expected cells against stored cells: missing, unexpected, repeated, incomplete, or with other field values."""
    e = expected.select(*keys, *[F.col(f).alias(f"expected_{f}") for f in fields], F.lit(True).alias("__e"))
    s = stored.groupBy(*keys).agg(
        F.count("*").alias("__copies"), F.min("status").alias("__status"),
        *[F.min(f).alias(f"stored_{f}") for f in fields], *[F.max(f).alias(f"__max_{f}") for f in fields],
    )
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"expected_{f}").eqNullSafe(F.col(f"stored_{f}")) & F.col(f"stored_{f}").eqNullSafe(F.col(f"__max_{f}"))
    problem = (
        F.when(F.col("__copies").isNull(), "missing").when(F.col("__e").isNull(), "unexpected")
        .when(F.col("__copies") > 1, "repeated").when(F.col("__status") != "complete", "incomplete")
        .when(~same, "field mismatch")
    )
    joined = e.join(s, list(keys), "full").withColumn("problem", problem)
    return joined.filter(F.col("problem").isNotNull()).select(*keys, "problem")
