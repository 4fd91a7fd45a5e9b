"""Sinks: feature bundles, split tables, metric tables, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.audits import coverage_violations
from kinfold.operators.features import density
from kinfold.schema import assert_empty


def write_bundle(features: DataFrame, rows: DataFrame, path: str, n_bins: int, parameters: dict[str, str]) -> None:
    """Features, rows and a one-row metadata table with shape, non-zeros, density and parameters.

    Metadata is computed from the written files, so the feature plan runs once.
    """
    spark = features.sparkSession
    features.write.mode("overwrite").parquet(f"{path}/features")
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    stored = density(spark.read.parquet(f"{path}/features"), spark.read.parquet(f"{path}/rows"), n_bins)
    pairs = [F.lit(x) for k in sorted(parameters) for x in (k, str(parameters[k]))]
    given = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    stored.withColumn("parameters", given).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, rows, metadata); every feature row must be a known row, row ids must be unique."""
    features, rows = spark.read.parquet(f"{path}/features"), spark.read.parquet(f"{path}/rows")
    unknown = features.select("row_id").distinct().join(rows, "row_id", "left_anti")
    assert_empty(unknown, "features of unknown rows")
    assert_empty(rows.groupBy("row_id").count().filter("count > 1"), "repeated row ids")
    return features, rows, spark.read.json(f"{path}/metadata")


def write_splits(splits: DataFrame, path: str) -> None:
    splits.write.mode("overwrite").partitionBy("design", "seed", "fold").parquet(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def split_header(splits: DataFrame) -> DataFrame:
    """One row: seeds, designs, folds and row count (each list is one short axis of the grid)."""
    listed = lambda c: F.array_sort(F.collect_set(c))
    return splits.agg(listed("seed").alias("seeds"), listed("design").alias("designs"), listed("fold").alias("folds"),
                      F.count("*").alias("assignments"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Metric or prediction table as Parquet, CSV or JSON."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_ledger(files: DataFrame, runs: DataFrame, expected: DataFrame, path: str) -> None:
    """File records, run records and the expected run keys of a frozen input set."""
    expected_keys = expected.columns
    assert_empty(coverage_violations(
        expected.select(F.concat_ws("|", *expected_keys).alias("key")), runs.select(F.concat_ws("|", *expected_keys).alias("key")), "key"
    ), "run records and expected runs differ")
    files.write.mode("overwrite").json(f"{path}/files")
    runs.write.mode("overwrite").json(f"{path}/runs")
    expected.write.mode("overwrite").json(f"{path}/expected")
