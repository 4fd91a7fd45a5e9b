"""Scans: peak tables, metadata, export manifests, acquisition text, run outputs, file inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.functions import text as tx
from kinfold.schema import PEAKS, require_columns


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """Peak table, CSV with a header or Parquet by suffix; only the three peak columns are read."""
    if path.lower().endswith((".csv", ".csv.gz")):
        table = spark.read.option("header", True).csv(path)
        require_columns(table, PEAKS.names, "peak table")
        return table.select("row_id", F.col("mass").try_cast("double").alias("mass"),
                            F.col("intensity").try_cast("double").alias("intensity"))
    return read_columns(spark, path, PEAKS.names)


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Column-pruned Parquet scan with the required-column gate."""
    table = spark.read.parquet(path)
    require_columns(table, columns, path)
    return table.select(*columns)


def read_metadata(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """JSON-lines acquisition metadata, every field as text; adds ``source_key``."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    require = "archive_spectrum_dir"
    if require not in columns:
        raise KeyError(f"metadata needs {require}")
    return spark.read.schema(schema).json(path).withColumn("source_key", tx.source_key(F.col(require)))


def read_export_manifest(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """One JSON document with ``records[]``; adds the record position as ``profile_row``."""
    schema = T.StructType([T.StructField("records", T.ArrayType(record))])
    document = spark.read.schema(schema).option("multiLine", True).json(path)
    return document.select(F.posexplode("records").alias("profile_row", "r")).select("profile_row", "r.*")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """``alias_map`` of a JSON document as ``(alias, canonical)`` rows."""
    schema = T.StructType([T.StructField("alias_map", T.MapType(T.StringType(), T.StringType()))])
    document = spark.read.schema(schema).option("multiLine", True).json(path)
    return document.select(F.explode("alias_map").alias("alias", "canonical"))


# fixed values: tag -> output column
_TAGS_FIRST = {
    "GEN": "raw_genus_label", "SPE": "raw_species_epithet", "STR": "raw_strain_label", "TYP": "raw_type_label",
    "GTI": "growth_time", "TEM": "growth_temperature", "AIR": "atmosphere", "MED": "growth_medium", "SPO": "spore_status",
}
_TAGS_THIRD = {"TRT": "prep_method", "EXT": "operator_label", "CAL": "calibration_material", "CUS": "source_lab"}


def parse_acquisition(files: DataFrame, text: str = "value") -> DataFrame:
    """Acquisition files (one row per file) to 17 columns."""
    first = tx.tag_map(tx.acquisition_field(F.col(text), "CMT1"))
    third = tx.tag_map(tx.acquisition_field(F.col(text), "CMT3"))
    tagged = files.select("*", first.alias("__1"), third.alias("__3"))
    value = lambda m, k: F.when(F.length(F.try_element_at(m, F.lit(k))) > 0, F.try_element_at(m, F.lit(k)))
    number = F.coalesce(value(F.col("__1"), "UIE"), value(F.col("__1"), "UID"))
    named = tagged.select(
        "*", *[value(F.col("__1"), k).alias(c) for k, c in _TAGS_FIRST.items()],
        *[value(F.col("__3"), k).alias(c) for k, c in _TAGS_THIRD.items()],
        F.when(number.rlike(r"^\d+$"), number.try_cast("bigint")).alias("taxid"),
        tx.acquisition_field(F.col(text), "AQ_DATE").alias("acquisition_date"),
        tx.acquisition_field(F.col(text), "CMT2").alias("measurement_label"),
    )
    both = F.col("raw_genus_label").isNotNull() & F.col("raw_species_epithet").isNotNull()
    return named.withColumn(
        "raw_species_label", F.when(both, F.concat_ws(" ", "raw_genus_label", "raw_species_epithet"))
    ).drop(text, "__1", "__3")


def read_acquisition(spark: SparkSession, path: str, pattern: str = "acqu") -> DataFrame:
    """Acquisition files below ``path`` (Latin-1 text); one row per file with ``source_path``."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    )
    return parse_acquisition(files.select(F.col("path").alias("source_path"), F.decode("content", "ISO-8859-1").alias("value")))


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """Published reference peaks ``(pkf_file, identity, mass)``."""
    columns = ["pkf_file", "identity", "mass"]
    if path.lower().endswith(".csv"):
        return spark.read.option("header", True).csv(path).select(
            "pkf_file", "identity", F.col("mass").try_cast("double").alias("mass"))
    return read_columns(spark, path, columns)


def read_runs(spark: SparkSession, predictions: str, runs: str) -> DataFrame:
    """Predictions of complete runs only.

    Run keys are partition columns, so the filter on status becomes dynamic partition
    pruning: outputs of unfinished runs are never opened.
    """
    keys = ["design", "model", "seed", "fold"]
    complete = spark.read.parquet(runs).filter(F.col("status") == "complete").select(*keys).distinct()
    return spark.read.parquet(predictions).join(complete, keys, "left_semi")


def file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, bytes, sha256)`` of every file below ``path``; digests are computed in the tasks."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    )
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


# fixed values: the parts of a raw measurement, in digest order
PARTS = ("fid", "acqu", "acqus")


def measurement_digests(spark: SparkSession, path: str) -> DataFrame:
    """One digest per measurement folder over its named parts, each led by ``name\\0``.

    A folder without the first part has no digest and no row. The list that is joined
    here has at most three entries.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    parts = files.select(
        F.regexp_replace("path", "/[^/]*$", "").alias("directory"), name.alias("name"), "content"
    ).filter(F.col("name").isin(*PARTS))
    order = F.array_position(F.array(*[F.lit(p) for p in PARTS]), F.col("name"))
    block = F.concat(F.encode("name", "UTF-8"), F.unhex(F.lit("00")), F.col("content"))
    joined = parts.groupBy("directory").agg(
        F.array_sort(F.collect_list(F.struct(order.alias("o"), block.alias("b")))).alias("l"),
        F.max((F.col("name") == PARTS[0]).cast("int")).alias("has_first"),
    ).filter("has_first = 1")
    piece = lambda i: F.coalesce(F.get("l", F.lit(i))["b"], F.unhex(F.lit("")))
    return joined.select("directory", F.sha2(F.concat(*[piece(i) for i in range(len(PARTS))]), 256).alias("digest"))
