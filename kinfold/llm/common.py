"""Shared folder, staged tables and small helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a scratch folder only in local mode without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


#: Whether a query's shuffle files go as soon as it ends; else they stay until the driver's collector finds that nothing refers to them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run within leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write a table into the shared folder and read it again: computed once, and no lost executor replays it.

    What the write shuffled is removed at once, so that a stage of many steps takes the disk of its largest step, not of all.
    """
    path = new_path(df.sparkSession, what)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch than by default, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_row_key(docs: DataFrame, name: str = "_row") -> DataFrame:
    """Add a 64-bit key of each row's place in its file; a table that isn't read from files is staged first."""
    try:
        place = docs.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(name))
        place.schema  # noqa: B018  resolves the file's own columns
        return place
    except AnalysisException:
        staged = stage(docs, "rows")
        return staged.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(name))


def text_slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice has about ``limit`` bytes; one row longer than that comes alone."""
    for batch in batches:
        rows = max(1, int(limit * batch.num_rows / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def crc_fold(column: str, modulus: int):
    """crc32 of the decimal text of an id, modulo ``modulus``: which rows are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        REGISTRY[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap
