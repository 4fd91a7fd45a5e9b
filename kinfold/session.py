"""Session settings and tables staged in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "kinfold", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on; cluster settings always win over ours."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``; a scratch folder only in a single JVM without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it again.

    It cuts the lineage, so a lost executor never forces a replay of a loop; as Parquet it also keeps
    column pruning, pushed filters and sizes for the plans that follow.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a partition that a generator is about to multiply.
DEALT = 32_768


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Stage a table and hash its rows by ``columns`` over partitions of about ``DEALT`` rows, however many they are.

    A generator may then copy rows to cells: sums by these columns within a cell need no other shuffle.
    """
    staged = durable(df)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged.repartition(max(least, -(-staged.count() // DEALT)), *columns)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash rows over all shuffle partitions before a generator multiplies them.

    The number is given explicitly, so adaptive execution does not merge the small
    partitions of a table that is about to grow by the replicate count.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
