"""Exact ranks of any number of rows: ranges of the order, places within a range, rows before it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm.common import stage


def ranked(rows: DataFrame, order: Sequence[Column], key: str | None = None) -> DataFrame:
    """``rows`` with ``rank`` (from 0) by ``order``; with ``key``, the first column of ``order``, within equal keys.

    Rows are dealt into ranges of the order and numbered there, run of keys by run of keys, and written.
    Only the first run of a range can go on from ranges before it: the driver reads one row a range and
    tells each how many rows of its first key came earlier. No key needs to fit in a task.
    """
    names = rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, at, last = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            if key is not None:
                codes = batch.column(key).dictionary_encode(null_encoding="encode")
                new[1:] = np.diff(codes.indices.to_numpy(zero_copy_only=False)) != 0
                first = (batch.column(key)[0].as_py(),)
                new[0] = last is not None and last != first
                last = (batch.column(key)[n - 1].as_py(),)
            starts = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            places = np.where(starts < 0, at + np.arange(n), np.arange(n) - starts)
            runs = run + np.cumsum(new)
            run, at = int(runs[-1]), int(places[-1]) + 1
            extra = [pa.array(np.full(n, part, np.int32)), pa.array(runs), pa.array(places)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, "_part", "_run", "_at"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_run", T.LongType()), T.StructField("_at", T.LongType())])
    dealt = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema), "ranges")
    value = F.struct(F.col(key) if key is not None else F.lit(0).alias("all"))
    ends = dealt.groupBy("_part").agg(
        F.min_by(value, "_run").alias("first"), F.max_by(value, "_run").alias("last"),
        F.max(F.struct("_run", "_at")).alias("end"),
    )
    before, last, carried = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):  # one row a range
        base = carried if last is not None and last == r["first"] else 0
        before.append((r["_part"], base))
        last, carried = r["last"], r["end"]["_at"] + 1 + (base if r["end"]["_run"] == 0 else 0)
    bases = rows.sparkSession.createDataFrame(before, "_part int, _base long")
    placed = dealt.join(F.broadcast(bases), "_part")
    return placed.select(*names, (F.col("_at") + F.when(F.col("_run") == 0, F.col("_base")).otherwise(F.lit(0))).alias("rank"))
