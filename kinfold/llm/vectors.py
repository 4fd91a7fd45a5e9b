"""What the two vector searches share: valid vectors, blocks of them, merging of their finds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinfold.llm.common import small_batches

BLOCK, QUERIES = 4096, 1024


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", zero: bool = False) -> DataFrame:
    """``vec_id, row, vector`` (double) of the rows that take part; to be staged, as ``row`` numbers them.

    Null ids, null or empty vectors and vectors with a null or non-finite component don't; zero vectors
    only with ``zero``. Vectors of another length than most (ties: the shorter) don't. Rows that share
    an id are rows of their own: each is a candidate, and each a query if its id is one's.
    """
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(
        ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.size("vector") > 0))
    if not zero:
        good = good.filter(F.exists("vector", lambda x: x != 0))
    sizes = good.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    own = good.filter(F.size("vector") == (sizes[0]["n"] if sizes else 0))
    return own.select("vec_id", F.monotonically_increasing_id().alias("row"), "vector")


def best_rows(scores: np.ndarray, rows: np.ndarray, own: int, top: int, slack: float) -> np.ndarray:
    """Places of what can be among the ``top`` scores but for the query's own row, all those within ``slack`` of the last included."""
    able = np.where(rows == own, -np.inf, scores)
    if len(able) > top:
        limit = np.partition(able, len(able) - top)[len(able) - top]
        return np.flatnonzero((able >= limit - slack) & (able > -np.inf))
    return np.flatnonzero(able > -np.inf)


def search_blocks(sides: DataFrame, score: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple]], kind: str) -> DataFrame:
    """Meet the two sides of each block: vectors (side 0) and queries (side 1), both of bounded number.

    ``score(vector ids, their rows, vectors, rows of queries, queries)`` yields (place of the query, places
    of vectors, scores). Blocks come in order, so a task holds one at a time.
    """
    ordered = sides.repartition("block").sortWithinPartitions("block", "side")
    names = ["query_id", "query_row", "vec_id", "row", "score"]
    of = pa.int64() if kind == "long" else pa.float64()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            blocks, side = table.column("block").to_numpy(), table.column("side").to_numpy()
            ids, rows, flat = table.column("vec_id").to_numpy(), table.column("row").to_numpy(), table.column("vector").combine_chunks().flatten().to_numpy()
            points = flat.reshape(len(ids), -1)
            for start in np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])).tolist():
                end = int(np.searchsorted(blocks, blocks[start], side="right"))
                cut = start + int((side[start:end] == 0).sum())
                if start < cut < end:
                    out = list(score(ids[start:cut], rows[start:cut], points[start:cut], rows[cut:end], points[cut:end]))
                    if out:
                        query = cut + np.repeat([k for k, _, _ in out], [len(at) for _, at, _ in out])
                        place = start + np.concatenate([at for _, at, _ in out])
                        scores = pa.array(np.concatenate([s for _, _, s in out]), of)
                        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (ids[query], rows[query], ids[place], rows[place])), scores], names=names)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
            if not table.num_rows:
                continue
            blocks = table.column("block").to_numpy()
            last = int(np.searchsorted(blocks, blocks[-1], side="left"))
            if last:
                yield from found(table.slice(0, last).combine_chunks())
            rest = table.slice(last)
        if rest is not None and rest.num_rows:
            yield from found(rest.combine_chunks())

    small_batches(sides.sparkSession, 4096)
    return ordered.mapInArrow(meet, f"query_id long, query_row long, vec_id long, row long, score {kind}")


def merge_top(found: DataFrame, top: int) -> DataFrame:
    """The best ``top`` of each query row: ``query_id, rank, vec_id, score``."""
    once = found.groupBy("query_row", "row").agg(F.max("query_id").alias("query_id"), F.max("vec_id").alias("vec_id"), F.max("score").alias("score"))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
