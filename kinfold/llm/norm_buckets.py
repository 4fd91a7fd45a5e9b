"""Exact top-k inner products: norm buckets with length or coordinate pruning.

Components become floor(scale x). Vectors are grouped by length into geometric buckets (``RATIO``).
A first look at a bounded set of the longest vectors and of others chosen by hash gives every query a
score that its last answer reaches at least. In a bucket of greatest length L that score over
|query| L is the local cosine threshold: above 1 the bucket is left out; where it is low, only vectors
long enough are multiplied; where it is high, the query's largest coordinates bound what the
candidates' coordinates may be. What is left is multiplied exactly.

Inner products are exact: in double precision as long as they stay below 2^53, else in Python
integers; scores beyond 64 bits stand at the nearest end. Vectors all of zero take part (score 0).
Which rows else: see ``valid_vectors``. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import small_batches, stage
from kinfold.llm.vectors import BLOCK, QUERIES, best_rows, merge_top, search_blocks, valid_vectors

RATIO, SEED_LONG, SEED_ANY, HIGH, FOCUS = 1.05, 512, 1536, 0.6, 6


def products(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of integers held as doubles: float64 if all stay exact, else Python integers."""
    if len(points) and np.abs(points).max() * np.abs(query).max() * points.shape[1] >= 2.0**53:
        whole = [int(x) for x in query]
        return np.array([sum(int(x) * y for x, y in zip(p, whole, strict=True)) for p in points], object)
    return points @ query


def clipped(scores: np.ndarray) -> np.ndarray:
    return np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in scores], np.int64)


def bucket_scores(ids: np.ndarray, rows: np.ndarray, points: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, top: int) -> Iterator[tuple]:
    """The best of one bucket for each query; the last column of a query is the score it has to reach."""
    lengths = np.sqrt((points * points).sum(1))
    longest = lengths.max()
    flat = points / np.where(lengths > 0, lengths, 1)[:, None]
    for k in range(len(query_rows)):
        query, reach = queries[k, :-1], queries[k, -1]
        length = np.sqrt((query * query).sum())
        local = reach / (length * longest) if length and longest else -1.0
        if local > 1 + 1e-9:
            continue
        at = np.arange(len(ids))
        if local > 0:
            at = at[lengths * length >= reach * (1 - 1e-9)]  # length pruning
            if local >= HIGH:  # coordinate pruning
                aim, least = query / length, min(local, 1.0)
                for f in np.argsort(-np.abs(aim))[:FOCUS]:
                    room = np.sqrt(max(0.0, (1 - aim[f] ** 2) * (1 - least**2))) + 1e-9
                    at = at[(flat[at, f] >= aim[f] * least - room) & ((flat[at, f] <= aim[f] * least + room) | (aim[f] >= least))] if aim[f] >= 0 else at[(flat[at, f] <= aim[f] * least + room) & ((flat[at, f] >= aim[f] * least - room) | (-aim[f] >= least))]
        if not len(at):
            continue
        scores = products(points[at], query)
        if scores.dtype == object:
            order = sorted((x for x in range(len(at)) if rows[at[x]] != query_rows[k]), key=lambda x: (-scores[x], ids[at[x]], rows[at[x]]))[:top]
            best = np.array(order, np.int64)
        else:
            best = best_rows(scores, rows[at], query_rows[k], top, 0.0)
            best = best[np.lexsort((rows[at][best], ids[at][best], -scores[best]))][:top]
        best = best[[scores[x] >= reach for x in best]] if len(best) else best
        if len(best):
            yield k, at[best], clipped(scores[best])


def search(table: DataFrame, is_query, top: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``top`` largest inner products for each row that ``is_query(id column)`` picks: ``query_id, rank, vec_id, score``."""
    spark = table.sparkSession
    whole = valid_vectors(table, id_col, vector_col, zero=True).select("vec_id", "row", F.transform("vector", lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale)).alias("vector"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    vectors = stage(whole.withColumn("length", length).withColumn("band", F.when(F.col("length") > 0, F.ceil(F.log("length") / math.log(RATIO))).otherwise(-1).cast("int")), "vectors")
    seeds = vectors.orderBy(F.desc("length"), "row").limit(SEED_LONG).unionByName(vectors.orderBy(F.xxhash64("row"), "row").limit(SEED_ANY)).collect()  # bounded
    if not seeds:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    once = {r["row"]: r["vector"] for r in seeds}
    known = spark.sparkContext.broadcast((np.array(list(once)), np.array(list(once.values()))))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, points = known.value
        for batch in batches:
            queries = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            out = []
            for own, query in zip(batch.column("row").to_pylist(), queries, strict=True):
                scores = np.sort(products(points, query)[rows != own].astype(float))
                out.append(np.append(query, scores[-top] * (1 - 1e-12 * np.sign(scores[-top])) if len(scores) >= top else -np.inf).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("row"), pa.array(out, pa.list_(pa.float64())), batch.column("length")], names=["vec_id", "row", "vector", "length"])

    small_batches(spark, 2048)
    asked = stage(vectors.filter(is_query(F.col("vec_id"))).select("vec_id", "row", "vector", "length").mapInArrow(reach, "vec_id long, row long, vector array<double>, length double"), "queries")
    bands = [(r["band"], r["n"], r["most"]) for r in vectors.groupBy("band").agg(F.count("*").alias("n"), F.max("length").alias("most")).collect()]  # one a band: doubles have under 30,000
    asks = max(1, -(-asked.count() // QUERIES))
    cuts = spark.createDataFrame([(b, -(-n // BLOCK), most) for b, n, most in bands], "band int, many int, most double")
    each = F.sequence(F.lit(0), F.lit(asks - 1))
    own = vectors.join(F.broadcast(cuts), "band").select("band", F.pmod(F.xxhash64("row", F.lit(3)), "many").cast("int").alias("v"), F.explode(each).alias("q"), "vec_id", "row", "vector", F.lit(0).cast("byte").alias("side"))
    # a query visits the bands in which it can reach its score; a band's blocks are few beside its rows
    near = asked.withColumn("q", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(asks)).cast("int")).withColumn("band", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.lit(-(-n // BLOCK)).alias("many"), F.lit(most).alias("most")) for b, n, most in bands])))
    able = near.filter(F.col("length") * F.col("band.most") * (1 + 1e-9) >= F.element_at("vector", -1))
    visits = able.select(F.col("band.band").alias("band"), F.explode(F.sequence(F.lit(0), F.col("band.many") - 1)).alias("v"), "q", "vec_id", "row", "vector", F.lit(1).cast("byte").alias("side"))
    rows = own.select("side", "band", "v", "q", "vec_id", "row", F.concat("vector", F.array(F.lit(0.0))).alias("vector")).unionByName(visits.select("side", "band", "v", "q", "vec_id", "row", "vector"))
    block = F.col("band").cast("long") * (1 << 40) + F.col("v").cast("long") * (1 << 20) + F.col("q")
    sides = rows.select(block.alias("block"), "side", "vec_id", "row", "vector")
    return merge_top(search_blocks(sides, lambda i, r, p, k, x: bucket_scores(i, r, p[:, :-1], k, x, top), "long"), top)
