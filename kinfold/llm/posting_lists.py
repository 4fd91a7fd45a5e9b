"""Approximate nearest neighbours by cosine: balanced posting lists.

Centroids are fitted by balanced k-means on at most ``SAMPLE`` vectors (smallest hashes of the rows):
a centroid that draws over twice its share splits with the weakest. Every vector goes to its nearest
centroid and, near a boundary, to up to ``COPIES`` centroids within ``REPLICATE`` of that distance.
A list longer than a block is cut into blocks by a hash of the row, so a crowded list is searched by
many tasks. Centroids are linked to their nearest others in a graph that every task holds in memory
(bounded by the sample); a best-first walk from some entry points finds candidates, and a query takes
the lists within ``PRUNE`` times its nearest distance, and further ones until they hold ``LEAST``
vectors in expectation. Scores are exact cosines of the original vectors in double precision.

Which rows take part: see ``valid_vectors``. Fewer candidates than asked for give all of those found;
an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import small_batches, stage
from kinfold.llm.vectors import BLOCK, QUERIES, best_rows, merge_top, search_blocks, valid_vectors

SAMPLE, LISTS, SHARE, COPIES, REPLICATE = 16_384, 512, 256, 4, 1.08
PRUNE, LEAST, DEGREE, ROUNDS = 1.22, 64, 24, 8


def unit(points: np.ndarray) -> np.ndarray:
    scale = np.abs(points).max(1, keepdims=True)
    points = points / np.where(scale > 0, scale, 1)
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (points * points).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * points @ centres.T))


def fit_centres(points: np.ndarray, lists: int) -> np.ndarray:
    """Balanced k-means: crowded centroids are split in place of the emptiest ones."""
    random = np.random.default_rng(5)
    centres = points[random.choice(len(points), lists, replace=False)].copy()
    for step in range(ROUNDS):
        own = distances(points, centres).argmin(1)
        sizes = np.bincount(own, minlength=lists)
        for k in range(lists):
            if sizes[k]:
                centres[k] = points[own == k].mean(0)
        if step < ROUNDS - 1:
            crowded, weak = np.argsort(-sizes), np.argsort(sizes)
            for big, small in zip(crowded.tolist(), weak.tolist(), strict=True):
                if sizes[big] <= 2 * len(points) / lists or sizes[small] >= 0.5 * len(points) / lists:
                    break
                centres[small] = points[random.choice(np.flatnonzero(own == big))]
    return centres


class Graph:
    """Centroids, each linked to its nearest others; a best-first walk finds those near a query."""

    def __init__(self, centres: np.ndarray, sizes: np.ndarray | None = None):
        self.centres, self.sizes = centres, sizes
        near = distances(centres, centres).argsort(1, kind="stable")[:, 1 : DEGREE + 1]
        links = [set(row.tolist()) for row in near]
        for k, row in enumerate(near.tolist()):  # both ways, so that every centroid can be reached
            for other in row:
                links[other].add(k)
        self.links = [np.array(sorted(x), np.int64) for x in links]
        self.entries = np.unique(np.linspace(0, len(centres) - 1, 16).astype(int))

    def near(self, point: np.ndarray, prune: float, least: float) -> list[int]:
        """Centroids within ``prune`` times the nearest distance, nearest first; more until they hold ``least`` vectors."""
        def far(at: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(0.0, ((self.centres[at] - point) ** 2).sum(1)))

        seen = np.zeros(len(self.centres), bool)
        seen[self.entries] = True
        heap = list(zip(far(self.entries).tolist(), self.entries.tolist(), strict=True))
        heapq.heapify(heap)
        done: list[tuple[float, int]] = []
        best, held = float("inf"), 0.0
        while heap:
            dist, k = heapq.heappop(heap)
            best = min(best, dist)
            if len(done) >= DEGREE and dist > prune * best and held >= least:
                break
            done.append((dist, k))
            held += self.sizes[k] if self.sizes is not None else 1
            fresh = self.links[k][~seen[self.links[k]]]
            if len(fresh):
                seen[fresh] = True
                for item in zip(far(fresh).tolist(), fresh.tolist(), strict=True):
                    heapq.heappush(heap, item)
        done.sort()
        out, held = [], 0.0
        for dist, k in done:
            if dist > prune * best + 1e-12 and held >= least:
                break
            out.append(k)
            held += self.sizes[k] if self.sizes is not None else 1
        return out


def assign(vectors: DataFrame, graph: Graph, queries: bool) -> DataFrame:
    """``list, vec_id, row, vector``: the lists that hold a vector, or that a query searches; ``place`` counts from 0."""
    shared = vectors.sparkSession.sparkContext.broadcast(graph)  # LISTS centroids at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            points = unit(batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1))
            if queries:
                found = [g.near(p, PRUNE, LEAST) for p in points]
            else:
                dist = distances(points, g.centres)
                order = np.argsort(dist, axis=1, kind="stable")[:, :COPIES]
                ranked = np.take_along_axis(dist, order, 1)
                close = ranked <= REPLICATE * ranked[:, :1]
                found = [o[c].tolist() for o, c in zip(order, close, strict=True)]
            rows = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
            at = pa.array(rows)
            lists = pa.array(np.concatenate([np.array(f, np.int32) for f in found]))
            places = pa.array(np.concatenate([np.arange(len(f), dtype=np.int32) for f in found]))
            yield pa.RecordBatch.from_arrays([lists, places, *(batch.column(c).take(at) for c in ("vec_id", "row", "vector"))], names=["list", "place", "vec_id", "row", "vector"])

    small_batches(vectors.sparkSession, 2048)
    return vectors.mapInArrow(place, "list int, place int, vec_id long, row long, vector array<double>")


def cosines(ids: np.ndarray, rows: np.ndarray, points: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, top: int) -> Iterator[tuple]:
    near = unit(queries) @ unit(points).T
    norms = np.sqrt((points * points).sum(1))
    for k in range(len(query_rows)):
        at = best_rows(near[k], rows, query_rows[k], top, 1e-9)
        exact = (points[at] * queries[k]).sum(1) / (norms[at] * np.sqrt((queries[k] * queries[k]).sum()))
        order = np.lexsort((rows[at], ids[at], -exact))[:top]
        yield k, at[order], exact[order]


def search(table: DataFrame, is_query, top: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``top`` nearest found for each row that ``is_query(id column)`` picks: ``query_id, rank, vec_id, score``."""
    spark = table.sparkSession
    vectors = stage(valid_vectors(table, id_col, vector_col), "vectors")
    count = vectors.count()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = vectors.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).collect()  # SAMPLE rows at most
    points = unit(np.array([r["vector"] for r in sample]))
    lists = int(min(LISTS, max(1, count // SHARE), max(1, len(points) // 8)))
    graph = Graph(fit_centres(points, lists))
    postings = stage(assign(vectors, graph, False), "postings")
    sizes = {r["list"]: (r["n"], r["own"]) for r in postings.groupBy("list").agg(F.count("*").alias("n"), F.sum((F.col("place") == 0).cast("int")).alias("own")).collect()}  # a row a list
    graph.sizes = np.array([sizes.get(k, (0, 0))[1] for k in range(lists)], float)
    probes = stage(assign(vectors.filter(is_query(F.col("vec_id"))), graph, True), "probes")
    asked = {r["list"]: r["n"] for r in probes.groupBy("list").agg(F.count("*").alias("n")).collect()}
    cuts = spark.createDataFrame([(k, -(-sizes[k][0] // BLOCK), -(-asked[k] // QUERIES)) for k in sizes if k in asked] or [(-1, 1, 1)], "list int, many int, asks int")
    # vectors of block v and queries of block q of a list meet in block (list, v, q)
    salt = F.pmod(F.xxhash64("row", F.lit(3)), F.when(F.col("side") == 0, F.col("many")).otherwise(F.col("asks"))).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("asks")).otherwise(F.col("many")) - 1)).alias("other")
    both = postings.select(F.lit(0).cast("byte").alias("side"), "list", "vec_id", "row", "vector").unionByName(probes.select(F.lit(1).cast("byte").alias("side"), "list", "vec_id", "row", "vector"))
    rows = both.join(F.broadcast(cuts), "list").select("side", "list", "vec_id", "row", "vector", "many", "asks", salt.alias("salt"), each)
    v, q = F.when(F.col("side") == 0, F.col("salt")).otherwise(F.col("other")), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("salt"))
    block = (F.col("list").cast("long") * (1 << 40)) + v.cast("long") * (1 << 20) + q
    sides = rows.select(block.alias("block"), "side", "vec_id", "row", "vector")
    return merge_top(search_blocks(sides, lambda i, r, p, k, x: cosines(i, r, p, k, x, top), "double"), top)
