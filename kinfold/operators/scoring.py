"""Template and centroid scoring.

Long-form features are scored by a sparse product (join on bin, sum). Dense array
features are scored block against block: blocks of rows and of templates of a fixed size meet
in a task; more rows or templates mean more blocks, never larger ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.operators.features import explode_vectors
from kinfold.operators.ranking import _null_safe_join

BLOCK_CELLS = 4_000_000  # cells of one block of templates or rows: 32 MB of doubles in a task


def cluster_templates(features: DataFrame, rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Unit-length mean vector per cluster, ``(keys, cluster_id, label, bin, value)``.

    The mean divides by all rows of the cluster: a bin missing in the long table is a zero.
    """
    keys = list(keys)
    group = [*keys, "cluster_id", "label"]
    sums = features.join(rows.select(*keys, "row_id", "cluster_id", "label"), [*keys, "row_id"]).groupBy(
        *group, "bin").agg(F.sum(F.col("value").cast("double")).alias("__s"))
    sizes = rows.groupBy(*group).agg(F.count("*").alias("__n"))
    means = _null_safe_join(sums, sizes, group).select(*group, "bin", (F.col("__s") / F.col("__n")).alias("value"))
    return unit_length(means, group)


def unit_length(long: DataFrame, group: Sequence[str]) -> DataFrame:
    """Scale each vector of a long table to unit length; vectors are bounded by the grid."""
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(W.partitionBy(*group)))
    return long.withColumn("value", F.when(norm > 0, F.col("value") / norm).otherwise(0.0))


def label_centroids(features: DataFrame, rows: DataFrame, keys: Sequence[str] = (), weight: str = "weight") -> DataFrame:
    """Unit-length weighted mean per label, ``(keys, label, bin, value)``; all runs in one job."""
    keys = list(keys)
    sums = features.join(rows.select(*keys, "row_id", "label", weight), "row_id").groupBy(*keys, "label", "bin").agg(
        F.sum(F.col("value").cast("double") * F.col(weight)).alias("__s")
    )
    mass = rows.groupBy(*keys, "label").agg(F.sum(weight).alias("__w"))
    means = _null_safe_join(sums, mass, [*keys, "label"]).select(
        *keys, "label", "bin", (F.col("__s") / F.col("__w")).alias("value")
    )
    return unit_length(means, [*keys, "label"])


def sparse_scores(queries: DataFrame, templates: DataFrame, keys: Sequence[str], name: Sequence[str]) -> DataFrame:
    """Cosine of each query row with each template that shares a bin with it.

    ``queries``: keys, row_id, bin, value (unit length). ``templates``: keys, *name, bin,
    value. Each joined pair is one non-zero product of the sparse product, and products
    are summed map-side; adaptive execution splits a bin that many rows share.
    """
    keys = list(keys)
    right = templates.select(*keys, *name, "bin", F.col("value").alias("__t"))
    return queries.join(right, [*keys, "bin"]).groupBy(*keys, "row_id", *name).agg(
        F.sum(F.col("value") * F.col("__t")).alias("score")
    )


def best_per_label(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Label score = its best template; equal templates resolve to the first cluster id."""
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("cluster_id").alias("c")))
    return scores.groupBy(*keys, "row_id", "label").agg(best.alias("__b")).select(
        *keys, "row_id", "label", (-F.col("__b.s")).alias("score"), F.col("__b.c").alias("cluster_id")
    )


def rank_labels(label_scores: DataFrame, keys: Sequence[str], k: int = 3) -> DataFrame:
    """Winner, runner-up, margin and top-k per row; equal scores resolve to the first label.

    A row has at most one entry per label, so the sorted list is bounded by the class list.
    """
    has_cluster = "cluster_id" in label_scores.columns
    entry = F.struct(
        (-F.col("score")).alias("s"), F.col("label").alias("l"),
        (F.col("cluster_id") if has_cluster else F.lit(None)).alias("c"),
    )
    packed = label_scores.groupBy(*keys, "row_id").agg(F.array_sort(F.collect_list(entry)).alias("o"))
    first, second = F.get("o", F.lit(0)), F.get("o", F.lit(1))
    return packed.select(
        *keys, "row_id", first["l"].alias("predicted"), (-first["s"]).alias("score"),
        *([first["c"].alias("winning_cluster")] if has_cluster else []),
        F.coalesce(second["l"], F.lit("")).alias("runner_up"), (-second["s"]).alias("runner_up_score"),
        (second["s"] - first["s"]).alias("margin"),
        F.transform(F.slice("o", 1, k), lambda e: e["l"]).alias("top_labels"),
    )


def mean_templates(vectors: DataFrame, group: Sequence[str], vector: str = "vector") -> DataFrame:
    """Unit-length mean array per group from array features."""
    long = explode_vectors(vectors, vector, list(group))
    means = long.groupBy(*group, "bin").agg(F.avg("value").alias("value"))
    packed = means.groupBy(*group).agg(
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("__norm"),
        F.array_sort(F.collect_list(F.struct("bin", "value"))).alias("__v"),
    )
    scale = F.when(F.col("__norm") > 0, F.col("__norm")).otherwise(1.0)
    return packed.select(*group, F.transform("__v", lambda e: e["value"] / scale).alias("template"))


def weighted_centroids(rows: DataFrame, keys: Sequence[str] = (), vector: str = "vector", weight: str = "weight") -> DataFrame:
    """Unit-length weighted mean array per (run, label)."""
    group = [*keys, "label"]
    long = explode_vectors(rows, vector, [*group, weight])
    means = long.groupBy(*group, "bin").agg((F.sum(F.col("value") * F.col(weight)) / F.sum(weight)).alias("value"))
    packed = means.groupBy(*group).agg(
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("__norm"),
        F.array_sort(F.collect_list(F.struct("bin", "value"))).alias("__v"),
    )
    scale = F.when(F.col("__norm") > 0, F.col("__norm")).otherwise(1.0)
    return packed.select(*group, F.transform("__v", lambda e: e["value"] / scale).alias("template"))


def _block_scores(block: pd.DataFrame, keys: list[str], vector: str):
    """A batch function: cosine with every template of the block, kept per (row, label)."""
    groups = {}
    for key, part in block.groupby(keys, sort=False) if keys else [((), block)]:
        part = part.sort_values(["label", "cluster_id"], kind="stable")
        labels = part["label"].to_numpy()
        starts = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
        groups[key] = (np.stack(part["template"].to_numpy()), starts, labels[starts], part["cluster_id"].to_numpy())

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby(keys, sort=False) if keys else [((), batch)]:
                if key not in groups or part.empty:
                    continue
                templates, starts, labels, clusters = groups[key]
                x = np.stack(part[vector].to_numpy()).astype(np.float64)
                norms = np.linalg.norm(x, axis=1, keepdims=True)
                # einsum keeps one summation order per pair, so equal templates tie exactly
                cosine = np.einsum("ij,kj->ik", x / np.where(norms > 0, norms, 1.0), templates)
                ends = np.r_[starts[1:], templates.shape[0]]
                best = np.empty((len(x), len(starts)), dtype=np.int64)
                for column, (start, end) in enumerate(zip(starts, ends)):
                    best[:, column] = start + cosine[:, start:end].argmax(axis=1)
                out = pd.DataFrame({
                    "row_id": np.repeat(part["row_id"].to_numpy(), len(labels)),
                    "label": np.tile(labels, len(x)),
                    "score": np.take_along_axis(cosine, best, axis=1).ravel(),
                    "cluster_id": clusters[best.ravel()],
                })
                for name, value in zip(keys, key if isinstance(key, tuple) else (key,)):
                    out[name] = value
                yield out

    return score


def dense_label_scores(queries: DataFrame, templates: DataFrame, keys: Sequence[str] = (), vector: str = "vector",
                       block_cells: int = BLOCK_CELLS) -> DataFrame:
    """Label scores (best template, its cluster) of array features: ``(keys, row_id, label, score, cluster_id)``.

    ``templates``: keys, label, cluster_id, template. Both sides are counted and cut into parts of about
    ``block_cells`` cells by a hash; each part of the rows meets each block of templates in one task, which
    keeps one entry per (row, label), and the entries are reduced by minimum. The driver holds no template,
    and the result does not depend on the block size.
    """
    keys = list(keys)
    shape = templates.agg(F.count("*").alias("n"), F.max(F.size("template")).alias("d")).first()
    if not shape["n"]:
        raise ValueError("there are no templates to score against")
    blocks = max(1, -(-shape["n"] * shape["d"] // block_cells))
    chunks = max(1, -(-queries.count() * shape["d"] // block_cells))
    meet = ("__block", "__chunk")
    known = templates.select(
        *keys, "label", "cluster_id", "template", F.pmod(F.xxhash64(*keys, "cluster_id", "label"), F.lit(blocks)).alias("__block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("__chunk"))
    asked = queries.select(
        *keys, "row_id", vector, F.pmod(F.xxhash64(*keys, "row_id"), F.lit(chunks)).alias("__chunk"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("__block"))
    fields = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    kinds = {f.name: f.dataType.simpleString() for f in templates.schema.fields}
    schema = ", ".join(
        [f"row_id {fields['row_id']}", f"label {kinds['label']}", "score double", f"cluster_id {kinds['cluster_id']}"]
        + [f"{k} {fields[k]}" for k in keys]
    )
    names = [part.split(" ", 1)[0] for part in schema.split(", ")]

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        step = max(1, block_cells // len(right))
        parts = _block_scores(right, keys, vector)(left.iloc[at : at + step] for at in range(0, len(left), step))
        found = list(parts)
        return pd.concat(found)[names] if found else pd.DataFrame(columns=names)

    scores = asked.groupBy(*meet).cogroup(known.groupBy(*meet)).applyInPandas(score, schema)
    return best_per_label(scores, keys)


def centroid_scores(queries: DataFrame, centroids: DataFrame, keys: Sequence[str] = (), vector: str = "vector",
                    block_cells: int = BLOCK_CELLS) -> DataFrame:
    """Cosine of array features with each label's centroid."""
    named = centroids.withColumn("cluster_id", F.col("label"))
    return dense_label_scores(queries, named, keys, vector, block_cells).drop("cluster_id")


def score_arrays(label_scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores of a row as an array in class order (class list: sorted labels)."""
    return label_scores.groupBy(*keys, "row_id").agg(
        F.array_sort(F.collect_list(F.struct("label", "score"))).alias("__s")
    ).select(*keys, "row_id", F.transform("__s", lambda e: e["score"]).alias("scores"))
