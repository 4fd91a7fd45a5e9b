"""Classifiers with per-row weights for all cells of a grid, grouped out-of-fold scores and permutation control."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import arrays as ar
from kinfold.functions.hashing import hash_key
from kinfold.operators.boosting import Settings, fit_boosted
from kinfold.operators.features import explode_vectors
from kinfold.operators.forests import fit_forest
from kinfold.operators.margins import fit_margins
from kinfold.operators.ranking import _null_safe_join, hash_rank
from kinfold.operators.runs import matrix
from kinfold.operators.weights import training_weights
from kinfold.session import durable, spread

# fixed values: model parameters
TREES, ROUNDS, OUTER_FOLDS = 300, 200, 3
#: Bytes of the centroids that are sent to the tasks at once.
GROUP = 32_000_000
MODELS = ("tree_ensemble", "linear_svm", "boosted_trees")


class FittedClassifier:
    """A fitted model of every cell with its lexically sorted class list."""

    def __init__(self, model, keys: Sequence[str]):
        self.model, self.classes, self.keys = model, model.classes, list(keys)

    def logits(self, df: DataFrame, vector: str = "vector", out: str = "logits", unit: str = "row_id") -> DataFrame:
        """Uniform scores: decision values of linear margins, log-probabilities of trees."""
        return self.model.logits(df, vector, unit, out)

    def predict(self, df: DataFrame, vector: str = "vector", temperature: Column | float = 1.0) -> DataFrame:
        names = ar.class_array(self.classes)
        scored = self.logits(df, vector).withColumn("probability", ar.softmax(F.col("logits"), temperature))
        label, score, margin = ar.runner_up(F.col("probability"), names)
        return scored.select(
            "*", ar.argmax_label(F.col("probability"), names).alias("predicted"),
            F.array_max("probability").alias("score"), label.alias("runner_up"), score.alias("runner_up_score"),
            margin.alias("margin"), ar.top_labels(F.col("probability"), names, 3).alias("top_labels"),
        )


def fit(train: DataFrame, name: str, seed: int = 0, vector: str = "vector", keys: Sequence[str] = (), weight: str | None = None, **overrides) -> FittedClassifier:
    """Fit every cell of ``train``; rows need the keys, row_id, label, cluster_id and an array vector.

    Rows weigh what ``weight`` says, else as ``training_weights`` do. Cells draw alike: a tree tries the same
    features and shares of thresholds in every cell, so that cells differ by their rows alone.
    """
    keys = list(keys)
    rows = training_weights(train, keys) if weight is None else train.withColumn("weight", F.col(weight))
    if name == "tree_ensemble":
        model = fit_forest(rows, keys, overrides.get("numTrees", TREES), seed, vector, deepest=overrides.get("maxDepth"))
    elif name == "linear_svm":
        model = fit_margins(rows, keys, overrides.get("maxIter", 200), vector=vector)
    elif name == "boosted_trees":
        model = fit_boosted(rows, keys, Settings(rounds=overrides.get("maxIter", ROUNDS), seed=seed), vector)
    else:
        raise KeyError(f"unknown model: {name}")
    return FittedClassifier(model, keys)


def inner_folds(train: DataFrame, keys: Sequence[str], folds: int, seed: int) -> DataFrame:
    """``(keys, label, cluster_id, test_fold, k)``: whole clusters, at most as many folds as a cell's smallest label has clusters."""
    keys = list(keys)
    clusters = train.select(*keys, "label", "cluster_id").distinct()
    labels = clusters.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    counts = labels.groupBy(*keys).agg(F.least(F.lit(folds), F.min("n")).cast("int").alias("k"))
    ranked = hash_rank(clusters, [*keys, "label"], hash_key(F.lit(seed), F.col("cluster_id")), ["cluster_id"], "__r")
    dealt = _null_safe_join(ranked, counts, keys) if keys else ranked.crossJoin(F.broadcast(counts))  # one row
    return dealt.select(*keys, "label", "cluster_id", "k", ((F.col("__r") - 1) % F.col("k")).cast("int").alias("test_fold"))


def fit_with_folds(train: DataFrame, name: str, seed: int = 0, folds: int = OUTER_FOLDS, vector: str = "vector",
                   keys: Sequence[str] = (), **overrides) -> tuple[FittedClassifier, DataFrame]:
    """(model, training rows with ``logits`` of a model that hasn't seen their cluster), all cells and folds in one fit.

    A fold's model is a cell of its own (``inner``, -1 for the one of all rows). Rows keep the weight they have
    among all training rows. Cells whose folds would be fewer than two are scored by the model that has seen them.
    """
    keys = list(keys)
    weighted = training_weights(train, keys)
    placed = durable(_null_safe_join(weighted, inner_folds(train, keys, folds, seed), [*keys, "label", "cluster_id"]))
    last = F.when(F.col("k") < 2, F.lit(-1)).otherwise(F.col("k") - 1)
    copies = placed.withColumn("inner", F.explode(F.sequence(F.lit(-1), last))).filter("inner != test_fold")
    fitted = fit(copies.drop("test_fold", "k"), name, seed, vector, [*keys, "inner"], "weight", **overrides)
    held = placed.withColumn("inner", F.when(F.col("k") < 2, F.lit(-1)).otherwise(F.col("test_fold")))
    return fitted, fitted.logits(held.drop("test_fold", "k", "weight"), vector).drop("inner")


def out_of_fold_logits(train: DataFrame, name: str, seed: int = 0, folds: int = OUTER_FOLDS, vector: str = "vector",
                       keys: Sequence[str] = (), **overrides) -> tuple[DataFrame, list[str]]:
    """Grouped out-of-fold scores aligned to the full class list; in-sample when folds < 2."""
    fitted, scores = fit_with_folds(train, name, seed, folds, vector, keys, **overrides)
    return scores, fitted.classes


def permuted_labels(clusters: DataFrame, permutations: int, seed: int) -> DataFrame:
    """``(permutation, cluster_id, label)``: cluster labels shuffled, keeping label sizes.

    Cluster i in one hash order takes the label of cluster i in another; ranks are
    exact and cut for size, so the shuffle itself is distributed.
    """
    grid = clusters.withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    token = lambda side: hash_key(F.lit(side), F.lit(seed), F.col("permutation"), F.col("cluster_id"))
    slots = hash_rank(grid.select("permutation", "cluster_id"), ["permutation"], token("slot"), ["cluster_id"], "__r")
    source = hash_rank(grid, ["permutation"], token("label"), ["cluster_id"], "__r").select("permutation", "__r", "label")
    return slots.join(source, ["permutation", "__r"]).drop("__r")


def permuted_centroid_confusion(vectors: DataFrame, placed: DataFrame, permutations: int, folds: int) -> DataFrame:
    """``(permutation, true_label, predicted_label, n)``: every row scored by centroids that haven't seen its cluster.

    ``vectors``: row_id, cluster_id, vector; ``placed``: permutation, cluster_id, label, fold. Rows of a cluster weigh alike, as
    clusters of a label do, so centroids are fitted on sums of clusters. A row is read once for all permutations, and
    only counts leave a task. Centroids are sent for as many permutations at once as ``GROUP`` bytes hold.
    """
    classes = [r[0] for r in placed.select("label").distinct().orderBy("label").collect()]  # the classes of a study
    names = ar.class_array(classes)
    placed = durable(placed.select("permutation", "cluster_id", "fold", (F.array_position(names, F.col("label")) - 1).cast("int").alias("y")))
    sizes = vectors.groupBy("cluster_id").agg(F.count("*").alias("n"))
    sums = explode_vectors(vectors, "vector", ["cluster_id"]).groupBy("cluster_id", "bin").agg(F.sum("value").alias("s"), F.count("*").alias("k"))
    means = sums.join(sizes, "cluster_id").select("cluster_id", "bin", (F.col("s") / F.col("n")).alias("s"), (F.col("k") / F.col("n")).alias("k"))
    fitted = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).filter("part != fold").join(means, "cluster_id")
    long = fitted.groupBy("permutation", "part", "y", "bin").agg((F.sum("s") / F.sum("k")).alias("v"))
    centroids = durable(long.groupBy("permutation", "part", "y").agg(F.array_sort(F.collect_list(F.struct("bin", "v"))).alias("v")).select(
        "permutation", "part", "y", F.transform("v", lambda e: e["v"]).alias("v")))
    d = centroids.agg(F.max(F.size("v"))).first()[0] or 1
    step = max(1, GROUP // (8 * folds * len(classes) * d)) if classes else permutations
    rows, context, parts = durable(spread(vectors.select("cluster_id", "vector"))), vectors.sparkSession.sparkContext, []
    for low in range(0, permutations, step):
        own = (F.col("permutation") >= low) & (F.col("permutation") < low + step)
        model: dict[tuple, tuple[list, list]] = {}
        for r in centroids.filter(own).orderBy("permutation", "part", "y").collect():  # below GROUP bytes
            known, unit = model.setdefault((r["permutation"] - low, r["part"]), ([], []))
            v = np.array(r["v"])
            known.append(r["y"])
            unit.append(v / (np.linalg.norm(v) or 1.0))
        shared = context.broadcast({cell: (np.array(known), np.stack(unit)) for cell, (known, unit) in model.items()})
        at = F.array_sort(F.collect_list(F.struct("permutation", "fold", "y")))  # one entry a permutation
        packed = placed.filter(own).groupBy("cluster_id").agg(at.alias("at")).select("cluster_id", "at.fold", "at.y")

        def count(batches: Iterator[pa.RecordBatch], shared=shared, low=low, many=min(step, permutations - low)) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((many, len(classes), len(classes)), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, fold, truth = matrix(batch.column("vector")), matrix(batch.column("fold"), np.int64), matrix(batch.column("y"), np.int64)
                norms = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(norms > 0, norms, 1.0)
                for p in range(many):
                    for part in np.unique(fold[:, p]).tolist():
                        if (p, part) not in shared.value:
                            continue
                        mine = np.flatnonzero(fold[:, p] == part)
                        known, unit = shared.value[p, part]
                        # einsum keeps one summation order per pair, so equal centroids tie exactly
                        predicted = known[np.einsum("ij,kj->ik", x[mine], unit).argmax(1)]
                        counts[p] += np.bincount(truth[mine, p] * len(classes) + predicted, minlength=len(classes) ** 2).reshape(len(classes), -1)
            p, t, f = np.nonzero(counts)
            columns = [p + low, t, f, counts[p, t, f]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["permutation", "t", "p", "n"])

        found = rows.join(packed, "cluster_id").select("vector", "fold", "y").mapInArrow(count, "permutation long, t long, p long, n long")
        parts.append(found)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    label = lambda c: F.get(names, F.col(c).cast("int"))
    return found.groupBy(F.col("permutation").cast("int").alias("permutation"), label("t").alias("true_label"), label("p").alias("predicted_label")).agg(F.sum("n").alias("n"))


def permutation_envelope(scores: DataFrame, keys: Sequence[str], value: str = "macro_f1") -> DataFrame:
    """Chance envelope over permutations (their number is a parameter, so the list is bounded)."""
    return scores.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"),
        F.percentile(value, F.lit(0.025)).alias("lower"), F.percentile(value, F.lit(0.975)).alias("upper"),
        F.max(value).alias("maximum"),
    )
