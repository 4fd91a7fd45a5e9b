"""Dose response: models fitted anew with growing shares of the test clusters' other rows among the training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators import contamination as ct
from kinfold.operators import models as md
from kinfold.operators import scoring as sc
from kinfold.operators.metrics import classification_scores
from kinfold.operators.ranking import _null_safe_join
from kinfold.operators.weights import training_weights
from kinfold.session import durable

CELL = ("seed", "fold")


def dose_response(splits: DataFrame, vectors: DataFrame, doses: Sequence[float], name: str = "tree_ensemble", seed: int = 0, **overrides) -> tuple[DataFrame, DataFrame]:
    """(predictions, metric rows) per seed, fold and dose; all cells are fitted and scored in one go.

    Each test cluster of two rows or more keeps its first row in hash order for evaluation; of the
    others a dose injects its share into the training rows. Weights follow the rows that are trained on.
    """
    keys = [*CELL, "dose"]
    levels = F.explode(F.array(*[F.lit(float(d)) for d in doses])).alias("dose")
    evaluation, injected = ct.dose_plan(splits.filter(F.col("role") == "test_known"), doses, CELL)
    evaluation, injected = durable(evaluation.select(*CELL, "row_id", "cluster_id", "label")), durable(injected.select(*keys, "row_id", "cluster_id", "label"))
    base = splits.filter(F.col("role") == "train").select(*CELL, levels, "row_id", "cluster_id", "label")
    own = vectors.select("row_id", "vector")
    train = durable(base.unionByName(injected).join(own, "row_id"))
    asked = evaluation.select(*CELL, levels, "row_id", "cluster_id", "label").join(own, "row_id")
    if name == "cosine_centroid":
        centroids = durable(sc.weighted_centroids(training_weights(train, keys), keys))
        best = sc.rank_labels(sc.centroid_scores(asked, centroids, keys), keys).select(*keys, "row_id", "predicted")
        scored = _null_safe_join(asked.drop("vector"), best, [*keys, "row_id"])
    else:
        scored = md.fit(train, name, seed, keys=keys, **overrides).predict(asked)
    predictions = durable(scored.select(*keys, "row_id", "cluster_id", "label", "predicted", (F.col("predicted") == F.col("label")).alias("correct")))
    metrics = classification_scores(predictions, keys).select(*keys, "macro_f1", "accuracy")
    counts = predictions.groupBy(*keys).agg(F.count("*").alias("n_evaluation"))
    many = injected.groupBy(*keys).agg(F.count("*").alias("n_injected"))
    table = counts.join(many, keys, "left").join(metrics, keys)
    return predictions, table.select(*keys, F.coalesce("n_injected", F.lit(0)).alias("n_injected"), "n_evaluation", "macro_f1", "accuracy")
