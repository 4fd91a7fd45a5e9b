"""Source hold-out evaluation: template scoring, acceptance threshold, populations, endpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators import calibration as cal
from kinfold.operators import decisions as de
from kinfold.operators import metrics as me
from kinfold.operators import models as md
from kinfold.operators import scoring as sc
from kinfold.operators.ranking import _null_safe_join
from kinfold.session import durable


def population() -> Column:
    """Which part of the hold-out evaluation a row belongs to."""
    test = F.col("role") == "test_source"
    return (
        F.when(test & (F.col("source") == F.col("holdout")), "target-label-primary")
        .when(test, "other-label-quarantine-auxiliary").otherwise("calibration")
    )


def reference_predictions(rows: DataFrame, keys: Sequence[str], vector: str = "vector", target: float = 0.95) -> DataFrame:
    """Fit templates on train rows of each run, score the other roles, accept by calibration threshold.

    ``rows``: keys, role, row_id, cluster_id, label, vector (and any column to keep).
    """
    keys = list(keys)
    train = rows.filter(F.col("role") == "train")
    templates = sc.mean_templates(train, [*keys, "cluster_id", "label"], vector)
    queries = rows.filter(F.col("role") != "train")
    scores = durable(sc.dense_label_scores(queries, templates, keys, vector))
    ranked = sc.rank_labels(scores, keys)
    scored = _null_safe_join(queries.drop(vector), ranked, [*keys, "row_id"])
    # the threshold is one of these scores, and scoring is the costly step: write it once
    scored = durable(_null_safe_join(scored, sc.score_arrays(scores, keys), [*keys, "row_id"]))
    threshold = cal.retained_fraction_threshold(scored.filter(F.col("role") == "calibration"), keys, "score", target)
    return de.accept_by_score(scored, threshold, keys, train)


def tree_predictions(rows: DataFrame, keys: Sequence[str], seed: int = 0, target: float = 0.95, **overrides) -> DataFrame:
    """Trees fitted on the train rows of every run at once; scores, threshold and acceptance as for the reference library."""
    keys = list(keys)
    train = rows.filter(F.col("role") == "train")
    fitted = md.fit(train, "tree_ensemble", seed, keys=keys, **overrides)
    scored = durable(fitted.predict(rows.filter(F.col("role") != "train")).drop("vector", "logits").withColumn("scores", F.col("probability")))
    threshold = cal.retained_fraction_threshold(scored.filter(F.col("role") == "calibration"), keys, "score", target)
    return de.accept_by_score(scored, threshold, keys, train)


def endpoints(predictions: DataFrame, keys: Sequence[str], classes: list[str]) -> DataFrame:
    """Endpoint row per run and population (or role, when there is no hold-out)."""
    split = "population" if "holdout" in predictions.columns else "role"
    named = predictions.withColumn("population", population()) if split == "population" else predictions
    return me.endpoint_suite(named, [*keys, split], classes)
