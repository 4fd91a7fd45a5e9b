"""The whole contamination study on centroid scores: every seed, rotation, level and arm in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators import contamination as ct
from kinfold.operators import scoring as sc
from kinfold.operators.bootstrap import summarise
from kinfold.operators.ranking import _null_safe_join
from kinfold.operators.weights import training_weights
from kinfold.schema import assert_empty

CONDITION = [*ct.CELL, "level", "arm"]


def prepare(rows: DataFrame, experiment: ct.Experiment, seeds: Sequence[int], exact: bool = True,
            check: bool = True) -> dict[str, DataFrame]:
    """Cohort, roles, pairs, assignments, injections and training rows of every cell."""
    cohort, inventory = ct.build_cohort(rows, experiment)
    roles = ct.cluster_roles(inventory, experiment, seeds)
    pairs = ct.build_pairs(roles)
    assignments = ct.assign_rows(cohort, roles, pairs, experiment)
    injected = ct.injections(assignments, ct.exposed_pairs(pairs, experiment, exact))
    if check:
        assert_empty(ct.assignment_violations(assignments, pairs, experiment), "assignment rules")
        assert_empty(ct.condition_violations(injected, assignments), "condition rules")
    grid = ct.condition_grid(rows.sparkSession, experiment)
    return {
        "cohort": cohort, "inventory": inventory, "roles": roles, "pairs": pairs, "assignments": assignments,
        "injected": injected, "training": ct.training_rows(assignments, injected, grid), "grid": grid,
    }


def predict(parts: dict[str, DataFrame], features: DataFrame) -> DataFrame:
    """Fit a weighted centroid per condition and predict that cell's queries under every condition.

    ``features`` is a long table (row_id, bin, value). Zero level rows carry arm "baseline".
    """
    weighted = training_weights(parts["training"], CONDITION)
    centroids = sc.label_centroids(features, weighted, CONDITION)
    queries = parts["assignments"].filter(F.col("row_role") == "evaluation_query").select(
        *ct.CELL, "row_id", "cluster_id", "label", "pair_id"
    ).join(F.broadcast(parts["grid"]), "experiment")
    unit = sc.unit_length(features.withColumn("value", F.col("value").cast("double")), ["row_id"])
    long = queries.select(*CONDITION, "row_id").join(unit, "row_id")
    best = sc.rank_labels(sc.sparse_scores(long, centroids, CONDITION, ["label"]), CONDITION)
    return _null_safe_join(queries, best.select(*CONDITION, "row_id", "predicted", "score"), [*CONDITION, "row_id"], "left")


def aggregate(predictions: DataFrame, replicates: int, seed: int) -> dict[str, DataFrame]:
    """Cell contrasts, bootstrap replicates and intervals."""
    paired = ct.pair_predictions(predictions)
    group = ["experiment", "level", "level_token"]
    draws = ct.cluster_bootstrap(paired, replicates, seed)
    values = [c for c in draws.columns if c not in (*group, "replicate")]
    point = ct.paired_scores(paired, group, ct.ARMS)
    return {"contrasts": ct.cell_contrasts(paired), "replicates": draws, "intervals": summarise(draws, point, group, values)}
