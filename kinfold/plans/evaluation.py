"""Evaluation of all runs: metric row per run, per seed, and the two primary endpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators import bootstrap as bs
from kinfold.operators import curves as cv
from kinfold.operators import metrics as me
from kinfold.operators import rates as rt
from kinfold.session import durable
from kinfold.operators.ranking import _null_safe_join
from kinfold.operators.weights import evaluation_weights

RUN = ("design", "model", "seed", "fold")


def run_metrics(rows: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """One row per run: closed-set scores, detection, false acceptance, acceptance, AURC, fallback accuracy.

    ``rows`` are enriched prediction rows (known and unknown) of every run.
    """
    keys = list(keys)
    known = rows.filter(F.col("role") == "test_known")
    ood = rows.filter(F.col("role") == "test_ood")
    result = me.run_scores(known, keys)
    detection = cv.detection_metrics(rt.cluster_scores(rows, keys), keys).drop("n_ood", "n_known")
    overall = rt.label_macro_rates(ood, keys, ["accepted"]).withColumnRenamed("accepted", "ood_false_accept")
    by_distance = rt.label_macro_rates(ood, [*keys, "ood_distance"], ["accepted"]).groupBy(*keys).agg(
        *[F.max(F.when(F.col("ood_distance") == d, F.col("accepted"))).alias(f"{d}_false_accept") for d in ("near", "far")]
    )
    accepted = rt.cluster_rates(known, keys, ["accepted"]).withColumnRenamed("accepted", "known_acceptance")
    area = cv.area_under_risk(evaluation_weights(known, keys), keys)
    fallback = known.filter(F.col("reported_level") == "parent").groupBy(*keys).agg(
        F.avg((F.col("reported_label") == F.col("parent")).cast("double")).alias("parent_fallback_accuracy")
    )
    for part in (detection, overall, by_distance, accepted, area, fallback):
        result = _null_safe_join(result, part, keys, "left")
    return result


def seed_metrics(rows: DataFrame, keys: Sequence[str] = ("design", "model", "seed")) -> DataFrame:
    """One row per (design, model, seed): folds pooled; unknown rows averaged over folds first."""
    keys = list(keys)
    known = rows.filter(F.col("role") == "test_known")
    once = rt.average_over_folds(rows.filter(F.col("role") == "test_ood"), keys, ["confidence", "accepted"])
    pooled = known.select(*keys, "cluster_id", "confidence", F.lit("test_known").alias("role")).unionByName(
        once.select(*keys, "cluster_id", "confidence", F.lit("test_ood").alias("role"))
    )
    detection = cv.detection_metrics(rt.cluster_scores(pooled, keys), keys).drop("n_ood", "n_known")
    false_accept = rt.label_macro_rates(once, keys, ["accepted"]).withColumnRenamed("accepted", "ood_false_accept")
    by_distance = rt.label_macro_rates(once, [*keys, "ood_distance"], ["accepted"]).groupBy(*keys).agg(
        *[F.max(F.when(F.col("ood_distance") == d, F.col("accepted"))).alias(f"{d}_false_accept") for d in ("near", "far")]
    )
    result = me.seed_scores(known, keys)
    for part in (detection, false_accept, by_distance):
        result = _null_safe_join(result, part, keys, "left")
    return result


def pair_designs(known: DataFrame, keys: Sequence[str] = ("model", "seed")) -> DataFrame:
    """Row-random and cluster-grouped prediction of the same row side by side.

    A conditional aggregation on (keys, row) replaces the self-join; ``copies`` and
    ``labels`` tell whether the pairing was one-to-one and consistent.
    """
    pick = lambda d: F.max(F.when(F.col("design") == d, F.col("predicted")))
    return known.groupBy(*keys, "row_id").agg(
        F.min("label").alias("label"), F.min("cluster_id").alias("cluster_id"),
        pick("row_random").alias("predicted_random"), pick("cluster_grouped").alias("predicted_grouped"),
        F.count("*").alias("copies"), F.countDistinct("label", "cluster_id").alias("variants"),
    )


def pairing_violations(paired: DataFrame) -> DataFrame:
    return paired.filter("copies != 2 OR variants != 1 OR predicted_random IS NULL OR predicted_grouped IS NULL")


def leakage_endpoint(known: DataFrame, replicates: int, seed: int, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Mean over seeds of the macro-F1 difference, label-stratified cluster bootstrap, one-sided p against zero."""
    keys = list(keys)
    paired = pair_designs(known, [*keys, "seed"])
    arms = {"random": "predicted_random", "grouped": "predicted_grouped"}
    point = bs.paired_scores(paired, [*keys, "seed"], arms).groupBy(*keys).agg(F.avg("macro_f1_delta").alias("macro_f1_delta"))
    draws = bs.paired_f1(paired, arms, replicates, seed, keys, within=["seed"])
    return _endpoint(draws, point, keys, "macro_f1_delta", "paired_macro_f1_random_minus_grouped", 0.0)


def near_endpoint(ood: DataFrame, replicates: int, seed: int, keys: Sequence[str] = ("model",), null: float = 0.05) -> DataFrame:
    """False acceptance of near-unknown labels, hierarchical bootstrap, one-sided p against the null rate."""
    keys = list(keys)
    near = ood.filter(F.col("ood_distance") == "near")
    point = bs.hierarchical_point(near, keys, ["seed", "fold"], ["accepted"])
    draws = bs.hierarchical(near, ["accepted"], replicates, seed, keys)
    return _endpoint(draws, point, keys, "accepted", "near_ood_false_accept_rate", null)


def _endpoint(draws: DataFrame, point: DataFrame, keys: list[str], value: str, name: str, null: float) -> DataFrame:
    draws = durable(draws)  # one row a replicate, read twice
    interval = bs.percentile_interval(draws, keys, value)
    p = bs.one_sided_p(draws, keys, value, null)
    base = point.select(*keys, F.lit(name).alias("endpoint"), F.col(value).alias("estimate"), F.lit(null).alias("null_value"))
    return _null_safe_join(_null_safe_join(base, interval, keys), p, keys)
