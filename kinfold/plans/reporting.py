"""Consolidated run outputs and the report tables built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.formats import flatten_structs
from kinfold.operators import audits as au
from kinfold.operators import bootstrap as bs
from kinfold.operators import rates as rt
from kinfold.operators import reports as rp
from kinfold.plans import evaluation as ev
from kinfold.schema import assert_empty

CELL = ("analysis", "design", "model", "holdout", "seed", "fold")
SUMMARY = ("analysis", "design", "model", "holdout")


def consolidate(predictions: Sequence[DataFrame], metrics: Sequence[DataFrame], expected: DataFrame,
                values: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all predictions, flat metrics, mean and SD per analysis) once every expected cell is present."""
    def union(frames: Sequence[DataFrame]) -> DataFrame:
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame, allowMissingColumns=True)
        return out

    flat = union([flatten_structs(m) for m in metrics])
    assert_empty(au.set_difference(expected, flat, [k for k in CELL if k in expected.columns]), "cells missing or unexpected")
    return union(predictions), flat, rt.mean_sd(flat, list(SUMMARY), values)


def evaluate_all(rows: DataFrame, primary: str, replicates: int, seeds: tuple[int, int] = (20260907, 20260919)) -> dict[str, DataFrame]:
    """Run metrics, seed metrics, both endpoints with Holm adjustment, and the report tables, by name.

    ``rows`` are enriched prediction rows of all runs, as a stored table: several passes read it.
    """
    main = rows.filter(F.col("model") == primary)
    known = main.filter(F.col("role") == "test_known")
    ood = main.filter((F.col("role") == "test_ood") & (F.col("design") == "cluster_grouped"))
    assert_empty(ev.pairing_violations(ev.pair_designs(known)), "the designs do not pair one to one")
    endpoints = ev.leakage_endpoint(known, replicates, seeds[0]).unionByName(ev.near_endpoint(ood, replicates, seeds[1]))
    per_seed = ev.seed_metrics(rows)
    values = [c for c in per_seed.columns if c not in ("design", "model", "seed")]
    summary = rp.model_summary(per_seed, values)
    return {
        "runs": ev.run_metrics(rows), "seeds": per_seed, "endpoints": rp.endpoint_table(bs.holm(endpoints)),
        "summary": summary, "split_performance": rp.split_performance(summary),
        "open_set_performance": rp.open_set_performance(
            summary, [f"{v}_mean" for v in ("known_acceptance", "auroc", "auprc", "near_false_accept", "far_false_accept")]),
        "selective_acceptance": rp.selective_acceptance(rows), "confusions": rp.frequent_confusions(known),
        "confidence": rp.confidence_distribution(rows),
    }
