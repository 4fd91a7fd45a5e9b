"""Open-set correction over every run: conformal reports, corrected decisions, summaries, bootstraps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators import bootstrap as bs
from kinfold.operators import calibration as cal
from kinfold.operators import decisions as de
from kinfold.operators import rates as rt
from kinfold.operators.ranking import _null_safe_join
from kinfold.session import durable

RUN = ("design", "model", "seed", "fold")


def conformal_reports(rows: DataFrame, keys: Sequence[str], class_parent: dict[str, str], coverage: float = 0.95,
                      min_rows: int = cal.MIN_CLASS_ROWS) -> tuple[DataFrame, list[str], list[str]]:
    """Calibrate every run on its calibration rows and report every row.

    ``rows``: keys, role, row_id, cluster_id, label, parent, probability (class order).
    Returns (reported rows, classes, parents).
    """
    keys, classes = list(keys), sorted(class_parent)
    both, parents = cal.parent_probability(rows, classes, class_parent)
    fitted = durable(both.filter(F.col("role") == "calibration"))  # five branches read these rows
    labels = cal.class_thresholds(cal.nonconformity(fitted, classes), keys, classes, coverage=coverage, min_rows=min_rows)
    tops = cal.class_thresholds(
        cal.nonconformity(fitted, parents, "parent_probability", "parent"), keys, parents, label="parent",
        coverage=coverage, min_rows=min_rows,
    )
    tau = cal.acceptance_threshold(
        fitted.withColumn("confidence", F.array_max("probability").cast("double")), keys, "confidence", coverage
    ).drop("n")
    limits = _null_safe_join(cal.pack_thresholds(labels, keys), cal.pack_thresholds(tops, keys, "parent_thresholds"), keys)
    # one row a run, written once: its measured size lets the planner send it to the rows
    ready = _null_safe_join(both, durable(_null_safe_join(limits, tau, keys)), keys)
    return de.hierarchical_report(ready, classes, parents), classes, parents


def per_run_summary(decisions: DataFrame, keys: Sequence[str], explicit=None) -> DataFrame:
    """Counts and accuracies plus every outcome at three averaging levels, per run and population."""
    counts = de.decision_summary(decisions, keys, explicit)
    rates = rt.rates_by_selector(decisions, keys, [*de.OUTCOMES, "set_contains_true"], explicit)
    return _null_safe_join(counts, rates, [*keys, "selector"])


# fixed values: populations, and the averaging of each bootstrap block
OOD_BLOCKS = (
    "all_ood", "same_parent_ood", "different_parent_ood", "singleton_ood", "same_parent_ood_explicit_binomial",
    "different_parent_ood_explicit_binomial", "same_parent_ood_sp_only", "different_parent_ood_sp_only",
)
KNOWN_BLOCKS = ("known", "known_explicit_binomial", "known_sp_only")


def bootstrap_tables(decisions: DataFrame, replicates: int, seed: int, outcomes: Sequence[str] = de.OUTCOMES,
                     keys: Sequence[str] = ("model",), explicit=None) -> tuple[DataFrame, DataFrame]:
    """(interval table, replicate table) for all models and populations at once.

    Unknown populations and a companion known block are label-macro; known populations
    give every cluster one vote. Model and population are key columns, so this is two
    bootstrap jobs, however many blocks there are.
    """
    outcomes, instance = list(outcomes), ["seed", "fold"]
    gap = "legacy_minus_corrected"
    values = [*outcomes, gap]
    # one record per cluster and model instance; averaging it again changes nothing
    reduced = durable(decisions.withColumn(
        gap, F.col("legacy_accept").cast("double") - F.col("corrected_accept").cast("double")
    ).groupBy(*keys, *rt.TRAITS, *instance).agg(
        F.count("*").alias("__rows"), *[F.avg(F.col(v).cast("double")).alias(v) for v in values]
    ))
    selected = rt.by_selector(reduced, explicit)
    group = [*keys, "selector"]
    macro = selected.filter(F.col("selector").isin(*OOD_BLOCKS)).unionByName(
        selected.filter(F.col("selector") == "known").withColumn("selector", F.lit("known_label_macro"))
    )
    pooled = selected.filter(F.col("selector").isin(*KNOWN_BLOCKS))
    tables, draws = [], []
    for part, overall, estimand in ((macro, False, "label-macro"), (pooled, True, "overall-cluster")):
        point = bs.hierarchical_point(part, group, instance, values, overall)
        drawn = durable(bs.hierarchical(part, values, replicates, seed, group, overall=overall, by_block=True))
        counts = part.groupBy(*group).agg(
            F.sum("__rows").alias("n_predictions"),
            F.countDistinct("cluster_id").alias("n_clusters"), F.countDistinct("label").alias("n_labels"),
            F.countDistinct("seed", "fold").alias("n_instances"),
        )
        table = _null_safe_join(bs.summarise(drawn, point, group, values), counts, group)
        tables.append(table.withColumn("estimand", F.lit(estimand)))
        draws.append(drawn.withColumn("estimand", F.lit(estimand)))
    return tables[0].unionByName(tables[1]), draws[0].unionByName(draws[1])


def correct_all_runs(rows: DataFrame, class_parent: dict[str, str], replicates: int, seed: int,
                     keys: Sequence[str] = RUN) -> dict[str, DataFrame]:
    """Every table of the correction study, by name."""
    reports, classes, parents = conformal_reports(rows, keys, class_parent)
    decisions = de.decision_frame(reports, classes, parents)
    means, support = de.cluster_mean_decisions(rows, keys, classes, class_parent)
    grouped = decisions.filter(F.col("design") == "cluster_grouped")
    intervals, draws = bootstrap_tables(grouped, replicates, seed)
    fitted = cal.parent_probability(rows.filter(F.col("role") == "calibration"), classes, class_parent)[0]
    return {
        "decisions": decisions, "precision": de.precision_audit(decisions, keys), "per_run": per_run_summary(decisions, keys),
        "calibration_support": cal.calibration_support(fitted, keys, classes, parents),
        "cluster_mean_decisions": means, "cluster_mean_support": support,
        "cluster_mean_metrics": de.cluster_mean_metrics(rt.by_selector(means), [*keys, "selector"]),
        "intervals": intervals, "replicates": draws,
    }
