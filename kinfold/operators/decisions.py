"""Prediction sets, report levels, and the corrected decision rule with its audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import arrays as ar
from kinfold.operators import calibration as cal
from kinfold.operators import rates as rt
from kinfold.operators.metrics import mean_vectors
from kinfold.operators.ranking import _null_safe_join
from kinfold.session import durable

# fixed values: report levels
LABEL_LEVEL, PARENT_LEVEL, NO_LEVEL = "label", "parent", "unidentified"

OUTCOMES = (
    "confidence_only_accept", "singleton", "corrected_singleton", "legacy_accept", "corrected_accept",
    "legacy_parent_report", "corrected_parent_report", "legacy_unidentified", "corrected_unidentified",
    "legacy_any_correct", "corrected_any_correct",
)


def _report(accepted: Column, label: Column, parent_ok: Column, parent: Column) -> tuple[Column, Column]:
    level = F.when(accepted, LABEL_LEVEL).when(parent_ok, PARENT_LEVEL).otherwise(NO_LEVEL)
    text = F.when(accepted, label).when(parent_ok, parent).otherwise(NO_LEVEL)
    return level, text


def hierarchical_report(df: DataFrame, classes: list[str], parents: list[str]) -> DataFrame:
    """Label if its set is a singleton and confident, else a singleton parent, else nothing.

    Needs arrays ``probability``, ``parent_probability``, ``thresholds``,
    ``parent_thresholds`` and a ``tau``.
    """
    names, tops = ar.class_array(classes), ar.class_array(parents)
    base = df.select(
        "*",
        ar.argmax_label(F.col("probability"), names).alias("predicted"),
        F.array_max("probability").cast("double").alias("confidence"),
        ar.prediction_set(F.col("probability"), names, F.col("thresholds")).alias("label_set"),
        ar.prediction_set(F.col("parent_probability"), tops, F.col("parent_thresholds")).alias("parent_set"),
    )
    accepted = (F.size("label_set") == 1) & (F.col("confidence") >= F.col("tau"))
    level, text = _report(
        accepted, F.get("label_set", F.lit(0)), F.size("parent_set") == 1, F.get("parent_set", F.lit(0))
    )
    return base.select(
        "*", F.size("label_set").alias("label_set_size"), F.size("parent_set").alias("parent_set_size"),
        accepted.alias("accepted"), level.alias("reported_level"), text.alias("reported_label"),
        F.col("label").isin(classes).alias("true_is_known"),
    )


def closed_report(df: DataFrame, classes: list[str], class_parent: dict[str, str]) -> DataFrame:
    """Closed-set prediction: always the best label, never an abstention."""
    names = ar.class_array(classes)
    tops = ar.class_array([class_parent[c] for c in classes])
    at = ar.argmax_index(F.col("probability"))
    return df.select(
        "*", F.get(names, at).alias("predicted"), F.get(tops, at).alias("predicted_parent"),
        F.array_max("probability").cast("double").alias("confidence"),
    ).select(
        "*", F.array("predicted").alias("label_set"), F.lit(1).alias("label_set_size"),
        F.array("predicted_parent").alias("parent_set"), F.lit(1).alias("parent_set_size"),
        F.lit(True).alias("accepted"), F.col("predicted").alias("reported_label"),
        F.lit(LABEL_LEVEL).alias("reported_level"), F.lit(True).alias("true_is_known"),
    )


def decision_frame(df: DataFrame, classes: list[str], parents: list[str]) -> DataFrame:
    """Stored (legacy) rule and corrected rule side by side.

    The correction asks a singleton to be the argmax as well, at both levels. A
    confidence equal to tau passes.
    """
    names, tops = ar.class_array(classes), ar.class_array(parents)
    step = df.select(
        "*",
        ar.argmax_label(F.col("probability"), names).alias("array_argmax"),
        F.array_max("probability").cast("double").alias("array_confidence"),
        ar.argmax_label(F.col("parent_probability"), tops).alias("parent_argmax"),
        ar.only_member(F.col("label_set")).alias("label_singleton"),
        ar.only_member(F.col("parent_set")).alias("parent_singleton"),
        (F.col("confidence") >= F.col("tau")).alias("confidence_only_accept"),
    )
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    step = step.withColumn("singleton", F.col("label_singleton").isNotNull()).withColumn(
        "corrected_singleton", same("label_singleton", "predicted")
    )
    step = step.withColumn("legacy_accept", F.col("singleton") & F.col("confidence_only_accept")).withColumn(
        "corrected_accept", F.col("corrected_singleton") & F.col("confidence_only_accept")
    )
    step = step.withColumn("legacy_parent_report", F.col("reported_level") == PARENT_LEVEL).withColumn(
        "corrected_parent_report", ~F.col("corrected_accept") & same("parent_singleton", "parent_argmax")
    )
    level, text = _report(
        F.col("corrected_accept"), F.col("label_singleton"), F.col("corrected_parent_report"), F.col("parent_singleton")
    )
    step = step.withColumn("corrected_level", level).withColumn("corrected_label", text)
    hit = lambda lvl, txt: F.when(F.col(lvl) == LABEL_LEVEL, F.col(txt) == F.col("label")).when(
        F.col(lvl) == PARENT_LEVEL, F.col(txt) == F.col("parent")).otherwise(F.lit(False))
    legacy_hit, corrected_hit = hit("reported_level", "reported_label"), hit("corrected_level", "corrected_label")
    return step.select(
        "*",
        (F.col("reported_level") == NO_LEVEL).alias("legacy_unidentified"),
        (F.col("corrected_level") == NO_LEVEL).alias("corrected_unidentified"),
        F.array_contains("label_set", F.col("label")).alias("set_contains_true"),
        F.array_contains("parent_set", F.col("parent")).alias("parent_set_contains_true"),
        legacy_hit.alias("legacy_any_correct"), corrected_hit.alias("corrected_any_correct"),
        (F.col("legacy_accept") & (F.col("reported_label") == F.col("label"))).alias("legacy_label_correct"),
        (F.col("corrected_accept") & (F.col("corrected_label") == F.col("label"))).alias("corrected_label_correct"),
        (F.col("legacy_parent_report") & (F.col("reported_label") == F.col("parent"))).alias("legacy_parent_correct"),
        (F.col("corrected_parent_report") & (F.col("corrected_label") == F.col("parent"))).alias("corrected_parent_correct"),
    )


def precision_audit(decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How far stored values differ from what the stored arrays imply, per run."""
    amount = lambda rule: F.sum(F.coalesce(rule, F.lit(False)).cast("long"))
    different = ~F.coalesce(F.col("parent_singleton") == F.col("parent_argmax"), F.lit(False))
    return decisions.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        amount(F.col("predicted") != F.col("array_argmax")).alias("argmax_mismatches"),
        F.max(F.abs(F.col("confidence") - F.col("array_confidence"))).alias("max_confidence_gap"),
        amount((F.col("confidence") >= F.col("tau")) != (F.col("array_confidence") >= F.col("tau"))).alias("threshold_flips"),
        F.min(F.abs(F.col("confidence") - F.col("tau"))).alias("min_margin"),
        F.max(F.abs(ar.total(F.col("probability")) - 1.0)).alias("max_sum_error"),
        amount(F.col("legacy_accept")).alias("legacy_accepts"),
        amount(F.col("legacy_accept") & ~F.col("corrected_singleton")).alias("accepted_not_argmax"),
        amount(F.col("legacy_parent_report") & different).alias("parent_not_argmax"),
    )


def reproduction_violations(decisions: DataFrame) -> DataFrame:
    """Stored decisions and set sizes that cannot be rebuilt from the stored inputs."""
    rules = F.array(
        F.when(F.col("accepted") != F.col("legacy_accept"), F.lit("acceptance")),
        F.when(F.col("label_set_size") != F.size("label_set"), F.lit("label set size")),
        F.when(F.col("parent_set_size") != F.size("parent_set"), F.lit("parent set size")),
    )
    return decisions.withColumn("rule", F.explode(F.filter(rules, lambda r: r.isNotNull())))


def decision_summary(decisions: DataFrame, keys: Sequence[str], explicit: Column | None = None) -> DataFrame:
    """Counts, report accuracies and mean set size per run and population.

    Reduced to rows and clusters first, then copied to populations, then summed by label and by
    run; a cluster belongs to one label, so every distinct count is a plain sum.
    """
    flags = [f"{rule}_{name}" for rule in ("legacy", "corrected")
             for name in ("accept", "label_correct", "parent_report", "parent_correct", "any_correct")]
    group = [*keys, *rt.TRAITS]
    # one pass: rows that repeat an id are added up, then each id of a cluster counts once
    rows = decisions.groupBy(*group, "row_id").agg(
        F.count("*").alias("n_rows"), F.sum("label_set_size").alias("set_size"),
        *[F.sum(F.col(f).cast("long")).alias(f) for f in flags],
    )
    per = rows.groupBy(*group).agg(F.count("*").alias("n_unique_rows"), *[F.sum(c).alias(c) for c in ("n_rows", "set_size", *flags)])
    keys = [*keys, "selector"]
    totals = ["n_rows", "n_unique_rows", "set_size", *flags]
    labels = rt.by_selector(per, explicit).groupBy(*keys, "label").agg(
        F.count("*").alias("n_clusters"), *[F.sum(c).alias(c) for c in totals]
    )
    runs = labels.groupBy(*keys).agg(
        F.count("*").alias("n_labels"), F.sum("n_clusters").alias("n_clusters"), *[F.sum(c).alias(c) for c in totals]
    )
    columns = [F.col(c) for c in (*keys, "n_rows", "n_unique_rows", "n_clusters", "n_labels")]
    columns.append((F.col("set_size") / F.col("n_rows")).alias("mean_set_size"))
    for rule in ("legacy", "corrected"):
        of = lambda name: F.col(f"{rule}_{name}")
        both = of("accept") + of("parent_report")
        columns += [
            of("accept").alias(f"{rule}_label_n"), of("label_correct").alias(f"{rule}_label_correct_n"),
            F.try_divide(of("label_correct"), of("accept")).alias(f"{rule}_label_accuracy"),
            (F.lit(1.0) - F.try_divide(of("label_correct"), of("accept"))).alias(f"{rule}_label_error"),
            of("parent_report").alias(f"{rule}_parent_n"),
            F.try_divide(of("parent_correct"), of("parent_report")).alias(f"{rule}_parent_accuracy"),
            both.alias(f"{rule}_identified_n"), F.try_divide(of("any_correct"), both).alias(f"{rule}_identified_accuracy"),
        ]
    return runs.select(*columns)


def cluster_mean_decisions(df: DataFrame, keys: Sequence[str], classes: list[str], class_parent: dict[str, str],
                           coverage: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Pooled conformal rule on one mean vector per (role, cluster), with its own tau.

    Returns (cluster decisions, one support row per run).
    """
    keys = list(keys)
    extras = [c for c in ("ood_distance", "ood_singleton") if c in df.columns]
    identity = [*keys, "role", "cluster_id", "label", "parent", *extras]
    # thresholds are order statistics of these very means: written once, so that the value a
    # threshold was taken from compares equal to it in every branch
    means = durable(mean_vectors(df, identity, "probability", len(classes)))
    means, parents = cal.parent_probability(means, classes, class_parent)
    names, tops = ar.class_array(classes), ar.class_array(parents)
    means = means.withColumn("confidence", F.array_max("probability"))
    fitted = means.filter(F.col("role") == "calibration")
    label_q = cal.finite_sample_quantile(cal.nonconformity(fitted, classes), keys, "score", coverage, "label_threshold")
    parent_q = cal.finite_sample_quantile(
        cal.nonconformity(fitted, parents, "parent_probability", "parent"), keys, "score", coverage, "parent_threshold"
    ).drop("n")
    tau = cal.lower_quantile(fitted, keys, "confidence", 1.0 - coverage, "tau").drop("n")
    support = _null_safe_join(_null_safe_join(label_q.withColumnRenamed("n", "n_calibration_clusters"), parent_q, keys), tau, keys)
    ready = _null_safe_join(means, support, keys)
    constant = lambda column, n: F.array_repeat(F.col(column), n)
    ready = ready.select(
        "*",
        ar.argmax_label(F.col("probability"), names).alias("predicted"),
        ar.argmax_label(F.col("parent_probability"), tops).alias("predicted_parent"),
        ar.prediction_set(F.col("probability"), names, constant("label_threshold", len(classes))).alias("label_set"),
        ar.prediction_set(F.col("parent_probability"), tops, constant("parent_threshold", len(parents))).alias("parent_set"),
    )
    agree = lambda members, best: F.coalesce(ar.only_member(F.col(members)) == F.col(best), F.lit(False))
    ready = ready.withColumn("confidence_only_accept", F.col("confidence") >= F.col("tau")).withColumn(
        "set_only_singleton", agree("label_set", "predicted")
    )
    ready = ready.withColumn("accept", F.col("set_only_singleton") & F.col("confidence_only_accept")).withColumn(
        "parent_report", ~(F.col("set_only_singleton") & F.col("confidence_only_accept")) & agree("parent_set", "predicted_parent")
    )
    level, text = _report(F.col("accept"), F.col("predicted"), F.col("parent_report"), F.col("predicted_parent"))
    decisions = ready.select(
        "*", level.alias("reported_level"), text.alias("reported_label"),
        F.array_contains("label_set", F.col("label")).alias("set_contains_true"),
        (F.col("accept") & (F.col("predicted") == F.col("label"))).alias("label_correct"),
        (F.col("parent_report") & (F.col("predicted_parent") == F.col("parent"))).alias("parent_correct"),
    )
    return decisions, support


def cluster_mean_metrics(decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rates per run and population; every cluster counts once because it is one row."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return decisions.groupBy(*keys).agg(
        F.count("*").alias("n_clusters"), F.countDistinct("label").alias("n_labels"),
        rate("confidence_only_accept").alias("confidence_only_accept"),
        rate("set_only_singleton").alias("set_only_singleton"), rate("accept").alias("accept"),
        rate("parent_report").alias("parent_report"),
        F.avg((F.col("reported_level") == NO_LEVEL).cast("double")).alias("unidentified"),
        F.avg(F.when(F.col("role").isin("calibration", "test_known"), F.col("set_contains_true").cast("double"))).alias("set_coverage"),
        F.sum(F.col("accept").cast("long")).alias("label_report_n"),
        F.avg(F.when(F.col("accept"), F.col("label_correct").cast("double"))).alias("label_report_accuracy"),
        F.sum(F.col("parent_report").cast("long")).alias("parent_report_n"),
        F.avg(F.when(F.col("parent_report"), F.col("parent_correct").cast("double"))).alias("parent_accuracy"),
    )


def accept_by_score(df: DataFrame, thresholds: DataFrame, keys: Sequence[str], fitted: DataFrame) -> DataFrame:
    """Forced-choice rows with ``accepted`` (score >= threshold), ``true_is_fitted`` and ``correct``."""
    keys = list(keys)
    seen = fitted.select(*keys, "label").distinct().withColumn("true_is_fitted", F.lit(True))
    joined = _null_safe_join(df, thresholds.select(*keys, "threshold"), keys, "left")
    joined = _null_safe_join(joined, seen, [*keys, "label"], "left")
    return joined.select(
        *[c for c in joined.columns if c != "true_is_fitted"],
        F.coalesce("true_is_fitted", F.lit(False)).alias("true_is_fitted"),
        (F.col("score") >= F.col("threshold")).alias("accepted"),
        (F.col("predicted") == F.col("label")).alias("correct"),
    )
