"""Report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import metrics as me
from kinfold.operators import reports as rp
from kinfold.queries.base import manifest, predictions, query, rounded
from kinfold.queries.metrics import RUNK, f1_sql, known


@query("composition", """+ p AS (SELECT *, 'all' AS population FROM manifest UNION ALL SELECT *, 'known' FROM manifest WHERE primary_known UNION ALL SELECT *, 'ood' FROM manifest WHERE primary_ood
UNION ALL SELECT *, ood_distance || '_ood' FROM manifest WHERE primary_ood UNION ALL SELECT *, 'singleton_ood' FROM manifest WHERE ood_singleton)
SELECT population, count(*) AS n_rows, count(DISTINCT cluster_id) AS n_clusters, count(DISTINCT label) AS n_labels FROM p GROUP BY population""", ("manifest",))
def composition(spark, sf):
    return rp.composition(manifest(spark, sf))


@query("study_flow", """SELECT count(*) AS n_rows, count(DISTINCT label) FILTER (primary_known) AS known_labels, count(DISTINCT cluster_id) FILTER (primary_known) AS known_clusters,
count(DISTINCT label) FILTER (primary_ood) AS ood_labels, count(DISTINCT cluster_id) FILTER (primary_ood) AS ood_clusters FROM manifest""", ("manifest",))
def study_flow(spark, sf):
    return rp.study_flow(manifest(spark, sf))


@query("model_summary", "+ " + f1_sql("f", "kp", "design, model, seed") + """
SELECT design, model, count(*) AS n_runs, round(avg(macro_f1), 6) AS macro_f1_mean, round(stddev_samp(macro_f1), 6) AS macro_f1_sd, round(avg(balanced_accuracy), 6) AS balanced_accuracy_mean, round(stddev_samp(balanced_accuracy), 6) AS balanced_accuracy_sd FROM f GROUP BY ALL""", ("known_p",))
def model_summary(spark, sf):
    out = rp.model_summary(me.classification_scores(known(spark, sf), RUNK), ["macro_f1", "balanced_accuracy"])
    return rounded(out, *[c for c in out.columns if c.endswith(("mean", "sd"))])


@query("split_performance", "+ " + f1_sql("f", "kp", "design, model, seed") + """,
m AS (SELECT design, model, avg(macro_f1) AS v FROM f GROUP BY ALL), w AS (SELECT model, max(v) FILTER (design = 'row_random') AS a, max(v) FILTER (design = 'cluster_grouped') AS b FROM m GROUP BY model)
SELECT model, round(a, 4) AS row_random, round(b, 4) AS cluster_grouped, round(a - b, 4) AS difference FROM w""", ("known_p",))
def split_performance(spark, sf):
    return rp.split_performance(rp.model_summary(me.classification_scores(known(spark, sf), RUNK), ["macro_f1"]))


@query("open_set_performance", "+ " + f1_sql("f", "kp", "design, model, seed") + """
SELECT model, round(avg(macro_f1), 4) AS macro_f1_mean, round(avg(accuracy), 4) AS accuracy_mean FROM f WHERE design = 'cluster_grouped' GROUP BY model""", ("known_p",))
def open_set_performance(spark, sf):
    summary = rp.model_summary(me.classification_scores(known(spark, sf), RUNK), ["macro_f1", "accuracy"])
    return rp.open_set_performance(summary, ["macro_f1_mean", "accuracy_mean"])


@query("selective_acceptance", """SELECT model, CASE role WHEN 'test_known' THEN 'known' ELSE ood_distance || ' ood' END AS evaluation_group, round(avg(accepted::INT), 6) AS acceptance_rate FROM predictions WHERE role <> 'calibration' GROUP BY ALL""", ("preds",))
def selective_acceptance(spark, sf):
    return rounded(rp.selective_acceptance(predictions(spark, sf)), "acceptance_rate")


@query("frequent_confusions", """SELECT label AS true_label, predicted AS predicted_label, count(*) AS n FROM kp WHERE label <> predicted GROUP BY ALL ORDER BY n DESC, true_label, predicted_label LIMIT 20""", ("known_p",))
def frequent_confusions(spark, sf):
    return rp.frequent_confusions(known(spark, sf))


@query("confidence_distribution", "SELECT model, CASE role WHEN 'test_known' THEN 'known' ELSE ood_distance || ' ood' END AS evaluation_group, count(*) AS n, "
       + ", ".join(f"round(quantile_cont(confidence, {q}), 6) AS {n}" for n, q in rp.LETTER_LEVELS.items()) + " FROM predictions WHERE role <> 'calibration' GROUP BY ALL", ("preds",))
def confidence_distribution(spark, sf):
    return rounded(rp.confidence_distribution(predictions(spark, sf)), *rp.LETTER_LEVELS)


@query("endpoint_support", """+ e AS (SELECT design, model, seed AS s, avg(accepted::INT) AS estimate, avg(confidence) / 10 AS p FROM kp GROUP BY ALL)
SELECT design || model || s AS endpoint, round(estimate, 6) AS estimate, round(p, 6) AS holm_adjusted_p, 0.05e0 AS null_value, p < 0.05e0 AND estimate > 0.05e0 AS supported FROM e""", ("known_p",))
def endpoint_support(spark, sf):
    base = known(spark, sf).groupBy(F.concat("design", "model", F.col("seed").cast("string")).alias("endpoint")).agg(
        F.avg(F.col("accepted").cast("double")).alias("estimate"), (F.avg("confidence") / 10).alias("holm_adjusted_p"))
    return rounded(rp.endpoint_table(base.withColumn("null_value", F.lit(0.05))), "estimate", "holm_adjusted_p")
