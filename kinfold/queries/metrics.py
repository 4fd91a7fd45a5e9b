"""Rates, classification metrics, curves and leakage estimands."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions import arrays as ar
from kinfold.operators import audits as au
from kinfold.operators import curves as cv
from kinfold.operators import decisions as de
from kinfold.operators import metrics as me
from kinfold.operators import rates as rt
from kinfold.operators.weights import evaluation_weights
from kinfold.plans import evaluation as ev
from kinfold.session import durable
from kinfold.queries.base import define, known_classes, predictions, query, rounded, scored

RUNK = ["design", "model", "seed"]
CELLK = ["design", "model", "seed", "fold"]


def f1_sql(name: str, source: str, keys: str, truth="label", pred="predicted", weight="1") -> str:
    """SQL blocks ``<name>_g``: per-label totals, and ``<name>``: F1 family."""
    k = keys + ", " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    return f"""{name}_c AS (SELECT {k}{truth} AS t, {pred} AS p, sum({weight}) AS n FROM {source} GROUP BY ALL),
{name}_g AS (SELECT {k}lab, sum(tt) AS tt, sum(pp) AS pp, sum(h) AS h FROM (SELECT {k}t AS lab, n AS tt, 0 AS pp, CASE WHEN t = p THEN n ELSE 0 END AS h FROM {name}_c
  UNION ALL SELECT {k}p, 0, n, 0 FROM {name}_c) GROUP BY ALL),
{name} AS (SELECT {k}avg(CASE WHEN tt + pp > 0 THEN 2e0 * h / (tt + pp) ELSE 0e0 END) AS macro_f1,
  avg(2e0 * h / (tt + pp)) FILTER (tt > 0) AS macro_f1_true_labels, avg(h * 1e0 / nullif(tt, 0)) FILTER (tt > 0) AS balanced_accuracy, sum(h) * 1e0 / sum(tt) AS accuracy
  FROM {name}_g {by})"""


define("known_p", "kp AS (SELECT * FROM predictions WHERE role = 'test_known')", ("preds",))
define("known_w", """kw AS (SELECT *, 1e0 / count(*) OVER (PARTITION BY design, model, seed, cluster_id) AS cw FROM kp),
kww AS (SELECT *, cw / sum(cw) OVER (PARTITION BY design, model, seed) AS weight FROM kw)""", ("known_p",))
define("ood_p", "op AS (SELECT * FROM predictions WHERE role = 'test_ood')", ("preds",))


def known(spark, sf):
    return predictions(spark, sf).filter("role = 'test_known'")


def unknown(spark, sf):
    return predictions(spark, sf).filter("role = 'test_ood'")


@query("confusion_counts", "SELECT design, model, seed, label AS true_label, predicted AS predicted_label, count(*) AS n FROM kp GROUP BY ALL", ("known_p",))
def confusion_counts(spark, sf):
    return me.confusion(known(spark, sf), RUNK)


ROUND4 = ("macro_f1", "macro_f1_true_labels", "balanced_accuracy", "accuracy")
F1COLS = ", ".join(f"round({c}, 6) AS {c}" for c in ROUND4)


@query("classification_scores", "+ " + f1_sql("f", "kp", "design, model, seed") + f"\nSELECT design, model, seed, {F1COLS} FROM f", ("known_p",))
def classification_scores(spark, sf):
    return rounded(me.classification_scores(known(spark, sf), RUNK), *ROUND4)


@query("label_totals", "+ " + f1_sql("f", "kp", "design, model, seed") + "\nSELECT design, model, seed, lab AS label, tt::BIGINT AS t_n, pp::BIGINT AS p_n, h::BIGINT AS h_n FROM f_g", ("known_p",))
def label_totals(spark, sf):
    return me.label_totals(me.confusion(known(spark, sf), RUNK), RUNK)


@query("equal_cluster_f1", "+ " + f1_sql("f", "kww", "design, model, seed", weight="weight") + f"\nSELECT design, model, seed, {F1COLS} FROM f", ("known_w",))
def equal_cluster_f1(spark, sf):
    return rounded(me.classification_scores(evaluation_weights(known(spark, sf), RUNK), RUNK, weight=F.col("weight")), *ROUND4)


@query("confusion_f1_fixed_labels", "+ " + f1_sql("f", "kp", "design, model, seed") + """
SELECT design, model, seed, round(sum(CASE WHEN tt + pp > 0 THEN 2e0 * h / (tt + pp) ELSE 0 END) / 25, 6) AS macro_f1, round(sum(h) * 1e0 / sum(tt), 6) AS accuracy FROM f_g GROUP BY ALL""", ("known_p",))
def confusion_f1_fixed_labels(spark, sf):
    return rounded(me.confusion_scores(me.confusion(known(spark, sf), RUNK), RUNK, 25), "macro_f1", "accuracy")


# ------------------------------------------------------------------ rates

@query("cluster_balanced_rate", """+ c AS (SELECT design, model, seed, fold, cluster_id, avg(accepted::INT) AS a, avg(correct::INT) AS b FROM kp GROUP BY ALL)
SELECT design, model, seed, fold, round(avg(a), 6) AS accepted, round(avg(b), 6) AS correct FROM c GROUP BY ALL""", ("known_p",))
def cluster_balanced_rate(spark, sf):
    return rounded(rt.cluster_rates(known(spark, sf), CELLK, ["accepted", "correct"]), "accepted", "correct")


@query("label_macro_rate", """+ c AS (SELECT design, model, seed, fold, label, cluster_id, avg(accepted::INT) AS a FROM op GROUP BY ALL),
l AS (SELECT design, model, seed, fold, label, avg(a) AS a FROM c GROUP BY ALL) SELECT design, model, seed, fold, round(avg(a), 6) AS accepted FROM l GROUP BY ALL""", ("ood_p",))
def label_macro_rate(spark, sf):
    return rounded(rt.label_macro_rates(unknown(spark, sf), CELLK, ["accepted"]), "accepted")


@query("rates_at_levels", """+ c AS (SELECT design, model, ood_distance, label, cluster_id, avg(accepted::INT) AS a, avg(confidence) AS b, sum(accepted::INT) AS sa, sum(confidence) AS sb, count(*) AS n FROM op GROUP BY ALL),
l AS (SELECT design, model, ood_distance, label, avg(a) AS la, avg(b) AS lb, sum(a) AS ca, sum(b) AS cb, count(*) AS cn, sum(sa) AS sa, sum(sb) AS sb, sum(n) AS n FROM c GROUP BY ALL)
SELECT design, model, ood_distance, round(sum(sa) / sum(n), 6) AS accepted__row, round(sum(ca) / sum(cn), 6) AS accepted__cluster, round(avg(la), 6) AS accepted__label_macro,
round(sum(sb) / sum(n), 6) AS confidence__row, round(sum(cb) / sum(cn), 6) AS confidence__cluster, round(avg(lb), 6) AS confidence__label_macro FROM l GROUP BY ALL""", ("ood_p",))
def rates_at_levels(spark, sf):
    out = rt.rates_at_levels(unknown(spark, sf), ["design", "model", "ood_distance"], ["accepted", "confidence"])
    return rounded(out, *[c for c in out.columns if "__" in c])


@query("instance_mean", """+ c AS (SELECT design, model, seed, fold, label, cluster_id, avg(accepted::INT) AS a FROM op WHERE ood_distance = 'near' GROUP BY ALL),
l AS (SELECT design, model, seed, fold, label, avg(a) AS a FROM c GROUP BY ALL), i AS (SELECT design, model, seed, fold, avg(a) AS a FROM l GROUP BY ALL)
SELECT design, model, round(avg(a), 6) AS accepted, count(*) AS n_instances FROM i GROUP BY ALL""", ("ood_p",))
def instance_mean(spark, sf):
    near = unknown(spark, sf).filter("ood_distance = 'near'")
    return rounded(rt.instance_mean(near, ["design", "model"], ["seed", "fold"], ["accepted"]), "accepted")


@query("average_over_folds", """SELECT design, model, seed, row_id, cluster_id, label, parent, ood_distance, round(avg(confidence), 6) AS confidence, round(avg(accepted::INT), 6) AS accepted
FROM op GROUP BY ALL""", ("ood_p",))
def average_over_folds(spark, sf):
    out = rt.average_over_folds(unknown(spark, sf), RUNK, ["confidence", "accepted"])
    return rounded(out, "confidence", "accepted")


@query("cluster_scores", """SELECT design, model, seed, cluster_id, role = 'test_ood' AS is_ood, round(avg(confidence), 6) AS confidence FROM predictions WHERE role <> 'calibration' GROUP BY ALL""", ("preds",))
def cluster_scores(spark, sf):
    return rounded(rt.cluster_scores(predictions(spark, sf), RUNK), "confidence")


@query("conditional_accuracy", """+ c AS (SELECT design, model, seed, cluster_id, sum(accepted::INT) AS a, sum((accepted AND correct)::INT) AS c, avg(accepted::INT) AS am, avg((accepted AND correct)::INT) AS cm FROM kp GROUP BY ALL)
SELECT design, model, seed, round(sum(c) / sum(a), 6) AS accuracy__row, round(sum(cm) / sum(am), 6) AS accuracy__cluster FROM c GROUP BY ALL""", ("known_p",))
def conditional_accuracy(spark, sf):
    return rounded(rt.conditional_accuracy(known(spark, sf), RUNK, "accepted", "correct"), "accuracy__row", "accuracy__cluster")


@query("numeric_summary", """+ c AS (SELECT design, model, seed, fold, cluster_id, avg(accepted::INT) AS a, avg(confidence) AS b FROM kp GROUP BY ALL),
r AS (SELECT design, model, seed, fold, avg(a) AS accepted, avg(b) AS confidence FROM c GROUP BY ALL), u AS (UNPIVOT r ON accepted, confidence INTO NAME metric VALUE v)
SELECT design, model, metric, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS minimum, round(max(v), 6) AS maximum FROM u GROUP BY ALL""", ("known_p",))
def numeric_summary(spark, sf):
    per = rt.cluster_rates(known(spark, sf), CELLK, ["accepted", "confidence"])
    return rounded(rt.numeric_summary(per, ["design", "model"], ["accepted", "confidence"]), "mean", "sd", "minimum", "maximum")


@query("mean_sd_over_runs", """+ c AS (SELECT design, model, seed, fold, ood_distance, avg(accepted::INT) AS accepted FROM predictions WHERE role <> 'calibration' GROUP BY ALL)
SELECT design, model, ood_distance, count(*) AS n_runs, round(avg(accepted), 6) AS accepted_mean, round(stddev_samp(accepted), 6) AS accepted_sd FROM c GROUP BY ALL""", ("preds",))
def mean_sd_over_runs(spark, sf):
    per = predictions(spark, sf).filter("role != 'calibration'").groupBy(*CELLK, "ood_distance").agg(F.avg(F.col("accepted").cast("double")).alias("accepted"))
    return rounded(rt.mean_sd(per, ["design", "model", "ood_distance"], ["accepted"]), "accepted_mean", "accepted_sd")


@query("out_of_fold_violations", """+ x AS (SELECT design, model, seed, row_id, label FROM kp UNION ALL SELECT design, model, seed, row_id, CASE WHEN row_id % 2 = 0 THEN 'other' ELSE label END FROM kp WHERE confidence > 0.95e0)
SELECT design, model, seed, row_id, CASE WHEN count(DISTINCT label) > 1 THEN 'inconsistent label' ELSE 'duplicate prediction' END AS problem FROM x GROUP BY design, model, seed, row_id HAVING count(*) > 1""", ("known_p",))
def out_of_fold_violations(spark, sf):
    base = known(spark, sf)
    again = base.filter("confidence > 0.95").withColumn("label", F.when(F.col("row_id") % 2 == 0, "other").otherwise(F.col("label")))
    return au.out_of_fold_violations(base.unionByName(again), RUNK)


# ------------------------------------------------------------------ probability rows

define("prow", """prow0 AS (SELECT design, seed, fold, role, row_id, cluster_id, label, parent, list(class ORDER BY p DESC, j) AS o, list(p ORDER BY p DESC, j) AS ps,
  max(p) FILTER (class = label) AS tp, sum((p - CASE WHEN class = label THEN 1 ELSE 0 END) * (p - CASE WHEN class = label THEN 1 ELSE 0 END)) AS brier FROM scored GROUP BY ALL),
prow AS (SELECT *, o[1] AS predicted, ps[1] AS confidence, o[1] = label AS correct, list_contains(o[1:3], label) AS top3 FROM prow0)""", ("scored",))


def prob_rows(spark, sf, role="test_known"):
    classes = list(known_classes(spark, sf))
    rows = durable(scored(spark, sf, known_classes(spark, sf)).filter(F.col("role") == role))
    return classes, rows.withColumn("predicted", ar.argmax_label(F.col("probability"), ar.class_array(classes))).withColumn(
        "confidence", F.array_max("probability"))


@query("row_outcomes", """SELECT design, seed, fold, row_id, predicted, round(confidence, 6) AS confidence, correct, round(tp, 6) AS true_probability, round(brier + 1e-12, 8) AS brier_row, top3 AS top3_correct
FROM prow WHERE role = 'test_known'""", ("prow",))
def row_outcomes(spark, sf):
    classes, rows = prob_rows(spark, sf)
    out = me.enrich_rows(rows, classes).select("design", "seed", "fold", "row_id", "predicted", "confidence", "correct", "true_probability", "brier_row", "top3_correct")
    out = out.withColumn("brier_row", F.round(F.col("brier_row") + 1e-12, 8))  # off the decimal ties of short fractions
    return rounded(out, "confidence", "true_probability")


@query("top_labels", """SELECT design, seed, fold, row_id, array_to_string(o[1:3], ',') AS top_labels, o[2] AS runner_up, round(ps[2], 6) AS runner_up_score, round(ps[1] - ps[2], 6) AS margin FROM prow WHERE role = 'calibration'""", ("prow",))
def top_labels(spark, sf):
    classes, rows = prob_rows(spark, sf, "calibration")
    names, p = ar.class_array(classes), F.col("probability")
    label, score, margin = ar.runner_up(p, names)
    return rows.select("design", "seed", "fold", "row_id", F.array_join(ar.top_labels(p, names, 3), ",").alias("top_labels"),
                       label.alias("runner_up"), F.round(score, 6).alias("runner_up_score"), F.round(margin, 6).alias("margin"))


@query("softmax_logits", """+ z AS (SELECT design, seed, fold, row_id, class, ln(greatest(p, 1e-12)) AS z FROM scored WHERE role = 'calibration'),
e AS (SELECT *, exp((z - max(z) OVER w) / 2e0) AS e FROM z WINDOW w AS (PARTITION BY design, seed, fold, row_id))
SELECT design, seed, fold, row_id, class, round(z, 6) AS logit, round(e / sum(e) OVER (PARTITION BY design, seed, fold, row_id), 6) AS p FROM e""", ("scored",))
def softmax_logits(spark, sf):
    classes, rows = prob_rows(spark, sf, "calibration")
    z = rows.withColumn("z", ar.probability_to_logits(F.col("probability"))).withColumn("s", ar.softmax(F.col("z"), 2.0))
    pairs = F.arrays_zip(ar.class_array(classes).alias("c"), F.col("z").alias("z"), F.col("s").alias("s"))
    long = z.select("design", "seed", "fold", "row_id", F.explode(pairs).alias("x"))
    return long.select("design", "seed", "fold", "row_id", F.col("x.c").alias("class"), F.round("x.z", 6).alias("logit"), F.round("x.s", 6).alias("p"))


@query("align_scores", """+ k AS (SELECT max(k) AS k FROM classes) SELECT design, seed, fold, row_id, CASE WHEN j = 0 THEN -50e0 ELSE round(p, 6) END AS score, class FROM scored WHERE role = 'test_known'""", ("scored",))
def align_scores(spark, sf):
    classes, rows = prob_rows(spark, sf)
    local = F.reverse(F.slice(ar.class_array(classes), 2, len(classes)))
    values = F.reverse(F.slice("probability", 2, len(classes)))
    aligned = ar.align_scores(values, local, ar.class_array(classes))
    long = rows.select("design", "seed", "fold", "row_id", F.explode(F.arrays_zip(ar.class_array(classes).alias("class"), aligned.alias("score"))).alias("x"))
    return long.select("design", "seed", "fold", "row_id", F.col("x.class").alias("class"), F.round("x.score", 6).alias("score"))


define("prw", """pk AS (SELECT * FROM prow WHERE role = 'test_known'),
pw0 AS (SELECT *, 1e0 / count(*) OVER (PARTITION BY design, seed, cluster_id) AS cw FROM pk),
pw AS (SELECT *, cw / sum(cw) OVER (PARTITION BY design, seed) AS w FROM pw0),
rk AS (SELECT *, row_number() OVER (PARTITION BY design, seed ORDER BY confidence, sha256(row_id::VARCHAR), row_id) - 1 AS i, count(*) OVER (PARTITION BY design, seed) AS n FROM pw),
bn AS (SELECT *, ntile(15) OVER (PARTITION BY design, seed ORDER BY i) AS b FROM rk),
be AS (SELECT design, seed, b, sum(w) AS w, sum(w * correct::INT) AS c, sum(w * confidence) AS s FROM bn GROUP BY ALL),
ece AS (SELECT design, seed, sum(abs(c - s)) / sum(w) AS ece FROM be GROUP BY ALL)""", ("prow",))
define("pf1", f1_sql("pf", "pk", "design, seed"), ("prw",))


@query("calibration_error", "SELECT design, seed, round(ece, 6) AS ece FROM ece", ("prw",))
def calibration_error(spark, sf):
    classes, rows = prob_rows(spark, sf)
    weighted = evaluation_weights(me.enrich_rows(rows, classes), ["design", "seed"])
    return rounded(me.calibration_error(weighted, ["design", "seed"]), "ece")


@query("run_scores", """+ a AS (SELECT design, seed, count(*) AS n_rows, avg(top3::INT) AS top3_accuracy, sum(w * -ln(least(greatest(tp, 1e-12), 1e0))) / sum(w) AS log_loss, sum(w * brier) / sum(w) AS brier FROM pw GROUP BY ALL)
SELECT design, seed, n_rows, round(macro_f1, 6) AS macro_f1, round(balanced_accuracy, 6) AS balanced_accuracy, round(top3_accuracy, 6) AS top3_accuracy, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, round(ece, 6) AS ece
FROM a JOIN pf USING (design, seed) JOIN ece USING (design, seed)""", ("pf1",))
def run_scores(spark, sf):
    classes, rows = prob_rows(spark, sf)
    out = me.run_scores(me.enrich_rows(rows, classes), ["design", "seed"])
    return rounded(out, "macro_f1", "balanced_accuracy", "top3_accuracy", "log_loss", "brier", "ece")


@query("seed_scores", """+ a AS (SELECT design, seed, count(*) AS n_rows, count(DISTINCT cluster_id) AS n_clusters, count(DISTINCT label) AS n_labels, sum(w * top3::INT) / sum(w) AS top3_accuracy,
sum(w * -ln(least(greatest(tp, 1e-12), 1e0))) / sum(w) AS log_loss, sum(w * brier) / sum(w) AS brier, sum(w * (confidence >= 0.5e0)::INT) / sum(w) AS known_acceptance FROM pw GROUP BY ALL)
SELECT design, seed, n_rows, n_clusters, n_labels, round(macro_f1, 6) AS macro_f1, round(balanced_accuracy, 6) AS balanced_accuracy, round(top3_accuracy, 6) AS top3_accuracy, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier,
round(known_acceptance, 6) AS known_acceptance FROM a JOIN pf USING (design, seed)""", ("pf1",))
def seed_scores(spark, sf):
    classes, rows = prob_rows(spark, sf)
    out = me.seed_scores(me.enrich_rows(rows, classes).withColumn("accepted", F.col("confidence") >= 0.5), ["design", "seed"])
    return rounded(out, "macro_f1", "balanced_accuracy", "top3_accuracy", "log_loss", "brier", "known_acceptance")


define("det", """dsc AS (SELECT design, model, seed, cluster_id, (role = 'test_ood')::INT AS pos, round(sum(CAST(confidence AS DECIMAL(38, 15)))::DOUBLE / count(confidence), 12) AS s FROM predictions WHERE role <> 'calibration' GROUP BY ALL),
dg AS (SELECT design, model, seed, s, sum(pos) AS p, sum(1 - pos) AS n FROM dsc GROUP BY ALL),
dc AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY design, model, seed) AS pp, sum(n) OVER (PARTITION BY design, model, seed) AS nn FROM dg
  WINDOW w AS (PARTITION BY design, model, seed ORDER BY s ROWS UNBOUNDED PRECEDING))""", ("preds",))


@query("detection_metrics", """SELECT design, model, seed, max(pp)::BIGINT AS n_ood, max(nn)::BIGINT AS n_known, round(sum(n * (tp - p + 0.5e0 * p) / pp / nn), 6) AS auroc, round(sum(p * 1e0 / pp * tp / (tp + fp)), 6) AS auprc,
round(min(fp * 1e0 / nn) FILTER (tp >= 0.95e0 * pp), 6) AS fpr_at_tpr FROM dc GROUP BY ALL""", ("det",))
def detection_metrics(spark, sf):
    scores = rt.cluster_scores(predictions(spark, sf), RUNK)
    return rounded(cv.detection_metrics(scores, RUNK), "auroc", "auprc", "fpr_at_tpr")


@query("detection_single_class", """SELECT design, model, seed, count(*) AS n_ood, CAST(0 AS BIGINT) AS n_known, CAST(NULL AS DOUBLE) AS auroc, CAST(NULL AS DOUBLE) AS auprc, CAST(NULL AS DOUBLE) AS fpr_at_tpr FROM op GROUP BY ALL""", ("ood_p",))
def detection_single_class(spark, sf):
    return cv.detection_metrics(unknown(spark, sf).withColumn("is_ood", F.lit(True)), RUNK)


define("rc", """rg AS (SELECT design, model, seed, confidence, sum(weight) AS w, sum(CASE WHEN correct THEN 0 ELSE weight END) AS e FROM kww GROUP BY ALL),
rcum AS (SELECT *, sum(w) OVER d AS cw, sum(e) OVER d AS ce, sum(w) OVER (PARTITION BY design, model, seed) AS tw FROM rg WINDOW d AS (PARTITION BY design, model, seed ORDER BY confidence DESC ROWS UNBOUNDED PRECEDING)),
rcv AS (SELECT design, model, seed, confidence, cw / tw AS coverage, ce / cw AS risk, w / tw AS step FROM rcum)""", ("known_w",))


@query("risk_coverage", "SELECT design, model, seed, round(confidence, 6) AS confidence, round(coverage, 6) AS coverage, round(risk, 6) AS risk, round(step, 6) AS step FROM rcv", ("rc",))
def risk_coverage(spark, sf):
    return rounded(cv.risk_coverage(evaluation_weights(known(spark, sf), RUNK), RUNK), "confidence", "coverage", "risk", "step")


@query("area_under_risk", """+ t AS (SELECT *, lag(risk, 1, 0) OVER w AS pr, lag(coverage, 1, 0) OVER w AS pc FROM rcv WINDOW w AS (PARTITION BY design, model, seed ORDER BY confidence DESC))
SELECT design, model, seed, round(sum((risk + pr) / 2 * (coverage - pc)), 6) AS aurc FROM t GROUP BY ALL""", ("rc",))
def area_under_risk(spark, sf):
    return rounded(cv.area_under_risk(evaluation_weights(known(spark, sf), RUNK), RUNK), "aurc")


# ------------------------------------------------------------------ leakage estimands

define("leak", """cm0 AS (SELECT design, seed, cluster_id, label, class, j, avg(p) AS p FROM scored WHERE role = 'test_known' GROUP BY ALL),
cm AS (SELECT design, seed, cluster_id, label, list(class ORDER BY round(p, 12) DESC, j)[1] AS predicted, max(p) AS confidence FROM cm0 GROUP BY ALL),
""" + f1_sql("lw", "pw", "design, seed", weight="cw") + ",\n" + f1_sql("lm", "cm", "design, seed"), ("pf1",))


@query("cluster_mean_predictions", """SELECT c.design, c.seed, c.cluster_id, c.label, c.predicted, round(c.confidence, 6) AS confidence, (SELECT count(*) FROM pk WHERE pk.design = c.design AND pk.seed = c.seed AND pk.cluster_id = c.cluster_id) AS n_rows FROM cm c""", ("leak",))
def cluster_mean_predictions(spark, sf):
    classes, rows = prob_rows(spark, sf)
    return rounded(me.cluster_mean_predictions(rows, ["design", "seed"], classes).drop("probability"), "confidence")


@query("leakage_metrics", """+ s AS (SELECT design, seed, count(*) AS n_rows, count(DISTINCT cluster_id) AS n_clusters, count(DISTINCT label) AS n_labels FROM pk GROUP BY ALL)
SELECT design, seed, n_rows, n_clusters, n_labels, round(pf.macro_f1, 6) AS pooled_row_macro_f1, round(lw.macro_f1, 6) AS equal_cluster_macro_f1, round(lm.macro_f1, 6) AS cluster_mean_macro_f1, round(lm.balanced_accuracy, 6) AS cluster_mean_balanced_accuracy
FROM s JOIN pf USING (design, seed) JOIN lw USING (design, seed) JOIN lm USING (design, seed)""", ("leak",))
def leakage_metrics(spark, sf):
    classes, rows = prob_rows(spark, sf)
    return rounded(me.leakage_metrics(rows, ["design", "seed"], classes), *me.ESTIMANDS, "cluster_mean_balanced_accuracy")


define("ldelta", """lall AS (SELECT design, seed, pf.macro_f1 AS pooled_row_macro_f1, lw.macro_f1 AS equal_cluster_macro_f1, lm.macro_f1 AS cluster_mean_macro_f1 FROM pf JOIN lw USING (design, seed) JOIN lm USING (design, seed)),
lu AS (UNPIVOT lall ON pooled_row_macro_f1, equal_cluster_macro_f1, cluster_mean_macro_f1 INTO NAME metric VALUE v),
ld AS (SELECT seed, metric, max(v) FILTER (design = 'row_random') AS row_random, max(v) FILTER (design = 'cluster_grouped') AS cluster_grouped FROM lu GROUP BY ALL)""", ("leak",))


@query("leakage_deltas", "SELECT seed, metric, round(row_random, 6) AS row_random, round(cluster_grouped, 6) AS cluster_grouped, round(row_random - cluster_grouped, 6) AS delta FROM ld", ("ldelta",))
def leakage_deltas(spark, sf):
    classes, rows = prob_rows(spark, sf)
    return rounded(me.design_deltas(me.leakage_metrics(rows, ["design", "seed"], classes), ["seed"]), "row_random", "cluster_grouped", "delta")


@query("leakage_summary", """SELECT metric, count(*) AS n_seeds, round(avg(row_random), 6) AS row_random_mean, round(avg(cluster_grouped), 6) AS cluster_grouped_mean, round(avg(row_random - cluster_grouped), 6) AS delta_mean,
round(stddev_samp(row_random - cluster_grouped), 6) AS delta_sd, round(min(row_random - cluster_grouped), 6) AS delta_min, round(max(row_random - cluster_grouped), 6) AS delta_max FROM ld GROUP BY metric""", ("ldelta",))
def leakage_summary(spark, sf):
    classes, rows = prob_rows(spark, sf)
    out = me.delta_summary(me.design_deltas(me.leakage_metrics(rows, ["design", "seed"], classes), ["seed"]), [])
    return rounded(out, *[c for c in out.columns if c not in ("metric", "n_seeds")])


@query("endpoint_suite", """+ e AS (SELECT design, seed, count(*) AS n_rows, count(DISTINCT cluster_id) AS n_clusters, count(DISTINCT label) AS n_labels, sum((confidence >= 0.5e0)::INT)::BIGINT AS accepted_count, avg((confidence >= 0.5e0)::INT) AS accepted_rate,
avg(correct::INT) FILTER (confidence >= 0.5e0) AS accepted_accuracy, avg(top3::INT) AS row_top3_accuracy FROM pk GROUP BY ALL)
SELECT design, seed, n_rows, n_clusters, n_labels, accepted_count, round(accepted_rate, 6) AS accepted_rate, round(accepted_accuracy, 6) AS accepted_accuracy, round(row_top3_accuracy, 6) AS row_top3_accuracy,
round(pf.accuracy, 6) AS row_accuracy, round(pf.macro_f1_true_labels, 6) AS row_macro_f1, round(pf.balanced_accuracy, 6) AS row_balanced_accuracy, round(lw.accuracy, 6) AS equal_cluster_accuracy, round(lw.macro_f1_true_labels, 6) AS equal_cluster_macro_f1,
round(lm.accuracy, 6) AS cluster_aggregate_accuracy, round(lm.macro_f1_true_labels, 6) AS cluster_aggregate_macro_f1 FROM e JOIN pf USING (design, seed) JOIN lw USING (design, seed) JOIN lm USING (design, seed)""", ("leak",))
def endpoint_suite(spark, sf):
    classes, rows = prob_rows(spark, sf)
    out = me.endpoint_suite(rows.withColumn("accepted", F.col("confidence") >= 0.5), ["design", "seed"], classes, "probability")
    return rounded(out, *[c for c in out.columns if c.endswith(("accuracy", "f1", "rate"))])


@query("false_acceptance", """+ x AS (SELECT *, 'all' AS population FROM op UNION ALL SELECT *, CASE ood_distance WHEN 'near' THEN 'same-parent' ELSE 'different-parent' END FROM op)
SELECT design, model, seed, fold, population, count(*) AS n_rows, count(DISTINCT cluster_id) AS n_clusters, count(DISTINCT label) AS n_labels, sum(accepted::INT)::BIGINT AS false_accepts, round(avg(accepted::INT), 6) AS false_accept_rate FROM x GROUP BY ALL""", ("ood_p",))
def false_acceptance(spark, sf):
    return rounded(me.false_acceptance(unknown(spark, sf), CELLK), "false_accept_rate")


# ------------------------------------------------------------------ composed

define("mrun", """mall AS (SELECT p.design, p.seed, p.fold, p.role, p.row_id, p.cluster_id, p.label, p.parent, c.ood_distance, p.confidence, p.confidence >= 0.5e0 AS accepted,
  CASE WHEN p.confidence >= 0.5e0 THEN 'label' ELSE 'parent' END AS reported_level, CASE WHEN p.confidence >= 0.5e0 THEN p.predicted ELSE k.class_parent END AS reported_label
  FROM prow p JOIN manifest c USING (row_id) JOIN classes k ON k.class = p.predicted),
mk AS (SELECT * FROM mall WHERE role = 'test_known'), mo AS (SELECT * FROM mall WHERE role = 'test_ood')""", ("prow",))

@query("run_metrics", """+ kc AS (SELECT design, seed, cluster_id, avg(accepted::INT) AS a FROM mk GROUP BY ALL), ka AS (SELECT design, seed, avg(a) AS known_acceptance FROM kc GROUP BY ALL),
oc AS (SELECT design, seed, ood_distance, label, cluster_id, avg(accepted::INT) AS a FROM mo GROUP BY ALL), ol AS (SELECT design, seed, ood_distance, label, avg(a) AS a FROM oc GROUP BY ALL),
oa AS (SELECT design, seed, avg(a) AS ood_false_accept, avg(a) FILTER (ood_distance = 'near') AS near_false_accept, avg(a) FILTER (ood_distance = 'far') AS far_false_accept FROM ol GROUP BY ALL),
s AS (SELECT design, seed, (role = 'test_ood')::INT AS pos, cluster_id, round(sum(CAST(confidence AS DECIMAL(38, 15)))::DOUBLE / count(confidence), 12) AS s FROM (SELECT * FROM mk UNION ALL SELECT * FROM mo) GROUP BY ALL),
g AS (SELECT design, seed, s, sum(pos) AS p, sum(1 - pos) AS n FROM s GROUP BY ALL),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY design, seed) AS pp, sum(n) OVER (PARTITION BY design, seed) AS nn FROM g WINDOW w AS (PARTITION BY design, seed ORDER BY s ROWS UNBOUNDED PRECEDING)),
d AS (SELECT design, seed, sum(n * (tp - p + 0.5e0 * p) / pp / nn) AS auroc, sum(p * 1e0 / pp * tp / (tp + fp)) AS auprc, min(fp * 1e0 / nn) FILTER (tp >= 0.95e0 * pp) AS fpr_at_tpr FROM c GROUP BY ALL),
fb AS (SELECT design, seed, avg((reported_label = parent)::INT) AS parent_fallback_accuracy FROM mk WHERE reported_level = 'parent' GROUP BY ALL)
SELECT design, seed, round(known_acceptance, 6) AS known_acceptance, round(ood_false_accept, 6) AS ood_false_accept, round(near_false_accept, 6) AS near_false_accept, round(far_false_accept, 6) AS far_false_accept,
round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(fpr_at_tpr, 6) AS fpr_at_tpr, round(parent_fallback_accuracy, 6) AS parent_fallback_accuracy
FROM ka JOIN oa USING (design, seed) JOIN d USING (design, seed) LEFT JOIN fb USING (design, seed)""", ("mrun",))
def run_metrics(spark, sf):
    rows = durable(_metric_rows(spark, sf))
    out = ev.run_metrics(rows, ["design", "seed"])
    columns = ["known_acceptance", "ood_false_accept", "near_false_accept", "far_false_accept", "auroc", "auprc", "fpr_at_tpr", "parent_fallback_accuracy"]
    return rounded(out.select("design", "seed", *columns), *columns)


def _metric_rows(spark, sf):
    parents = known_classes(spark, sf)
    classes = list(parents)
    rows = scored(spark, sf, parents)
    at = ar.argmax_index(F.col("probability"))
    rows = rows.withColumn("predicted", F.get(ar.class_array(classes), at)).withColumn("confidence", F.array_max("probability"))
    rows = me.enrich_rows(rows, classes).withColumn("accepted", F.col("confidence") >= 0.5)
    level = F.when(F.col("accepted"), "label").otherwise("parent")
    return rows.withColumn("reported_level", level).withColumn(
        "reported_label", F.when(F.col("accepted"), F.col("predicted")).otherwise(F.get(ar.class_array([parents[c] for c in classes]), at)))
