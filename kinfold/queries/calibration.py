"""Temperature, conformal thresholds, prediction sets, decisions and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions import arrays as ar
from kinfold.operators import audits as au
from kinfold.operators import calibration as cal
from kinfold.operators import decisions as de
from kinfold.operators import rates as rt
from kinfold.operators.weights import evaluation_weights
from kinfold.plans import open_set as os_
from kinfold.queries.base import define, known_classes, query, rounded, scored
from kinfold.session import durable

RUN = ["design", "seed", "fold"]
MIN = cal.MIN_CLASS_ROWS  # class size that still calibrates on its own


def rows_and_classes(spark, sf, role=None):
    """Scored rows, those of one role as a written table; all of them are made anew from the staged base where they are summed."""
    parents = known_classes(spark, sf)
    rows = scored(spark, sf, parents)
    return (rows if role is None else durable(rows.filter(F.col("role") == role))), parents


define("cal", """cal AS (SELECT *, 1e0 - p AS s FROM scored WHERE role = 'calibration' AND class = label),
gq AS (SELECT design, seed, fold, count(*) AS n, coalesce(list(s ORDER BY s)[CAST(ceil((count(*) + 1) * 0.95e0) AS INTEGER)], 1e0) AS g FROM cal GROUP BY ALL),
oq AS (SELECT design, seed, fold, class, count(*) AS n_rows, coalesce(list(s ORDER BY s)[CAST(ceil((count(*) + 1) * 0.95e0) AS INTEGER)], 1e0) AS o FROM cal GROUP BY ALL),
thr AS (SELECT design, seed, fold, class, c.j, coalesce(n_rows, 0) AS n_rows, g AS global_threshold, CASE WHEN coalesce(n_rows, 0) >= 20 THEN o ELSE g END AS threshold,
  CASE WHEN coalesce(n_rows, 0) >= 20 THEN 'class-conditional' ELSE 'pooled-fallback' END AS threshold_source FROM gq CROSS JOIN classes c LEFT JOIN oq USING (design, seed, fold, class)),
mx AS (SELECT design, seed, fold, role, row_id, cluster_id, label, parent, max(p) AS confidence FROM scored GROUP BY ALL),
md AS (SELECT design, seed, fold, cluster_id, median(confidence) AS m FROM mx WHERE role = 'calibration' GROUP BY ALL),
tau AS (SELECT design, seed, fold, count(*) AS n, list(m ORDER BY m)[CAST(floor((count(*) - 1) * (1e0 - 0.95e0)) AS INTEGER) + 1] AS tau,
  list(m ORDER BY m)[CAST(least(greatest(floor((1e0 - 0.95e0) * count(*) + 1e-12), 0), count(*) - 1) AS INTEGER) + 1] AS retained FROM md GROUP BY ALL)""", ("scored",))


@query("finite_sample_quantile", "SELECT design, seed, fold, n, round(g, 6) AS threshold FROM gq", ("cal",))
def finite_sample_quantile(spark, sf):
    rows, parents = rows_and_classes(spark, sf, "calibration")
    fitted = cal.nonconformity(rows, list(parents))
    return rounded(cal.finite_sample_quantile(fitted, RUN, "score"), "threshold")


@query("small_sample_quantile", """SELECT design, seed, fold, cluster_id, count(*) AS n, round(coalesce(list(s ORDER BY s)[CAST(ceil((count(*) + 1) * 0.8e0) AS INTEGER)], 1e0), 6) AS threshold FROM cal GROUP BY ALL""", ("cal",))
def small_sample_quantile(spark, sf):
    rows, parents = rows_and_classes(spark, sf, "calibration")
    fitted = cal.nonconformity(rows, list(parents))
    return rounded(cal.finite_sample_quantile(fitted, [*RUN, "cluster_id"], "score", 0.8), "threshold")


@query("class_thresholds", "SELECT design, seed, fold, class, n_rows, round(threshold, 6) AS threshold, round(global_threshold, 6) AS global_threshold, threshold_source FROM thr", ("cal",))
def class_thresholds(spark, sf):
    rows, parents = rows_and_classes(spark, sf, "calibration")
    fitted = cal.nonconformity(rows, list(parents))
    return rounded(cal.class_thresholds(fitted, RUN, list(parents), min_rows=MIN), "threshold", "global_threshold")


@query("acceptance_threshold", "SELECT design, seed, fold, n, round(tau, 6) AS tau FROM tau", ("cal",))
def acceptance_threshold(spark, sf):
    rows, _ = rows_and_classes(spark, sf, "calibration")
    fitted = rows.withColumn("confidence", F.array_max("probability"))
    return rounded(cal.acceptance_threshold(fitted, RUN), "tau")


@query("retained_fraction_threshold", "SELECT design, seed, fold, n AS n_clusters, round(retained, 6) AS threshold FROM tau", ("cal",))
def retained_fraction_threshold(spark, sf):
    rows, _ = rows_and_classes(spark, sf, "calibration")
    fitted = rows.withColumn("score", F.array_max("probability"))
    return rounded(cal.retained_fraction_threshold(fitted, RUN), "threshold")


@query("cluster_median_confidence", "SELECT design, seed, fold, cluster_id, round(m, 6) AS median FROM md", ("cal",))
def cluster_median_confidence(spark, sf):
    from kinfold.operators.ranking import group_median
    rows, _ = rows_and_classes(spark, sf, "calibration")
    fitted = rows.withColumn("confidence", F.array_max("probability"))
    return rounded(group_median(fitted, [*RUN, "cluster_id"], "confidence", "median"), "median")


def _temperature_rounds() -> str:
    text, half, mid = "", 4.0, "SELECT design, seed, 0e0 AS mid FROM (SELECT DISTINCT design, seed FROM tz)"
    for i in range(4):
        step = 2 * half / 40
        text += f""",
g{i} AS (SELECT DISTINCT design, seed, least(greatest(mid - {half:.17e} + i * {step:.17e}, -4e0), 4e0) AS lt FROM ({mid}), range(41) AS r(i)),
l{i} AS (SELECT design, seed, lt, sum(w * (ln(e) + (top - y) / exp(lt))) / sum(w) AS loss FROM (
  SELECT design, seed, lt, row_id, any_value(w) AS w, any_value(top) AS top, any_value(y) AS y, sum(exp((z - top) / exp(lt))) AS e FROM tz JOIN g{i} USING (design, seed) GROUP BY design, seed, lt, row_id) GROUP BY ALL),
b{i} AS (SELECT design, seed, arg_min(lt, loss) AS mid, min(loss) AS loss FROM l{i} GROUP BY ALL)"""
        half, mid = step, f"SELECT design, seed, mid FROM b{i}"
    return text


@query("fit_temperature", """+ tr AS (SELECT design, seed, row_id, cluster_id, label, class, ln(greatest(p, 1e-12)) * 1.7e0 AS z FROM scored WHERE role = 'calibration'),
tw AS (SELECT design, seed, row_id, 1e0 / count(*) OVER (PARTITION BY design, seed, cluster_id) AS w FROM (SELECT DISTINCT design, seed, row_id, cluster_id FROM tr)),
tz AS (SELECT design, seed, row_id, z, w, max(z) OVER p AS top, max(CASE WHEN class = label THEN z END) OVER p AS y FROM tr JOIN tw USING (design, seed, row_id) WINDOW p AS (PARTITION BY design, seed, row_id))"""
       + _temperature_rounds() + "\nSELECT design, seed, round(mid, 6) AS log_temperature, round(exp(mid), 6) AS temperature, round(loss, 6) AS loss FROM b3", ("scored",))
def fit_temperature(spark, sf):
    rows, parents = rows_and_classes(spark, sf, "calibration")
    fitted = rows
    logits = F.transform(ar.probability_to_logits(F.col("probability")), lambda z: z * 1.7)
    weighted = durable(evaluation_weights(fitted.withColumn("logits", logits), ["design", "seed"]).select("design", "seed", "label", "logits", "weight"))
    return rounded(cal.fit_temperature(weighted, ["design", "seed"], list(parents)), "log_temperature", "temperature", "loss")


# ------------------------------------------------------------------ decisions

define("dec", """pp AS (SELECT design, seed, fold, role, row_id, cluster_id, label, parent, class_parent AS top, min(j) AS pj, list_sum(list(p ORDER BY j)) AS pp FROM scored GROUP BY ALL),
pcal AS (SELECT *, 1e0 - pp AS s FROM pp WHERE role = 'calibration' AND top = parent),
pg AS (SELECT design, seed, fold, coalesce(list(s ORDER BY s)[CAST(ceil((count(*) + 1) * 0.95e0) AS INTEGER)], 1e0) AS g FROM pcal GROUP BY ALL),
po AS (SELECT design, seed, fold, top, count(*) AS n_rows, coalesce(list(s ORDER BY s)[CAST(ceil((count(*) + 1) * 0.95e0) AS INTEGER)], 1e0) AS o FROM pcal GROUP BY ALL),
pthr AS (SELECT design, seed, fold, top, coalesce(n_rows, 0) AS n_rows, g AS global_threshold, CASE WHEN coalesce(n_rows, 0) >= 20 THEN o ELSE g END AS threshold FROM pg CROSS JOIN (SELECT DISTINCT class_parent AS top FROM classes) LEFT JOIN po USING (design, seed, fold, top)),
lset AS (SELECT s.design, s.seed, s.fold, s.row_id, list(s.class ORDER BY s.j) FILTER (1e0 - p <= threshold) AS ls, list(s.class ORDER BY p DESC, s.j)[1] AS predicted FROM scored s JOIN thr t USING (design, seed, fold, class) GROUP BY ALL),
pset AS (SELECT s.design, s.seed, s.fold, s.row_id, list(s.top ORDER BY s.top) FILTER (1e0 - pp <= threshold) AS ps, list(s.top ORDER BY pp DESC, s.top)[1] AS parent_argmax FROM pp s JOIN pthr t USING (design, seed, fold, top) GROUP BY ALL),
rep0 AS (SELECT m.*, coalesce(ls, []) AS ls, coalesce(ps, []) AS ps, predicted, parent_argmax, tau, confidence >= tau AS conf FROM mx m JOIN lset USING (design, seed, fold, row_id) JOIN pset USING (design, seed, fold, row_id) JOIN tau USING (design, seed, fold)),
rep AS (SELECT *, len(ls) = 1 AND conf AS accepted, CASE WHEN len(ls) = 1 AND conf THEN 'label' WHEN len(ps) = 1 THEN 'parent' ELSE 'unidentified' END AS reported_level,
  CASE WHEN len(ls) = 1 AND conf THEN ls[1] WHEN len(ps) = 1 THEN ps[1] ELSE 'unidentified' END AS reported_label FROM rep0),
dec0 AS (SELECT *, len(ls) = 1 AND ls[1] = predicted AS cs, len(ls) = 1 AND ls[1] = predicted AND conf AS ca, len(ps) = 1 AND ps[1] = parent_argmax AS pm FROM rep),
dec AS (SELECT *, NOT ca AND pm AS cp, CASE WHEN ca THEN 'label' WHEN pm THEN 'parent' ELSE 'unidentified' END AS cl, CASE WHEN ca THEN ls[1] WHEN pm THEN ps[1] ELSE 'unidentified' END AS ct FROM dec0)""", ("cal",))


def reports(spark, sf):
    rows, parents = rows_and_classes(spark, sf)
    return os_.conformal_reports(rows, RUN, parents, min_rows=MIN)


@query("hierarchical_report", """SELECT design, seed, fold, row_id, array_to_string(ls, ',') AS label_set, CAST(len(ls) AS INTEGER) AS label_set_size, array_to_string(ps, ',') AS parent_set, CAST(len(ps) AS INTEGER) AS parent_set_size,
accepted, reported_level, reported_label FROM rep""", ("dec",))
def hierarchical_report(spark, sf):
    out = reports(spark, sf)[0]
    text = lambda c: F.array_join(c, ",").alias(c)
    return out.select(*RUN, "row_id", text("label_set"), "label_set_size", text("parent_set"), "parent_set_size", "accepted", "reported_level", "reported_label")


def decisions(spark, sf):
    return de.decision_frame(*reports(spark, sf))


@query("corrected_decisions", """SELECT design, seed, fold, row_id, predicted, parent_argmax, conf AS confidence_only_accept, len(ls) = 1 AS singleton, cs AS corrected_singleton, accepted AS legacy_accept, ca AS corrected_accept,
reported_level = 'parent' AS legacy_parent_report, cp AS corrected_parent_report, cl AS corrected_level, ct AS corrected_label, list_contains(ls, label) AS set_contains_true, list_contains(ps, parent) AS parent_set_contains_true,
CASE cl WHEN 'label' THEN ct = label WHEN 'parent' THEN ct = parent ELSE false END AS corrected_any_correct FROM dec""", ("dec",))
def corrected_decisions(spark, sf):
    return decisions(spark, sf).select(
        *RUN, "row_id", "predicted", "parent_argmax", "confidence_only_accept", "singleton", "corrected_singleton", "legacy_accept", "corrected_accept",
        "legacy_parent_report", "corrected_parent_report", "corrected_level", "corrected_label", "set_contains_true", "parent_set_contains_true", "corrected_any_correct")


@query("precision_audit", """SELECT design, seed, fold, count(*) AS n_rows, CAST(0 AS BIGINT) AS argmax_mismatches, 0e0 AS max_confidence_gap, CAST(0 AS BIGINT) AS threshold_flips, round(min(abs(confidence - tau)), 6) AS min_margin, 0e0 AS max_sum_error,
sum(accepted::INT)::BIGINT AS legacy_accepts, sum((accepted AND NOT cs)::INT)::BIGINT AS accepted_not_argmax, sum((reported_level = 'parent' AND NOT pm)::INT)::BIGINT AS parent_not_argmax FROM dec GROUP BY ALL""", ("dec",))
def precision_audit(spark, sf):
    return rounded(de.precision_audit(decisions(spark, sf), RUN), "max_confidence_gap", "min_margin", "max_sum_error")


@query("decision_reproduction", """SELECT design, seed, fold, row_id, 'acceptance' AS rule FROM rep WHERE accepted AND confidence < 0.6e0 UNION ALL SELECT design, seed, fold, row_id, 'label set size' FROM rep WHERE label = predicted AND len(ls) = 2""", ("dec",))
def decision_reproduction(spark, sf):
    frame = decisions(spark, sf).select(
        *RUN, "row_id", "label_set", "parent_set", "parent_set_size", "legacy_accept",
        (F.col("accepted") & (F.col("confidence") >= 0.6)).alias("accepted"),
        (F.col("label_set_size") + ((F.col("label") == F.col("predicted")) & (F.col("label_set_size") == 2)).cast("int")).alias("label_set_size"),
    )
    return de.reproduction_violations(frame).select(*RUN, "row_id", "rule")


define("sel", """dm AS (SELECT d.*, ood_distance, ood_singleton, len(string_split(trim(d.label), '_')) = 2 AND right(d.label, 1) <> '2' AS explicit FROM dec d JOIN manifest m USING (row_id)),
dsel AS (SELECT *, unnest(list_filter([CASE WHEN role = 'calibration' THEN 'calibration' END, CASE WHEN role = 'test_known' THEN 'known' END, CASE WHEN role = 'test_ood' THEN 'all_ood' END,
  CASE WHEN role = 'test_ood' AND ood_distance = 'near' THEN 'same_parent_ood' END, CASE WHEN role = 'test_ood' AND ood_distance = 'far' THEN 'different_parent_ood' END, CASE WHEN role = 'test_ood' AND ood_singleton THEN 'singleton_ood' END,
  CASE WHEN role = 'test_known' AND explicit THEN 'known_explicit_binomial' END, CASE WHEN role = 'test_known' AND NOT explicit THEN 'known_sp_only' END,
  CASE WHEN role = 'test_ood' AND ood_distance = 'near' AND explicit THEN 'same_parent_ood_explicit_binomial' END, CASE WHEN role = 'test_ood' AND ood_distance = 'near' AND NOT explicit THEN 'same_parent_ood_sp_only' END,
  CASE WHEN role = 'test_ood' AND ood_distance = 'far' AND explicit THEN 'different_parent_ood_explicit_binomial' END, CASE WHEN role = 'test_ood' AND ood_distance = 'far' AND NOT explicit THEN 'different_parent_ood_sp_only' END], lambda x: x IS NOT NULL)) AS selector FROM dm)""", ("dec",))


def explicit_rule():
    return (F.size(F.split("label", "_")) == 2) & (F.substring("label", -1, 1) != "2")


@query("decision_summary", """SELECT design, seed, fold, selector, count(*) AS n_rows, count(DISTINCT row_id) AS n_unique_rows, count(DISTINCT cluster_id) AS n_clusters, count(DISTINCT label) AS n_labels, round(avg(len(ls)), 6) AS mean_set_size,
sum(accepted::INT)::BIGINT AS legacy_label_n, sum(ca::INT)::BIGINT AS corrected_label_n, round(sum((ca AND ct = label)::INT) / nullif(sum(ca::INT), 0), 6) AS corrected_label_accuracy,
sum(cp::INT)::BIGINT AS corrected_parent_n, round(sum((cp AND ct = parent)::INT) / nullif(sum(cp::INT), 0), 6) AS corrected_parent_accuracy FROM dsel GROUP BY ALL""", ("sel",))
def decision_summary(spark, sf):
    out = de.decision_summary(decisions(spark, sf), RUN, explicit_rule())
    return rounded(out.select(*RUN, "selector", "n_rows", "n_unique_rows", "n_clusters", "n_labels", "mean_set_size", "legacy_label_n", "corrected_label_n",
                              "corrected_label_accuracy", "corrected_parent_n", "corrected_parent_accuracy"), "mean_set_size", "corrected_label_accuracy", "corrected_parent_accuracy")


@query("selector_counts", "SELECT selector, count(*) AS n_rows, count(DISTINCT cluster_id) AS n_clusters FROM dsel GROUP BY selector", ("sel",))
def selector_counts(spark, sf):
    rows, _ = rows_and_classes(spark, sf)
    return rt.by_selector(rows, explicit_rule()).groupBy("selector").agg(F.count("*").alias("n_rows"), F.countDistinct("cluster_id").alias("n_clusters"))


@query("per_run_decision_rates", """+ c AS (SELECT design, seed, fold, selector, label, cluster_id, avg(ca::INT) AS m, sum(ca::INT) AS s, count(*) AS n FROM dsel GROUP BY ALL),
l AS (SELECT design, seed, fold, selector, label, avg(m) AS lm, sum(m) AS cs, count(*) AS cn, sum(s) AS s, sum(n) AS n FROM c GROUP BY ALL)
SELECT design, seed, fold, selector, round(sum(s) / sum(n), 6) AS corrected_accept__row, round(sum(cs) / sum(cn), 6) AS corrected_accept__cluster, round(avg(lm), 6) AS corrected_accept__label_macro FROM l GROUP BY ALL""", ("sel",))
def per_run_decision_rates(spark, sf):
    out = rt.rates_by_selector(decisions(spark, sf), RUN, ["corrected_accept"], explicit_rule())
    return rounded(out, *[c for c in out.columns if "__" in c])


@query("parent_probability", "SELECT design, seed, fold, row_id, top, round(pp, 6) AS p FROM pp WHERE role = 'calibration'", ("dec",))
def parent_probability(spark, sf):
    rows, parents = rows_and_classes(spark, sf, "calibration")
    out, tops = cal.parent_probability(rows, list(parents), parents)
    pairs = F.arrays_zip(ar.class_array(tops).alias("t"), F.col("parent_probability").alias("p"))
    return out.select(*RUN, "row_id", F.explode(pairs).alias("x")).select(*RUN, "row_id", F.col("x.t").alias("top"), F.round("x.p", 6).alias("p"))


@query("calibration_support", """SELECT design, seed, fold, 'label' AS level, t.class, t.n_rows, (SELECT count(DISTINCT cluster_id) FROM cal c WHERE c.design = t.design AND c.seed = t.seed AND c.fold = t.fold AND c.class = t.class) AS n_clusters,
CASE WHEN t.n_rows >= 20 THEN 'class-conditional' ELSE 'pooled-fallback' END AS threshold_source, round(CASE WHEN t.n_rows >= 20 THEN o ELSE g END, 6) AS threshold, round(abs(0.9e0 - g), 6) AS declared_gap
FROM thr t JOIN gq USING (design, seed, fold) LEFT JOIN oq USING (design, seed, fold, class)
UNION ALL SELECT design, seed, fold, 'parent', t.top, t.n_rows, (SELECT count(DISTINCT cluster_id) FROM pcal c WHERE c.design = t.design AND c.seed = t.seed AND c.fold = t.fold AND c.top = t.top),
CASE WHEN t.n_rows >= 20 THEN 'class-conditional' ELSE 'pooled-fallback' END, round(CASE WHEN t.n_rows >= 20 THEN o ELSE g END, 6), NULL FROM pthr t JOIN pg USING (design, seed, fold) LEFT JOIN po USING (design, seed, fold, top)""", ("dec",))
def calibration_support(spark, sf):
    rows, parents = rows_and_classes(spark, sf)
    fitted, tops = cal.parent_probability(rows.filter("role = 'calibration'"), list(parents), parents)
    declared = rows.select(*RUN).distinct().withColumn("declared_threshold", F.lit(0.9))
    out = cal.calibration_support(durable(fitted), RUN, list(parents), tops, declared)
    return rounded(out.select(*RUN, "level", "class", "n_rows", "n_clusters", "threshold_source", "threshold", "declared_gap"), "threshold", "declared_gap")


define("cmd", """mp AS (SELECT design, seed, fold, role, cluster_id, label, parent, class, class_parent, j, avg(p) AS p, count(*) AS n_rows FROM scored GROUP BY ALL),
mq AS (SELECT design, seed, fold, role, cluster_id, label, parent, class_parent AS top, list_sum(list(p ORDER BY j)) AS pp FROM mp GROUP BY ALL),
mlq AS (SELECT design, seed, fold, count(*) AS n, coalesce(list(1e0 - p ORDER BY 1e0 - p)[CAST(ceil((count(*) + 1) * 0.95e0) AS INTEGER)], 1e0) AS lq FROM mp WHERE role = 'calibration' AND class = label GROUP BY ALL),
mpq AS (SELECT design, seed, fold, coalesce(list(1e0 - pp ORDER BY 1e0 - pp)[CAST(ceil((count(*) + 1) * 0.95e0) AS INTEGER)], 1e0) AS pq FROM mq WHERE role = 'calibration' AND top = parent GROUP BY ALL),
mc AS (SELECT design, seed, fold, role, cluster_id, label, parent, max(p) AS conf, any_value(n_rows) AS n_rows FROM mp GROUP BY ALL),
mt AS (SELECT design, seed, fold, list(conf ORDER BY conf)[CAST(floor((count(*) - 1) * (1e0 - 0.95e0)) AS INTEGER) + 1] AS tau FROM mc WHERE role = 'calibration' GROUP BY ALL)""", ("scored",))


@query("cluster_mean_support", "SELECT design, seed, fold, n AS n_calibration_clusters, round(lq, 6) AS label_threshold, round(pq, 6) AS parent_threshold, round(tau, 6) AS tau FROM mlq JOIN mpq USING (design, seed, fold) JOIN mt USING (design, seed, fold)", ("cmd",))
def cluster_mean_support(spark, sf):
    rows, parents = rows_and_classes(spark, sf)
    return rounded(de.cluster_mean_decisions(rows, RUN, list(parents), parents)[1], "label_threshold", "parent_threshold", "tau")


@query("cluster_mean_decisions", """+ r AS (SELECT c.*, round(conf, 6) AS rc, conf >= tau - 1e-12 AS confidence_only_accept FROM mc c JOIN mt USING (design, seed, fold) WHERE role = 'test_known')
SELECT design, seed, fold, cluster_id, n_rows, rc AS confidence, confidence_only_accept FROM r""", ("cmd",))
def cluster_mean_decisions(spark, sf):
    rows, parents = rows_and_classes(spark, sf)
    out = de.cluster_mean_decisions(rows, RUN, list(parents), parents)[0]
    return rounded(out.filter("role = 'test_known'").select(*RUN, "cluster_id", "n_rows", "confidence", "confidence_only_accept"), "confidence")


@query("cluster_mean_metrics", """+ ml AS (SELECT design, seed, fold, role, cluster_id, label, parent, coalesce(list(class ORDER BY j) FILTER (1e0 - p <= lq + 1e-12), []) AS ls, list(class ORDER BY round(p, 12) DESC, j)[1] AS best, max(p) AS conf FROM mp JOIN mlq USING (design, seed, fold) GROUP BY ALL),
mg AS (SELECT design, seed, fold, role, cluster_id, coalesce(list(top ORDER BY top) FILTER (1e0 - pp <= pq + 1e-12), []) AS ps, list(top ORDER BY round(pp, 12) DESC, top)[1] AS ptop FROM mq JOIN mpq USING (design, seed, fold) GROUP BY ALL),
m1 AS (SELECT ml.*, ptop, conf >= tau - 1e-12 AS co, len(ls) = 1 AND ls[1] = best AS so, len(ps) = 1 AND ps[1] = ptop AS po FROM ml JOIN mg USING (design, seed, fold, role, cluster_id) JOIN mt USING (design, seed, fold)),
ct AS (SELECT cluster_id, min(ood_distance) AS od, bool_or(ood_singleton) AS os FROM manifest GROUP BY 1),
m2 AS (SELECT m1.*, so AND co AS acc, NOT (so AND co) AND po AS prep, od, os, right(label, 1) <> '2' AS explicit FROM m1 JOIN ct USING (cluster_id)),
m3 AS (SELECT *, unnest(list_filter([CASE WHEN role = 'calibration' THEN 'calibration' END, CASE WHEN role = 'test_known' THEN 'known' END, CASE WHEN role = 'test_ood' THEN 'all_ood' END,
  CASE WHEN role = 'test_ood' AND od = 'near' THEN 'same_parent_ood' END, CASE WHEN role = 'test_ood' AND od = 'far' THEN 'different_parent_ood' END, CASE WHEN role = 'test_ood' AND os THEN 'singleton_ood' END,
  CASE WHEN role = 'test_known' AND explicit THEN 'known_explicit_binomial' END, CASE WHEN role = 'test_known' AND NOT explicit THEN 'known_sp_only' END,
  CASE WHEN role = 'test_ood' AND od = 'near' AND explicit THEN 'same_parent_ood_explicit_binomial' END, CASE WHEN role = 'test_ood' AND od = 'near' AND NOT explicit THEN 'same_parent_ood_sp_only' END,
  CASE WHEN role = 'test_ood' AND od = 'far' AND explicit THEN 'different_parent_ood_explicit_binomial' END, CASE WHEN role = 'test_ood' AND od = 'far' AND NOT explicit THEN 'different_parent_ood_sp_only' END], lambda x: x IS NOT NULL)) AS selector FROM m2)
SELECT design, seed, fold, selector, count(*) AS n_clusters, count(DISTINCT label) AS n_labels, round(avg(co::INT), 6) AS confidence_only_accept, round(avg(so::INT), 6) AS set_only_singleton, round(avg(acc::INT), 6) AS accept, round(avg(prep::INT), 6) AS parent_report,
round(avg((NOT acc AND NOT prep)::INT), 6) AS unidentified, round(avg(list_contains(ls, label)::INT) FILTER (role <> 'test_ood'), 6) AS set_coverage, sum(acc::INT)::BIGINT AS label_report_n, round(avg((best = label)::INT) FILTER (acc), 6) AS label_report_accuracy,
sum(prep::INT)::BIGINT AS parent_report_n, round(avg((ptop = parent)::INT) FILTER (prep), 6) AS parent_accuracy FROM m3 GROUP BY ALL""", ("cmd",))
def cluster_mean_metrics(spark, sf):
    rows, parents = rows_and_classes(spark, sf)
    out = de.cluster_mean_decisions(rows, RUN, list(parents), parents)[0]
    result = de.cluster_mean_metrics(rt.by_selector(out, explicit_rule()), [*RUN, "selector"])
    return rounded(result, *[c for c in result.columns if c not in (*RUN, "selector", "n_clusters", "n_labels", "label_report_n", "parent_report_n")])


@query("invalid_probabilities", """SELECT design, seed, fold, row_id FROM mx WHERE role = 'calibration' AND row_id % 5 = 0""", ("cal",))
def invalid_probabilities(spark, sf):
    rows, parents = rows_and_classes(spark, sf, "calibration")
    broken = rows.withColumn("probability", F.when(
        F.col("row_id") % 5 == 0, F.when(F.col("row_id") % 2 == 0, F.transform("probability", lambda x: x * 1.001)).otherwise(F.concat("probability", F.array(F.lit(0.0))))
    ).otherwise(F.col("probability")))
    return au.invalid_probabilities(broken, len(parents)).select(*RUN, "row_id")


@query("closed_report", """SELECT design, seed, fold, row_id, class AS predicted, class_parent AS predicted_parent, 'label' AS reported_level, class AS reported_label, true AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY design, seed, fold, row_id ORDER BY p DESC, j) AS r FROM scored WHERE role = 'test_known') WHERE r = 1""", ("scored",))
def closed_report(spark, sf):
    rows, parents = rows_and_classes(spark, sf)
    out = de.closed_report(rows.filter("role = 'test_known'"), list(parents), parents)
    return out.select(*RUN, "row_id", "predicted", "predicted_parent", "reported_level", "reported_label", "accepted")
