"""Bootstraps, intervals, endpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import bootstrap as bs
from kinfold.plans import evaluation as ev
from kinfold.plans import open_set as os_
from kinfold.queries.base import define, query, rounded
from kinfold.queries.calibration import decisions as decision_rows
from kinfold.queries.calibration import explicit_rule
from kinfold.queries.metrics import f1_sql, known, unknown
from kinfold.session import durable

B = 2_000


def hash8(*parts: str) -> str:
    return f"('0x' || substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


define("cb", f"""cs AS (SELECT design, model, cluster_id, sum(accepted::INT) AS s, count(*) AS n FROM kp GROUP BY ALL),
cn AS (SELECT *, row_number() OVER (PARTITION BY design, model ORDER BY sha256(cluster_id::VARCHAR), cluster_id) - 1 AS i, count(*) OVER (PARTITION BY design, model) AS k FROM cs),
cd AS (SELECT design, model, b AS replicate, {hash8('5', 'b', 'design', 'model', 'i')} % k AS i FROM cn, range({B}) AS r(b)),
cr AS (SELECT d.design, d.model, d.replicate, sum(s) * 1e0 / sum(n) AS accepted FROM cd d JOIN cn USING (design, model, i) GROUP BY ALL)""", ("known_p",))


@query("clustered_rate_replicates", "SELECT design, model, replicate, accepted FROM cr", ("cb",))
def clustered_rate_replicates(spark, sf):
    return bs.clustered_rate(known(spark, sf), "accepted", B, 5, ["design", "model"])


@query("clustered_rate_interval", f"SELECT design, model, round(quantile_cont(accepted, 0.025), 6) AS ci_low, round(quantile_cont(accepted, 0.975), 6) AS ci_high, CAST({B} AS BIGINT) AS replicates FROM cr GROUP BY ALL", ("cb",))
def clustered_rate_interval(spark, sf):
    draws = bs.clustered_rate(known(spark, sf), "accepted", B, 5, ["design", "model"])
    return rounded(bs.percentile_interval(draws, ["design", "model"], "accepted"), "ci_low", "ci_high")


define("pb", """pd AS (SELECT model, seed, row_id, min(label) AS label, min(cluster_id) AS cluster_id, max(predicted) FILTER (design = 'row_random') AS pr, max(predicted) FILTER (design = 'cluster_grouped') AS pg, count(*) AS copies,
  CAST(1 AS BIGINT) AS variants FROM kp GROUP BY ALL)""", ("known_p",))


@query("paired_designs", "SELECT model, seed, row_id, label, cluster_id, pr AS predicted_random, pg AS predicted_grouped, copies, variants FROM pd", ("pb",))
def paired_designs(spark, sf):
    return ev.pair_designs(known(spark, sf))


@query("pairing_violations", "SELECT model, seed, row_id FROM pd WHERE row_id % 3 = 0", ("pb",))
def pairing_violations(spark, sf):
    rows = known(spark, sf).filter("NOT (design = 'row_random' AND row_id % 3 = 0)")
    return ev.pairing_violations(ev.pair_designs(rows)).select("model", "seed", "row_id")


define("fb", f"""pcl AS (SELECT DISTINCT model, label, cluster_id FROM pd),
pn AS (SELECT *, row_number() OVER (PARTITION BY model, label ORDER BY sha256(cluster_id::VARCHAR), cluster_id) - 1 AS i, count(*) OVER (PARTITION BY model, label) AS k FROM pcl),
pdr AS (SELECT model, label, b AS replicate, {hash8('9', 'b', 'model', 'label', 'i')} % k AS i FROM pn, range({B}) AS r(b)),
px AS (SELECT d.model, d.replicate, p.seed, p.label, p.pr, p.pg FROM pdr d JOIN pn n USING (model, label, i) JOIN pd p ON p.model = n.model AND p.cluster_id = n.cluster_id AND p.label = n.label),
""" + f1_sql("xr", "px", "model, replicate, seed", pred="pr") + ",\n" + f1_sql("xg", "px", "model, replicate, seed", pred="pg") + """,
pdraw AS (SELECT model, replicate, avg(xr.macro_f1 - xg.macro_f1) AS macro_f1_delta, avg(xr.accuracy - xg.accuracy) AS accuracy_delta FROM xr JOIN xg USING (model, replicate, seed) GROUP BY ALL),
""" + f1_sql("yr", "pd", "model, seed", pred="pr") + ",\n" + f1_sql("yg", "pd", "model, seed", pred="pg") + """,
ppoint AS (SELECT model, avg(yr.macro_f1 - yg.macro_f1) AS estimate FROM yr JOIN yg USING (model, seed) GROUP BY ALL)""", ("pb",))

ARMS = {"random": "predicted_random", "grouped": "predicted_grouped"}


@query("paired_f1_replicates", "SELECT model, replicate, round(macro_f1_delta, 6) AS macro_f1_delta, round(accuracy_delta, 6) AS accuracy_delta FROM pdraw", ("fb",))
def paired_f1_replicates(spark, sf):
    paired = durable(ev.pair_designs(known(spark, sf)))
    out = bs.paired_f1(paired, ARMS, B, 9, ["model"], within=["seed"])
    return rounded(out.select("model", "replicate", "macro_f1_delta", "accuracy_delta"), "macro_f1_delta", "accuracy_delta")


@query("paired_f1_shared_clusters", f"""+ ucl AS (SELECT DISTINCT model, cluster_id FROM pd),
un AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY sha256(cluster_id::VARCHAR), cluster_id) - 1 AS i, count(*) OVER (PARTITION BY model) AS k FROM ucl),
ud AS (SELECT model, b AS replicate, {hash8('3', 'b', 'model', 'i')} % k AS i FROM un, range({B}) AS r(b)),
ux AS (SELECT d.model, d.replicate, p.label, p.pr, p.pg FROM ud d JOIN un n USING (model, i) JOIN pd p ON p.model = n.model AND p.cluster_id = n.cluster_id),
""" + f1_sql("ur", "ux", "model, replicate", pred="pr") + ",\n" + f1_sql("ug", "ux", "model, replicate", pred="pg") + """
SELECT model, replicate, round(ur.macro_f1 - ug.macro_f1, 6) AS macro_f1_delta FROM ur JOIN ug USING (model, replicate)""", ("pb",))
def paired_f1_shared_clusters(spark, sf):
    paired = durable(ev.pair_designs(known(spark, sf)))
    out = bs.paired_f1(paired, ARMS, B, 3, ["model"], stratified=False)
    return rounded(out.select("model", "replicate", "macro_f1_delta"), "macro_f1_delta")


define("endp1", f"""e1 AS (SELECT model, 'paired_macro_f1_random_minus_grouped' AS endpoint, any_value(estimate) AS estimate, 0e0 AS null_value, quantile_cont(macro_f1_delta, 0.025) AS ci_low, quantile_cont(macro_f1_delta, 0.975) AS ci_high,
CAST({B} AS BIGINT) AS replicates, least((sum((macro_f1_delta <= 0)::INT) + 1) / ({B} + 1e0), 1e0) AS p_value FROM pdraw JOIN ppoint USING (model) GROUP BY model)""", ("fb",))
ENDP = "model, endpoint, round(estimate, 6) AS estimate, null_value, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, replicates, round(p_value, 6) AS p_value"


@query("leakage_endpoint", f"SELECT {ENDP} FROM e1", ("endp1",))
def leakage_endpoint(spark, sf):
    return rounded(ev.leakage_endpoint(durable(known(spark, sf)), B, 9), "estimate", "ci_low", "ci_high", "p_value")


define("hb", f"""hs0 AS (SELECT model, label, cluster_id, seed, fold, accepted::INT AS a FROM op WHERE design = 'cluster_grouped' AND ood_distance = 'near'),
hs AS (SELECT model, label, cluster_id, seed, fold, avg(a) AS a FROM hs0 GROUP BY ALL),
hn AS (SELECT *, row_number() OVER (PARTITION BY model, label ORDER BY sha256(cluster_id::VARCHAR), cluster_id) - 1 AS i, count(*) OVER (PARTITION BY model, label) AS k FROM (SELECT DISTINCT model, label, cluster_id FROM hs)),
hl AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY sha256(label), label) - 1 AS li, count(*) OVER (PARTITION BY model) AS lk FROM (SELECT DISTINCT model, label, k FROM hn)),
ho AS (SELECT o.model, o.b, o.occ, l.label, l.k FROM (SELECT model, b, li AS occ, {hash8('4', 'b', 'model', 'li')} % lk AS li FROM hl, range({B}) AS r(b)) o JOIN hl l USING (model, li)),
hp AS (SELECT model, b, occ, label, {hash8('4', 'b', 'model', 'occ', 'slot')} % k AS i FROM (SELECT *, unnest(range(k)) AS slot FROM ho)),
hx AS (SELECT p.model, p.b AS replicate, p.occ, s.seed, s.fold, s.a FROM hp p JOIN hn n USING (model, label, i) JOIN hs s ON s.model = n.model AND s.label = n.label AND s.cluster_id = n.cluster_id),
hm1 AS (SELECT model, replicate, seed, fold, occ, avg(a) AS a FROM hx GROUP BY ALL), hm2 AS (SELECT model, replicate, seed, fold, avg(a) AS a FROM hm1 GROUP BY ALL),
hmacro AS (SELECT model, replicate, avg(a) AS accepted FROM hm2 GROUP BY ALL),
ho2 AS (SELECT model, replicate, seed, fold, avg(a) AS a FROM hx GROUP BY ALL), hall AS (SELECT model, replicate, avg(a) AS accepted FROM ho2 GROUP BY ALL),
hq1 AS (SELECT model, seed, fold, label, avg(a) AS a FROM hs GROUP BY ALL), hq2 AS (SELECT model, seed, fold, avg(a) AS a FROM hq1 GROUP BY ALL), hpoint AS (SELECT model, avg(a) AS accepted FROM hq2 GROUP BY ALL)""", ("ood_p",))


def near_rows(spark, sf):
    return durable(unknown(spark, sf).filter("design = 'cluster_grouped' AND ood_distance = 'near'"))


@query("hierarchical_replicates", "SELECT model, replicate, round(accepted, 6) AS accepted FROM hmacro", ("hb",))
def hierarchical_replicates(spark, sf):
    return rounded(bs.hierarchical(near_rows(spark, sf), ["accepted"], B, 4, ["model"]), "accepted")


@query("hierarchical_overall_replicates", "SELECT model, replicate, round(accepted, 6) AS accepted FROM hall", ("hb",))
def hierarchical_overall_replicates(spark, sf):
    return rounded(bs.hierarchical(near_rows(spark, sf), ["accepted"], B, 4, ["model"], overall=True), "accepted")


@query("hierarchical_point", "SELECT model, round(accepted, 6) AS accepted FROM hpoint", ("hb",))
def hierarchical_point(spark, sf):
    return rounded(bs.hierarchical_point(near_rows(spark, sf), ["model"], ["seed", "fold"], ["accepted"]), "accepted")


@query("bootstrap_summary", f"""SELECT model, 'accepted' AS metric, round(any_value(p.accepted), 6) AS estimate, round(quantile_cont(h.accepted, 0.025), 6) AS ci_low, round(quantile_cont(h.accepted, 0.975), 6) AS ci_high, CAST({B} AS BIGINT) AS replicates
FROM hmacro h JOIN hpoint p USING (model) GROUP BY model""", ("hb",))
def bootstrap_summary(spark, sf):
    rows = near_rows(spark, sf)
    point = bs.hierarchical_point(rows, ["model"], ["seed", "fold"], ["accepted"])
    return rounded(bs.summarise(bs.hierarchical(rows, ["accepted"], B, 4, ["model"]), point, ["model"], ["accepted"]), "estimate", "ci_low", "ci_high")


define("endp2", f"""e2 AS (SELECT model, 'near_ood_false_accept_rate' AS endpoint, any_value(p.accepted) AS estimate, 0.05e0 AS null_value, quantile_cont(h.accepted, 0.025) AS ci_low, quantile_cont(h.accepted, 0.975) AS ci_high,
CAST({B} AS BIGINT) AS replicates, least((sum((h.accepted <= 0.05e0)::INT) + 1) / ({B} + 1e0), 1e0) AS p_value FROM hmacro h JOIN hpoint p USING (model) GROUP BY model)""", ("hb",))


@query("near_endpoint", f"SELECT {ENDP} FROM e2", ("endp2",))
def near_endpoint(spark, sf):
    rows = durable(unknown(spark, sf).filter("design = 'cluster_grouped'"))
    return rounded(ev.near_endpoint(rows, B, 4), "estimate", "ci_low", "ci_high", "p_value")


@query("holm_endpoints", """+ t AS (SELECT model || ':' || endpoint AS endpoint, p_value FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2)),
h AS (SELECT *, least(1e0, (count(*) OVER () - row_number() OVER o + 1) * p_value) AS step FROM t WINDOW o AS (ORDER BY p_value, endpoint))
SELECT endpoint, round(p_value, 6) AS p_value, round(max(step) OVER (ORDER BY p_value, endpoint ROWS UNBOUNDED PRECEDING), 6) AS holm_adjusted_p FROM h""", ("endp1", "endp2"))
def holm_endpoints(spark, sf):
    a = ev.leakage_endpoint(durable(known(spark, sf)), B, 9)
    b = ev.near_endpoint(durable(unknown(spark, sf).filter("design = 'cluster_grouped'")), B, 4)
    both = a.unionByName(b).select(F.concat_ws(":", "model", "endpoint").alias("endpoint"), "p_value")
    return rounded(bs.holm(durable(both)), "p_value", "holm_adjusted_p")


@query("bootstrap_tables")
def bootstrap_tables(spark, sf):
    rows = decision_rows(spark, sf).filter("design = 'cluster_grouped'").withColumn("model", F.lit("m_a"))
    table, _ = os_.bootstrap_tables(rows, B, 6, explicit=explicit_rule())
    return rounded(table, "estimate", "ci_low", "ci_high")
