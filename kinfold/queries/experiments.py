"""Contamination cohorts, rotations, injections, contrasts, dose response."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import contamination as ct
from kinfold.plans import contamination_study as study
from kinfold.queries.base import define, query, rounded, rows, vectors
from kinfold.queries.inference import B, hash8
from kinfold.queries.metrics import f1_sql
from kinfold.operators.features import explode_vectors
from kinfold.session import durable

SEEDS = (11, 12)
INT = ct.INTENSITY
VEC = ct.Experiment("prevalence", 2, 2, (0.0, 0.5, 1.0))


def tok(*parts: str) -> str:
    return f"sha256(concat_ws(chr(31), {', '.join(parts)}))"


define("cohort", f"""szs AS (SELECT label, cluster_id, count(*) AS available_rows FROM rows_ GROUP BY ALL HAVING count(*) >= 5),
lbs AS (SELECT label, count(*) AS eligible_clusters FROM szs GROUP BY label HAVING count(*) >= 5),
inv AS (SELECT label, cluster_id, available_rows, eligible_clusters, eligible_clusters // 5 AS q FROM szs JOIN lbs USING (label)),
coh AS (SELECT * FROM (SELECT r.row_id, cluster_id, label, row_number() OVER (PARTITION BY cluster_id ORDER BY {tok("'spectrum'", "'intensity'", 'cluster_id', 'row_id')}, row_id) - 1 AS selected_rank FROM rows_ r JOIN inv USING (label, cluster_id)) WHERE selected_rank < 5),
rk0 AS (SELECT i.*, seed, row_number() OVER (PARTITION BY seed, label ORDER BY {tok("'strain'", "'intensity'", 'seed', 'label', 'cluster_id')}, cluster_id) - 1 AS cluster_rank FROM inv i, (SELECT unnest([11, 12]) AS seed)),
rk1 AS (SELECT *, CASE WHEN cluster_rank < 5 * q THEN cluster_rank // q ELSE -1 END AS block FROM rk0),
crl AS (SELECT 'intensity' AS experiment, seed, rotation, label, cluster_id, q, cluster_rank, block, CASE WHEN block = rotation THEN 'evaluation' WHEN block = (rotation + 1) % 5 THEN 'donor' ELSE 'baseline_train' END AS cluster_role FROM rk1, (SELECT unnest([0, 1, 2, 3, 4]) AS rotation)),
prs0 AS (SELECT experiment, seed, rotation, label, cluster_rank % q AS pair_rank, max(cluster_id) FILTER (cluster_role = 'evaluation') AS evaluation_cluster, max(cluster_id) FILTER (cluster_role = 'donor') AS donor_cluster
  FROM crl WHERE cluster_role IN ('evaluation', 'donor') GROUP BY ALL),
prs AS (SELECT *, substr({tok('"pair"'.replace('"', "'"), 'experiment', 'seed', 'rotation', 'label', 'evaluation_cluster', 'donor_cluster')}, 1, 20) AS pair_id, {tok("'exposure'", 'experiment', 'seed', 'rotation', 'evaluation_cluster')} AS exposure_hash FROM prs0),
asg AS (SELECT c.experiment, c.seed, c.rotation, c.label, c.cluster_id, row_id, selected_rank, cluster_role, pair_id, CASE cluster_role WHEN 'evaluation' THEN CASE WHEN selected_rank = 0 THEN 'evaluation_query' ELSE 'same_cluster_candidate' END
  WHEN 'donor' THEN CASE WHEN selected_rank < 4 THEN 'donor_candidate' ELSE 'donor_unused' END ELSE 'baseline_train' END AS row_role
  FROM crl c JOIN coh USING (label, cluster_id) LEFT JOIN (SELECT experiment, seed, rotation, pair_id, evaluation_cluster AS cluster_id FROM prs UNION ALL SELECT experiment, seed, rotation, pair_id, donor_cluster FROM prs) USING (experiment, seed, rotation, cluster_id)),
exo AS (SELECT *, row_number() OVER (PARTITION BY seed, rotation ORDER BY exposure_hash, pair_id) - 1 AS pair_order, count(*) OVER (PARTITION BY seed, rotation) AS n_pairs FROM prs),
inj AS (SELECT a.seed, a.rotation, lv.level, 'leakage' AS arm, a.pair_id, pair_order, selected_rank - 1 AS candidate_rank, row_id, a.cluster_id, a.label FROM asg a JOIN exo e ON a.pair_id = e.pair_id, (SELECT unnest([1e0, 2e0, 4e0]) AS level) lv WHERE row_role = 'same_cluster_candidate' AND selected_rank - 1 < level
  UNION ALL SELECT a.seed, a.rotation, lv.level, 'matched_control', a.pair_id, pair_order, selected_rank, row_id, a.cluster_id, a.label FROM asg a JOIN exo e ON a.pair_id = e.pair_id, (SELECT unnest([1e0, 2e0, 4e0]) AS level) lv WHERE row_role = 'donor_candidate' AND selected_rank < level)""", ("rows_",))


@query("cohort_rows", "SELECT row_id, cluster_id, label, selected_rank FROM coh", ("cohort",))
def cohort_rows(spark, sf):
    return ct.build_cohort(rows(spark, sf), INT)[0].select("row_id", "cluster_id", "label", "selected_rank")


@query("cohort_inventory", "SELECT label, cluster_id, available_rows, eligible_clusters, q FROM inv", ("cohort",))
def cohort_inventory(spark, sf):
    return ct.build_cohort(rows(spark, sf), INT)[1]


@query("rotation_roles", "SELECT seed, rotation, label, cluster_id, cluster_rank, block, cluster_role FROM crl", ("cohort",))
def rotation_roles(spark, sf):
    out = ct.cluster_roles(ct.build_cohort(rows(spark, sf), INT)[1], INT, SEEDS)
    return out.select("seed", "rotation", "label", "cluster_id", "cluster_rank", "block", "cluster_role")


@query("rotation_pairs", "SELECT seed, rotation, label, pair_rank, evaluation_cluster, donor_cluster, pair_id, exposure_hash FROM prs", ("cohort",))
def rotation_pairs(spark, sf):
    roles = ct.cluster_roles(ct.build_cohort(rows(spark, sf), INT)[1], INT, SEEDS)
    return ct.build_pairs(roles).drop("experiment")


def _parts(spark, sf):
    return study.prepare(rows(spark, sf), INT, SEEDS, check=False)


@query("row_assignments", "SELECT seed, rotation, label, row_role, count(*) AS n_rows, count(DISTINCT cluster_id) AS n_clusters, count(DISTINCT pair_id) AS n_pairs FROM asg GROUP BY ALL", ("cohort",))
def row_assignments(spark, sf):
    return _parts(spark, sf)["assignments"].groupBy("seed", "rotation", "label", "row_role").agg(
        F.count("*").alias("n_rows"), F.countDistinct("cluster_id").alias("n_clusters"), F.countDistinct("pair_id").alias("n_pairs"))


@query("exposure_order", "SELECT seed, rotation, pair_id, pair_order, n_pairs FROM exo", ("cohort",))
def exposure_order(spark, sf):
    return ct.exposure_order(_parts(spark, sf)["pairs"]).select("seed", "rotation", "pair_id", "pair_order", "n_pairs")


@query("exposed_pairs", "SELECT seed, rotation, level, pair_id FROM exo, (SELECT unnest([0.25e0, 0.5e0, 0.75e0, 1e0]) AS level) WHERE pair_order < floor(level * n_pairs + 1e-9)", ("cohort",))
def exposed_pairs(spark, sf):
    half = ct.Experiment("prevalence", 2, 2, (0.0, 0.25, 0.5, 0.75, 1.0))
    return ct.exposed_pairs(_parts(spark, sf)["pairs"], half, exact=False).select("seed", "rotation", "level", "pair_id")


@query("prevalence_violations", "SELECT experiment, seed, rotation, n_pairs, level FROM (SELECT DISTINCT experiment, seed, rotation, n_pairs FROM exo), (SELECT unnest([0.3e0, 0.5e0]) AS level) WHERE abs(level * n_pairs - round(level * n_pairs)) > 1e-10", ("cohort",))
def prevalence_violations(spark, sf):
    return ct.prevalence_violations(_parts(spark, sf)["pairs"], [0.3, 0.5])


@query("injections", "SELECT seed, rotation, level, arm, pair_id, pair_order, candidate_rank, row_id FROM inj", ("cohort",))
def injections(spark, sf):
    return _parts(spark, sf)["injected"].select("seed", "rotation", "level", "arm", "pair_id", "pair_order", "candidate_rank", "row_id")


@query("training_sizes", """+ g AS (SELECT 0e0 AS level, 'baseline' AS arm UNION ALL SELECT l, a FROM (SELECT unnest([1e0, 2e0, 4e0]) AS l), (SELECT unnest(['leakage', 'matched_control']) AS a)),
t AS (SELECT seed, rotation, level, arm, row_id, label FROM asg, g WHERE row_role = 'baseline_train' UNION ALL SELECT seed, rotation, level, arm, row_id, label FROM inj)
SELECT seed, rotation, level, arm, count(*) AS n_rows, count(DISTINCT label) AS n_labels FROM t GROUP BY ALL""", ("cohort",))
def training_sizes(spark, sf):
    return _parts(spark, sf)["training"].groupBy("seed", "rotation", "level", "arm").agg(F.count("*").alias("n_rows"), F.countDistinct("label").alias("n_labels"))


@query("condition_grid", """+ g AS (SELECT unnest([0e0, 1e0, 2e0, 4e0]) AS level) SELECT 'intensity' AS experiment, level, arm, 'r-' || level::INT AS level_token, count(*) AS planned_rows
FROM g, (SELECT unnest(['baseline', 'leakage', 'matched_control']) AS arm), inv WHERE (level = 0) = (arm = 'baseline') GROUP BY ALL""", ("cohort",))
def condition_grid(spark, sf):
    inventory = ct.build_cohort(rows(spark, sf), INT)[1].agg(F.count("*").alias("planned_rows"))
    return ct.condition_grid(spark, INT).join(F.broadcast(inventory), F.lit(True))


@query("experiment_plan", """SELECT 'intensity' AS experiment, count(DISTINCT label) AS eligible_labels, count(*) AS eligible_clusters, sum(available_rows)::BIGINT AS available_rows,
(SELECT sum(q)::BIGINT FROM (SELECT DISTINCT label, q FROM inv)) AS evaluation_clusters, (SELECT sum(q)::BIGINT FROM (SELECT DISTINCT label, q FROM inv)) AS donor_clusters, 10 AS cells, 70 AS fits FROM inv""", ("cohort",))
def experiment_plan(spark, sf):
    return ct.plan_counts(ct.build_cohort(rows(spark, sf), INT)[1], INT, len(SEEDS))


@query("assignment_violations", """+ bad AS (SELECT * REPLACE (CASE WHEN row_role = 'evaluation_query' AND row_id % 40 = 0 THEN 'same_cluster_candidate' ELSE row_role END AS row_role, CASE WHEN cluster_role = 'baseline_train' AND row_id % 300 = 0 THEN 'donor' ELSE cluster_role END AS cluster_role) FROM asg),
per AS (SELECT experiment, seed, rotation, cluster_id, count(DISTINCT cluster_role) AS roles, min(cluster_role) AS role, sum((row_role = 'evaluation_query')::INT) AS qn, sum((row_role = 'same_cluster_candidate')::INT) AS sn FROM bad GROUP BY ALL)
SELECT experiment, seed, rotation, cluster_id::VARCHAR AS item, 'cluster in several roles' AS rule FROM per WHERE roles > 1
UNION ALL SELECT experiment, seed, rotation, cluster_id::VARCHAR, 'not exactly one query' FROM per WHERE role = 'evaluation' AND qn <> 1
UNION ALL SELECT experiment, seed, rotation, cluster_id::VARCHAR, 'candidate count' FROM per WHERE role = 'evaluation' AND sn <> 4""", ("cohort",))
def assignment_violations(spark, sf):
    parts = _parts(spark, sf)
    a = durable(parts["assignments"])
    bad = a.select(
        *[c for c in a.columns if c not in ("row_role", "cluster_role")],
        F.when((F.col("row_role") == "evaluation_query") & (F.col("row_id") % 40 == 0), "same_cluster_candidate").otherwise(F.col("row_role")).alias("row_role"),
        F.when((F.col("cluster_role") == "baseline_train") & (F.col("row_id") % 300 == 0), "donor").otherwise(F.col("cluster_role")).alias("cluster_role"),
    )
    return ct.assignment_violations(bad, durable(parts["pairs"]), INT)


@query("condition_violations", """+ bad AS (SELECT * REPLACE (CASE WHEN arm = 'leakage' AND row_id % 70 = 0 THEN 'matched_control' ELSE arm END AS arm) FROM inj)
SELECT 'intensity' AS experiment, seed, rotation, level, '' AS item, 'arms differ in size' AS rule FROM bad GROUP BY seed, rotation, level HAVING sum((arm = 'leakage')::INT) <> sum((arm <> 'leakage')::INT)
UNION ALL SELECT 'intensity', seed, rotation, level, label, 'arms differ in composition' FROM bad GROUP BY seed, rotation, level, label HAVING sum((arm = 'leakage')::INT) <> sum((arm <> 'leakage')::INT)""", ("cohort",))
def condition_violations(spark, sf):
    parts = _parts(spark, sf)
    bad = parts["injected"].withColumn("arm", F.when((F.col("arm") == "leakage") & (F.col("row_id") % 70 == 0), "matched_control").otherwise(F.col("arm")))
    return ct.condition_violations(bad, parts["assignments"])


# ------------------------------------------------------------------ contrasts on derived predictions

define("armp", """lbn AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS li, count(*) OVER () AS lk FROM (SELECT DISTINCT label FROM coh)),
apr AS (SELECT experiment, seed, rotation, level, 'r-' || level::INT AS level_token, pair_id, row_id, cluster_id, a.label, arm,
  (row_id * 7919 + seed * 31 + rotation * 131 + CAST(level AS BIGINT) * 17 + CASE arm WHEN 'leakage' THEN 0 ELSE 5 END) % 1009 AS u FROM asg a, (SELECT unnest([1e0, 2e0, 4e0]) AS level), (SELECT unnest(['leakage', 'matched_control']) AS arm) WHERE row_role = 'evaluation_query'),
arm_p AS (SELECT p.experiment, p.seed, p.rotation, p.level, p.level_token, p.pair_id, p.row_id, p.cluster_id, p.label, p.arm, l.label AS predicted FROM apr p JOIN lbn l ON CASE WHEN u % 100 < CASE arm WHEN 'leakage' THEN 80 ELSE 65 END THEN p.label = l.label ELSE u % l.lk = l.li END),
pdp AS (SELECT experiment, seed, rotation, level, level_token, pair_id, row_id, cluster_id, label, max(predicted) FILTER (arm = 'leakage') AS predicted_leakage, max(predicted) FILTER (arm <> 'leakage') AS predicted_control FROM arm_p GROUP BY ALL)""", ("cohort",))


def arm_predictions(spark, sf):
    queries = durable(_parts(spark, sf)["assignments"].filter("row_role = 'evaluation_query'"))
    names = sorted(r["label"] for r in queries.select("label").distinct().collect())
    grid = queries.withColumn("level", F.explode(F.array(*[F.lit(x) for x in (1.0, 2.0, 4.0)]))).withColumn(
        "arm", F.explode(F.array(F.lit("leakage"), F.lit("matched_control"))))
    leak = F.col("arm") == "leakage"
    u = (F.col("row_id") * 7919 + F.col("seed") * 31 + F.col("rotation") * 131 + F.col("level").cast("bigint") * 17 + F.when(leak, 0).otherwise(5)) % 1009
    predicted = F.when(u % 100 < F.when(leak, 80).otherwise(65), F.col("label")).otherwise(F.get(F.array(*[F.lit(n) for n in names]), (u % len(names)).cast("int")))
    return grid.select("experiment", "seed", "rotation", "level", F.concat(F.lit("r-"), F.col("level").cast("int").cast("string")).alias("level_token"),
                       "pair_id", "row_id", "cluster_id", "label", "arm", predicted.alias("predicted"))


@query("paired_predictions", "SELECT * FROM pdp", ("armp",))
def paired_predictions(spark, sf):
    return ct.pair_predictions(arm_predictions(spark, sf))


CK = "experiment, seed, rotation, level, level_token"


@query("cell_contrasts", "+ " + f1_sql("cl", "pdp", CK, pred="predicted_leakage") + ",\n" + f1_sql("cc", "pdp", CK, pred="predicted_control") + f""",
n AS (SELECT {CK}, count(*) AS n_pairs FROM pdp GROUP BY ALL)
SELECT {CK}, n_pairs, round(cl.macro_f1, 6) AS macro_f1_leakage, round(cc.macro_f1, 6) AS macro_f1_control, round(cl.macro_f1 - cc.macro_f1, 6) AS macro_f1_delta, round(cl.accuracy, 6) AS accuracy_leakage, round(cc.accuracy, 6) AS accuracy_control,
round(cl.accuracy - cc.accuracy, 6) AS accuracy_delta FROM n JOIN cl USING ({CK}) JOIN cc USING ({CK})""", ("armp",))
def cell_contrasts(spark, sf):
    out = ct.cell_contrasts(ct.pair_predictions(arm_predictions(spark, sf)))
    return rounded(out, *[c for c in out.columns if c.startswith(("macro", "acc"))])


@query("condition_scores", "+ " + f1_sql("f", "arm_p", "experiment, seed, rotation, level, arm") + "\nSELECT experiment, seed, rotation, level, arm, round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy FROM f", ("armp",))
def condition_scores(spark, sf):
    return rounded(ct.condition_scores(arm_predictions(spark, sf)).select("experiment", "seed", "rotation", "level", "arm", "macro_f1", "accuracy"), "macro_f1", "accuracy")


define("bootc", f"""bcl AS (SELECT DISTINCT experiment, level, level_token, label, cluster_id FROM pdp),
bcn AS (SELECT *, row_number() OVER (PARTITION BY experiment, level, level_token, label ORDER BY sha256(cluster_id::VARCHAR), cluster_id) - 1 AS i, count(*) OVER (PARTITION BY experiment, level, level_token, label) AS k FROM bcl),
bcd AS (SELECT experiment, level, level_token, label, b AS replicate, {hash8('8', 'b', 'experiment', "level::DECIMAL(3,1)", 'level_token', 'label', 'i')} % k AS i FROM bcn, range({B}) AS r(b)),
bcx AS (SELECT d.experiment, d.level, d.level_token, d.replicate, p.label, p.predicted_leakage, p.predicted_control FROM bcd d JOIN bcn n USING (experiment, level, level_token, label, i) JOIN pdp p ON p.level = n.level AND p.cluster_id = n.cluster_id),
""" + f1_sql("bl", "bcx", "experiment, level, level_token, replicate", pred="predicted_leakage") + ",\n" + f1_sql("bk", "bcx", "experiment, level, level_token, replicate", pred="predicted_control"), ("armp",))


@query("contamination_replicates", """SELECT level_token, replicate, round(bl.macro_f1, 6) AS macro_f1_leakage, round(bk.macro_f1, 6) AS macro_f1_control, round(bl.macro_f1 - bk.macro_f1, 6) AS macro_f1_delta, round(bl.accuracy - bk.accuracy, 6) AS accuracy_delta
FROM bl JOIN bk USING (experiment, level, level_token, replicate)""", ("bootc",))
def contamination_replicates(spark, sf):
    out = ct.cluster_bootstrap(durable(ct.pair_predictions(arm_predictions(spark, sf))), B, 8)
    return rounded(out.select("level_token", "replicate", "macro_f1_leakage", "macro_f1_control", "macro_f1_delta", "accuracy_delta"),
                   "macro_f1_leakage", "macro_f1_control", "macro_f1_delta", "accuracy_delta")


@query("contamination_intervals", """+ u AS (SELECT level_token, bl.macro_f1 - bk.macro_f1 AS v FROM bl JOIN bk USING (experiment, level, level_token, replicate)), """
       + f1_sql("pl", "pdp", "level_token", pred="predicted_leakage") + ",\n" + f1_sql("pc", "pdp", "level_token", pred="predicted_control") + f"""
SELECT level_token, 'macro_f1_delta' AS metric, round(any_value(pl.macro_f1 - pc.macro_f1), 6) AS estimate, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high, CAST({B} AS BIGINT) AS replicates
FROM u JOIN pl USING (level_token) JOIN pc USING (level_token) GROUP BY level_token""", ("bootc",))
def contamination_intervals(spark, sf):
    out = study.aggregate(durable(arm_predictions(spark, sf)), B, 8)["intervals"].filter("metric = 'macro_f1_delta'")
    return rounded(out.select("level_token", "metric", "estimate", "ci_low", "ci_high", "replicates"), "estimate", "ci_low", "ci_high")


# ------------------------------------------------------------------ dose response and the composed study

define("dose", """dr AS (SELECT row_id, cluster_id, label, 3 AS seed, cluster_id % 2 AS fold FROM rows_),
dk AS (SELECT *, row_number() OVER (PARTITION BY seed, fold, cluster_id ORDER BY sha256(concat_ws('|', seed, fold, row_id)), row_id) AS r, count(*) OVER (PARTITION BY seed, fold, cluster_id) AS n FROM dr)""", ("rows_",))


def _dose(spark, sf):
    base = rows(spark, sf).select("row_id", "cluster_id", "label", F.lit(3).alias("seed"), (F.col("cluster_id") % 2).alias("fold"))
    return ct.dose_plan(base, (0.0, 0.25, 0.5, 0.75, 1.0))


@query("dose_evaluation", "SELECT fold, row_id, cluster_id FROM dk WHERE n >= 2 AND r = 1", ("dose",))
def dose_evaluation(spark, sf):
    return _dose(spark, sf)[0].select("fold", "row_id", "cluster_id")


@query("dose_injections", "SELECT fold, dose, row_id FROM dk, (SELECT unnest([0e0, 0.25e0, 0.5e0, 0.75e0, 1e0]) AS dose) WHERE r > 1 AND dose > 0 AND r - 1 <= ceil((n - 1) * dose)", ("dose",))
def dose_injections(spark, sf):
    return _dose(spark, sf)[1].select("fold", "dose", "row_id")


def vector_study(spark, sf):
    v = vectors(spark, sf)
    parts = study.prepare(v.drop("vector"), VEC, SEEDS, exact=False, check=False)
    parts = {k: durable(p) if k in ("assignments", "training") else p for k, p in parts.items()}
    return study.predict(parts, explode_vectors(v, "vector", ["row_id"]))


@query("contamination_study")
def contamination_study(spark, sf):
    """Centroid fit and prediction for every cell, then the paired contrasts."""
    out = ct.cell_contrasts(ct.pair_predictions(durable(vector_study(spark, sf))))
    return rounded(out, *[c for c in out.columns if c.startswith(("macro", "acc"))])
