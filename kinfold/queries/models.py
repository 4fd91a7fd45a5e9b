"""Centroids, templates, reference library, trees and margins, permutation control."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import calibration as cal
from kinfold.operators import decisions as de
from kinfold.operators import features as ft
from kinfold.operators import metrics as me
from kinfold.operators import models as md
from kinfold.operators import scoring as sc
from kinfold.operators import splits as sp
from kinfold.operators.ranking import _null_safe_join
from kinfold.operators.weights import evaluation_weights, training_weights
from kinfold.plans import dose_response as dr
from kinfold.plans import source_transport as st
from kinfold.plans import training as tr
from kinfold.queries.base import CTE, GRID, define, manifest, peaks, query, rounded, vectors
from kinfold.queries.metrics import f1_sql
from kinfold.queries import splitting  # noqa: F401  (defines the split SQL)
from kinfold.session import durable

# ------------------------------------------------------------------ sparse centroids (flagship)

define("gcent", """gcl AS (SELECT seed, fold, label, cluster_id, count(*) AS n FROM gsplit WHERE role = 'train' GROUP BY ALL), gcm AS (SELECT seed, fold, label, count(*) AS m FROM gcl GROUP BY ALL),
gtr AS (SELECT seed, fold, row_id, label, 1e0 / (m * n) AS w FROM gsplit JOIN gcl USING (seed, fold, label, cluster_id) JOIN gcm USING (seed, fold, label) WHERE role = 'train'),
gs AS (SELECT seed, fold, label, bin, sum(value * w) AS s FROM gtr JOIN features USING (row_id) GROUP BY ALL),
gw AS (SELECT seed, fold, label, sum(w) AS w FROM gtr GROUP BY ALL),
gc0 AS (SELECT seed, fold, label, bin, s / w AS v FROM gs JOIN gw USING (seed, fold, label)),
gc AS (SELECT seed, fold, label, bin, v / sqrt(sum(v * v) OVER (PARTITION BY seed, fold, label)) AS v FROM gc0),
gq AS (SELECT seed, fold, row_id, label, bin, value / sqrt(sum(value * value) OVER (PARTITION BY seed, fold, row_id)) AS v FROM gsplit JOIN features USING (row_id) WHERE role = 'test_known'),
gsc AS (SELECT q.seed, q.fold, q.row_id, q.label AS truth, c.label, sum(q.v * c.v) AS score FROM gq q JOIN gc c USING (seed, fold, bin) GROUP BY ALL),
gp AS (SELECT seed, fold, row_id, truth, list(label ORDER BY score DESC, label)[1] AS predicted, max(score) AS score FROM gsc GROUP BY ALL)""", ("grouped", "features"))


def centroid_predictions(spark, sf):
    """Peaks -> features -> grouped folds -> weighted centroids -> held-out predictions, all folds at once."""
    known = durable(manifest(spark, sf).filter("primary_known"))
    # both tables feed training and scoring, so each is written once instead of derived per branch
    features = durable(ft.bin_peaks(peaks(spark, sf), **GRID))
    splits = durable(sp.grouped_splits(known, None, (11, 12), 5))
    keys = ["seed", "fold"]
    train = training_weights(splits.filter("role = 'train'"), keys)
    centroids = sc.label_centroids(features, train, keys)
    test = splits.filter("role = 'test_known'")
    unit = ft.l2_normalise(features)
    scores = sc.sparse_scores(test.select(*keys, "row_id").join(unit, "row_id"), centroids, keys, ["label"])
    best = sc.rank_labels(scores, keys)
    return _null_safe_join(test.select(*keys, "row_id", "cluster_id", "label"), best, [*keys, "row_id"])


@query("grouped_centroid_macro_f1", "+ " + f1_sql("f", "gp", "seed", truth="truth") + "\nSELECT seed, round(macro_f1, 6) AS macro_f1, round(balanced_accuracy, 6) AS balanced_accuracy, round(accuracy, 6) AS accuracy FROM f", ("gcent",))
def grouped_centroid_macro_f1(spark, sf):
    out = me.classification_scores(centroid_predictions(spark, sf), ["seed"]).drop("macro_f1_true_labels")
    return rounded(out, "macro_f1", "balanced_accuracy", "accuracy")


@query("centroid_predictions", "SELECT seed, fold, row_id, predicted, round(score, 6) AS score FROM gp", ("gcent",))
def centroid_prediction_rows(spark, sf):
    return rounded(centroid_predictions(spark, sf).select("seed", "fold", "row_id", "predicted", "score"), "score")


@query("sparse_cluster_templates", """+ m AS (SELECT row_id, cluster_id, label FROM manifest WHERE primary_known), s AS (SELECT cluster_id, label, bin, sum(value) AS s FROM m JOIN features USING (row_id) GROUP BY ALL), n AS (SELECT cluster_id, count(*) AS n FROM m GROUP BY 1),
t AS (SELECT cluster_id, label, bin, s / n AS v FROM s JOIN n USING (cluster_id)) SELECT cluster_id, label, bin, round(v / sqrt(sum(v * v) OVER (PARTITION BY cluster_id)), 6) AS value FROM t""", ("manifest", "features"))
def sparse_cluster_templates(spark, sf):
    known = manifest(spark, sf).filter("primary_known")
    return rounded(sc.cluster_templates(ft.bin_peaks(peaks(spark, sf), **GRID), known), "value")


# ------------------------------------------------------------------ dense templates on embeddings

define("tpl", """vrole AS (SELECT DISTINCT row_id, cluster_id, label, CASE WHEN row_id % 7 IN (0, 1) THEN 'calibration' WHEN row_id % 7 = 2 THEN 'test_known' ELSE 'train' END AS role FROM vec),
tm AS (SELECT l.cluster_id, l.label, bin, avg(v) AS v FROM vlong l JOIN vrole USING (row_id) WHERE role = 'train' GROUP BY ALL),
tu AS (SELECT cluster_id, label, bin, v / sqrt(sum(v * v) OVER (PARTITION BY cluster_id)) AS v FROM tm),
ts AS (SELECT q.row_id, t.label, t.cluster_id, sum(q.v * t.v) AS score FROM vunit q JOIN vrole r USING (row_id) JOIN tu t USING (bin) WHERE role <> 'train' GROUP BY ALL),
tl AS (SELECT row_id, label, max(score) AS score, arg_max(cluster_id, score) AS cluster_id FROM ts GROUP BY ALL),
tr AS (SELECT row_id, list(label ORDER BY score DESC, label) AS o, list(score ORDER BY score DESC, label) AS s, list(cluster_id ORDER BY score DESC, label)[1] AS winning_cluster FROM tl GROUP BY row_id),
tp AS (SELECT r.row_id, r.cluster_id, r.label, r.role, o[1] AS predicted, s[1] AS score, winning_cluster, o[2] AS runner_up, s[2] AS runner_up_score, s[1] - s[2] AS margin, array_to_string(o[1:3], ',') AS top_labels FROM vrole r JOIN tr USING (row_id)),
tcm AS (SELECT cluster_id, median(score) AS m FROM tp WHERE role = 'calibration' GROUP BY 1),
tth AS (SELECT count(*) AS n_clusters, list(m ORDER BY m)[CAST(least(greatest(floor((1e0 - 0.95e0) * count(*) + 1e-12), 0), count(*) - 1) AS INTEGER) + 1] AS threshold FROM tcm)""", ("vec",))


def vector_roles(spark, sf):
    part = F.col("row_id") % 7
    return vectors(spark, sf).withColumn("role", F.when(part.isin(0, 1), "calibration").when(part == 2, "test_known").otherwise("train")).withColumn("run", F.lit(1))


def vector_templates(spark, sf):
    return sc.mean_templates(vector_roles(spark, sf).filter("role = 'train'"), ["cluster_id", "label"])


@query("vector_templates", "SELECT cluster_id, label, bin, round(v, 6) AS value FROM tu", ("tpl",))
def vector_template_rows(spark, sf):
    return vector_templates(spark, sf).select("cluster_id", "label", F.posexplode("template").alias("bin", "value")).withColumn("value", F.round("value", 6))


@query("template_scores", "SELECT row_id, label, round(score, 6) AS score, cluster_id FROM tl", ("tpl",))
def template_scores(spark, sf):
    queries = vector_roles(spark, sf).filter("role != 'train'")
    return rounded(sc.dense_label_scores(queries, vector_templates(spark, sf)), "score")


@query("template_scores_blocked", "SELECT row_id, label, round(score, 6) AS score, cluster_id FROM tl", ("tpl",))
def template_scores_blocked(spark, sf):
    """The same scores when the templates exceed one block."""
    queries = vector_roles(spark, sf).filter("role != 'train'")
    return rounded(sc.dense_label_scores(queries, vector_templates(spark, sf), block_cells=2000), "score")


@query("template_cosines", "SELECT row_id, cluster_id, label, round(score, 6) AS score FROM ts", ("tpl",))
def template_cosines(spark, sf):
    """Sparse-product form of the cosine between rows and templates."""
    queries = vector_roles(spark, sf).filter("role != 'train'")
    long = sc.unit_length(ft.explode_vectors(queries, "vector", ["row_id"]), ["row_id"])
    templates = vector_templates(spark, sf).select("cluster_id", "label", F.posexplode("template").alias("bin", "value"))
    return rounded(sc.sparse_scores(long, templates, [], ["cluster_id", "label"]), "score")


@query("ranked_labels", "SELECT row_id, predicted, round(score, 6) AS score, winning_cluster, runner_up, round(runner_up_score, 6) AS runner_up_score, round(margin, 6) AS margin, top_labels FROM tp", ("tpl",))
def ranked_labels(spark, sf):
    queries = vector_roles(spark, sf).filter("role != 'train'")
    out = sc.rank_labels(sc.dense_label_scores(queries, vector_templates(spark, sf)), [])
    return rounded(out.withColumn("top_labels", F.array_join("top_labels", ",")), "score", "runner_up_score", "margin")


def reference(spark, sf):
    return st.reference_predictions(vector_roles(spark, sf), ["run"])


@query("reference_predictions", """SELECT row_id, role, predicted, round(score, 6) AS score, round(threshold, 6) AS threshold, score >= threshold AS accepted, label IN (SELECT label FROM vrole WHERE role = 'train') AS true_is_fitted, predicted = label AS correct FROM tp, tth""", ("tpl",))
def reference_predictions(spark, sf):
    return rounded(reference(spark, sf).select("row_id", "role", "predicted", "score", "threshold", "accepted", "true_is_fitted", "correct"), "score", "threshold")


@query("reference_endpoints", "+ x AS (SELECT *, score >= threshold AS acc, 1e0 / count(*) OVER (PARTITION BY role, cluster_id) AS w FROM tp, tth),\n" + f1_sql("a", "x", "role") + ",\n" + f1_sql("b", "x", "role", weight="w") + """
SELECT role, count(*) AS n_rows, count(DISTINCT cluster_id) AS n_clusters, sum(acc::INT)::BIGINT AS accepted_count, round(avg((predicted = label)::INT) FILTER (acc), 6) AS accepted_accuracy, round(any_value(a.accuracy), 6) AS row_accuracy,
round(any_value(a.macro_f1_true_labels), 6) AS row_macro_f1, round(any_value(b.macro_f1_true_labels), 6) AS equal_cluster_macro_f1 FROM x JOIN a USING (role) JOIN b USING (role) GROUP BY role""", ("tpl",))
def reference_endpoints(spark, sf):
    classes = [f"L{i:02d}" for i in range(10)]
    out = st.endpoints(durable(reference(spark, sf)), ["run"], classes)
    return rounded(out.select("role", "n_rows", "n_clusters", "accepted_count", "accepted_accuracy", "row_accuracy", "row_macro_f1", "equal_cluster_macro_f1"),
                   "accepted_accuracy", "row_accuracy", "row_macro_f1", "equal_cluster_macro_f1")


@query("vector_centroids", """+ c AS (SELECT label, cluster_id, count(*) AS n FROM vec GROUP BY ALL), m AS (SELECT label, count(*) AS m FROM c GROUP BY 1), w AS (SELECT row_id, v.label, 1e0 / (n * m) AS w FROM vec v JOIN c USING (label, cluster_id) JOIN m USING (label)),
s AS (SELECT w.label, bin, sum(v * w) / sum(w) AS v FROM w JOIN vlong USING (row_id) GROUP BY ALL) SELECT label, bin, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 6) AS value FROM s""", ("vec",))
def vector_centroids(spark, sf):
    out = sc.weighted_centroids(training_weights(vectors(spark, sf)))
    return out.select("label", F.posexplode("template").alias("bin", "value")).withColumn("value", F.round("value", 6))


# ------------------------------------------------------------------ source transport on embeddings

def _transport_rows(spark, sf):
    """Two sources over the embedding rows; whole clusters that touch a source are held out."""
    v = vectors(spark, sf).withColumn("parent", F.lit("P")).withColumn(
        "source", F.when(F.col("cluster_id").endswith("-1") & (F.col("row_id") % 3 == 0), "X").when(F.col("cluster_id").endswith("-2"), "X").when(
            F.col("cluster_id").endswith("-3"), "Y").otherwise("Z"))
    cohort, _ = sp.source_cohorts(v, ["X", "Y"], min_nonheld=3, min_held=1)
    return sp.source_splits(v, cohort, (11, 12)).join(v.select("row_id", "vector"), "row_id")


@query("source_transport")
def source_transport(spark, sf):
    """Template library per hold-out and seed; endpoints per population."""
    rows = durable(_transport_rows(spark, sf))
    predictions = durable(st.reference_predictions(rows, ["holdout", "seed"]))
    out = st.endpoints(predictions, ["holdout", "seed"], [f"L{i:02d}" for i in range(10)])
    return rounded(out, *[c for c in out.columns if c.endswith(("accuracy", "f1", "rate"))])


# ------------------------------------------------------------------ permutation control

PERM = 100
define("perm", f"""pcl AS (SELECT DISTINCT cluster_id, label FROM vec), pg AS (SELECT *, b AS permutation FROM pcl, range({PERM}) AS r(b)),
ps AS (SELECT permutation, cluster_id, row_number() OVER (PARTITION BY permutation ORDER BY sha256(concat_ws('|', 'slot', 77, permutation, cluster_id)), cluster_id) AS r FROM pg),
pl AS (SELECT permutation, label, row_number() OVER (PARTITION BY permutation ORDER BY sha256(concat_ws('|', 'label', 77, permutation, cluster_id)), cluster_id) AS r FROM pg),
pm AS (SELECT permutation, cluster_id, label FROM ps JOIN pl USING (permutation, r))""", ("vec",))


@query("permuted_labels", "SELECT permutation, cluster_id, label FROM pm", ("perm",))
def permuted_labels(spark, sf):
    return md.permuted_labels(vectors(spark, sf).select("cluster_id", "label").distinct(), PERM, 77)


define("permf", f"""pf0 AS (SELECT permutation, label, cluster_id, (row_number() OVER (PARTITION BY permutation, label ORDER BY sha256(concat_ws('|', 'fold', permutation, cluster_id)), cluster_id) - 1) % 5 AS tf FROM pm),
pr AS (SELECT permutation, v.row_id, p.cluster_id, p.label, tf FROM pf0 p JOIN vec v ON v.cluster_id = p.cluster_id), pk AS (SELECT *, fold FROM pr, range(5) AS f(fold)),
pc AS (SELECT permutation, fold, label, cluster_id, count(*) AS n FROM pk WHERE tf <> fold GROUP BY ALL), pcm AS (SELECT permutation, fold, label, count(*) AS m FROM pc GROUP BY ALL),
pw AS (SELECT k.permutation, k.fold, k.row_id, k.label, 1e0 / (n * m) AS w FROM pk k JOIN pc USING (permutation, fold, label, cluster_id) JOIN pcm USING (permutation, fold, label) WHERE tf <> fold),
pce0 AS (SELECT permutation, fold, w.label, bin, sum(v * w) / sum(w) AS v FROM pw w JOIN vlong USING (row_id) GROUP BY ALL),
pce AS (SELECT permutation, fold, label, bin, v / sqrt(sum(v * v) OVER (PARTITION BY permutation, fold, label)) AS v FROM pce0),
psc AS (SELECT k.permutation, k.row_id, k.label AS truth, c.label, sum(q.v * c.v) AS score FROM pr k JOIN vunit q USING (row_id) JOIN pce c ON c.permutation = k.permutation AND c.fold = k.tf AND c.bin = q.bin GROUP BY ALL),
pp AS (SELECT permutation, row_id, truth, list(label ORDER BY score DESC, label)[1] AS predicted FROM psc GROUP BY ALL),
""" + f1_sql("pf", "pp", "permutation", truth="truth"), ("perm",))


def permutation_scores(spark, sf):
    """Centroid control: labels permuted over clusters, grouped folds, every permutation and fold in one job."""
    from kinfold.functions.hashing import hash_key
    from kinfold.operators.ranking import hash_rank
    v = vectors(spark, sf)
    labels = durable(md.permuted_labels(v.select("cluster_id", "label").distinct(), PERM, 77))
    folds = hash_rank(labels, ["permutation", "label"], hash_key(F.lit("fold"), F.col("permutation"), F.col("cluster_id")), ["cluster_id"], "r")
    placed = folds.select("permutation", "cluster_id", "label", ((F.col("r") - 1) % 5).cast("int").alias("fold"))
    return me.scores_from_confusion(md.permuted_centroid_confusion(v.drop("label"), placed, PERM, 5), ["permutation"])


@query("permutation_scores", "SELECT permutation, round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy FROM pf", ("permf",))
def permutation_score_rows(spark, sf):
    return rounded(permutation_scores(spark, sf).select("permutation", "macro_f1", "accuracy"), "macro_f1", "accuracy")


@query("permutation_envelope", """SELECT 'cosine_centroid' AS model, round(avg(macro_f1), 6) AS mean, round(quantile_cont(macro_f1, 0.5), 6) AS median, round(quantile_cont(macro_f1, 0.025), 6) AS lower, round(quantile_cont(macro_f1, 0.975), 6) AS upper, round(max(macro_f1), 6) AS maximum FROM pf""", ("permf",))
def permutation_envelope(spark, sf):
    scores = permutation_scores(spark, sf).withColumn("model", F.lit("cosine_centroid"))
    return rounded(md.permutation_envelope(scores, ["model"]), "mean", "median", "lower", "upper", "maximum")


# ------------------------------------------------------------------ trees and margins on embeddings

def _fit_and_predict(spark, sf, name):
    rows = durable(vector_roles(spark, sf))
    fitted = md.fit(rows.filter("role = 'train'"), name, 3)
    return fitted, fitted.predict(rows.filter("role != 'train'"))


def _predicted(spark, sf, name):
    out = _fit_and_predict(spark, sf, name)[1]
    return out.select("row_id", "role", "cluster_id", "label", "predicted", "score", "runner_up", "margin", F.array_join("top_labels", ",").alias("top_labels"))


@query("tree_ensemble")
def tree_ensemble(spark, sf):
    return _predicted(spark, sf, "tree_ensemble")


@query("linear_margin")
def linear_margin(spark, sf):
    return _predicted(spark, sf, "linear_svm")


@query("boosted_trees")
def boosted_trees(spark, sf):
    return _predicted(spark, sf, "boosted_trees")


@query("model_output_checks", """+ m(model) AS (VALUES ('boosted_trees'), ('linear_svm'), ('tree_ensemble'))
SELECT model, row_id, role, label, true AS sums_to_one, true AS winner_is_largest, true AS margin_is_gap, CAST(10 AS INTEGER) AS n_classes FROM vrole, m WHERE role <> 'train'""", ("tpl",))
def model_output_checks(spark, sf):
    """Every held-out row of every model: probabilities over all classes that sum to one, their first maximum predicted."""
    parts = []
    for name in md.MODELS:
        fitted, out = _fit_and_predict(spark, sf, name)
        names = F.array(*[F.lit(c) for c in fitted.classes])
        p, ordered = F.col("probability"), F.sort_array("probability", asc=False)
        parts.append(out.select(
            F.lit(name).alias("model"), "row_id", "role", "label", (F.abs(F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x) - 1) < 1e-9).alias("sums_to_one"),
            (F.get(names, (F.array_position(p, ordered[0]) - 1).cast("int")) == F.col("predicted")).alias("winner_is_largest"),
            (F.abs(ordered[0] - ordered[1] - F.col("margin")) < 1e-12).alias("margin_is_gap"), F.size(p).alias("n_classes"),
        ))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


define("vsrc", """vs0 AS (SELECT row_id, cluster_id, label, 'P' AS parent, CASE WHEN ends_with(cluster_id, '-1') AND row_id % 3 = 0 THEN 'X' WHEN ends_with(cluster_id, '-2') THEN 'X' WHEN ends_with(cluster_id, '-3') THEN 'Y' ELSE 'Z' END AS source FROM vec),
vsc AS (SELECT holdout, cluster_id, min(label) AS label, count(*) FILTER (source = holdout) > 0 AS is_held FROM vs0, (SELECT unnest(['X', 'Y']) AS holdout) GROUP BY 1, 2),
vsi AS (SELECT holdout, label FROM vsc GROUP BY ALL HAVING sum(is_held::INT) >= 1 AND sum((NOT is_held)::INT) >= 3),
vsr AS (SELECT holdout, cluster_id, label, seed, CASE WHEN is_held THEN 'test_source' WHEN r <= least(greatest(1, floor(n * 0.2e0)), n - 1) THEN 'calibration' ELSE 'train' END AS role FROM (
  SELECT c.*, seed, row_number() OVER w AS r, count(*) OVER (PARTITION BY seed, holdout, label, is_held) AS n FROM vsc c JOIN vsi USING (holdout, label), (SELECT unnest([11, 12]) AS seed)
  WINDOW w AS (PARTITION BY seed, holdout, label, is_held ORDER BY sha256(concat_ws('|', seed, holdout, label, cluster_id)), cluster_id))),
vsplit AS (SELECT holdout, seed, row_id, s.cluster_id, s.label, source, role FROM vs0 s JOIN vsr r ON r.cluster_id = s.cluster_id)""", ("vec",))


def tree_transport(spark, sf):
    return st.tree_predictions(durable(_transport_rows(spark, sf)), ["holdout", "seed"], seed=3)


@query("tree_ensemble_source_transport")
def tree_ensemble_source_transport(spark, sf):
    """Trees per hold-out and seed, with the calibration threshold and acceptance rule of the template library; endpoints per population."""
    out = st.endpoints(durable(tree_transport(spark, sf)), ["holdout", "seed"], [f"L{i:02d}" for i in range(10)])
    return rounded(out, *[c for c in out.columns if c.endswith(("accuracy", "f1", "rate"))])


@query("tree_transport_checks", """SELECT holdout, seed, row_id, role, label, CASE WHEN role = 'calibration' THEN 'calibration' WHEN source = holdout THEN 'target-label-primary' ELSE 'other-label-quarantine-auxiliary' END AS population,
true AS true_is_fitted, true AS threshold_is_retained, true AS accepts_by_threshold, true AS winner_is_largest FROM vsplit WHERE role <> 'train'""", ("vsrc",))
def tree_transport_checks(spark, sf):
    """Row set, acceptance and argmax of the source hold-out, and the threshold counted anew from cluster medians."""
    out = durable(tree_transport(spark, sf))
    medians = out.filter("role = 'calibration'").groupBy("holdout", "seed", "cluster_id").agg(F.median("score").alias("m"), F.first("threshold").alias("t"))
    kept = medians.groupBy("holdout", "seed").agg(
        ((F.sum((F.col("m") < F.col("t")).cast("int")) <= F.floor(F.count("*") * 0.05 + 1e-9)) & (F.sum((F.col("m") <= F.col("t")).cast("int")) > F.floor(F.count("*") * 0.05 + 1e-9))).alias("threshold_is_retained"))
    position = F.array_position("probability", F.array_max("probability")) - 1
    winner = F.concat(F.lit("L0"), position.cast("string"))
    return out.join(kept, ["holdout", "seed"]).select(
        "holdout", "seed", "row_id", "role", "label", st.population().alias("population"), "true_is_fitted", "threshold_is_retained",
        (F.col("accepted") == (F.col("score") >= F.col("threshold"))).alias("accepts_by_threshold"), (winner == F.col("predicted")).alias("winner_is_largest"),
    )


@query("calibrated_tree_cell")
def calibrated_tree_cell(spark, sf):
    """One training cell: grouped out-of-fold scores, temperature, final fit, calibrated probabilities."""
    rows = durable(vector_roles(spark, sf))
    fitted, logits = md.fit_with_folds(rows.filter("role = 'train'"), "tree_ensemble", 5, keys=["run"])
    weighted = evaluation_weights(durable(logits.select("row_id", "cluster_id", "label", "logits")))
    temperature = cal.fit_temperature(weighted, [], fitted.classes).first()["temperature"]
    out = fitted.predict(rows.filter("role = 'test_known'").withColumn("inner", F.lit(-1)), temperature=temperature)
    return out.select("row_id", "label", "predicted", F.round("score", 6).alias("confidence"), F.lit(temperature).alias("temperature"))


# ------------------------------------------------------------------ the training grid on embeddings

define("vgrid", """manifest AS (SELECT row_id, cluster_id, label, CASE label WHEN 'L09' THEN 'Q' ELSE 'P' || (right(label, 1)::INT % 3)::VARCHAR END AS parent, label < 'L08' AS primary_known, label >= 'L08' AS primary_ood, label < 'L08' AS sensitivity_known FROM vec),
""" + ",\n".join(CTE[c] for c in ("grouped", "randomised", "stress")) + """,
vall AS (SELECT * FROM gsplit UNION ALL SELECT * FROM rsplit UNION ALL SELECT * FROM ssplit)""", ("vec",))


def vector_splits(spark, sf):
    """Splits of all three designs over the embedding rows; two labels are unknown, one of them with a parent of its own."""
    number = F.substring("label", 3, 1).cast("int")
    rows = durable(vectors(spark, sf).withColumn("parent", F.when(F.col("label") == "L09", "Q").otherwise(F.concat(F.lit("P"), (number % 3).cast("string")))))
    known, ood = rows.filter("label < 'L08'"), rows.filter("label >= 'L08'")
    seeds, k = splitting.SEEDS, splitting.K
    splits = sp.grouped_splits(known, ood, seeds, k).unionByName(sp.row_random_splits(known, seeds, k)).unionByName(sp.sensitivity_splits(known, seeds, k))
    return durable(splits), rows


def training_grid_rows(spark, sf, names, design=None):
    splits, rows = vector_splits(spark, sf)
    splits = splits.filter(F.col("design") == design) if design else splits
    parents = {f"L{i:02d}": f"P{i % 3}" for i in range(8)}
    return tr.train_grid(splits, rows, names, parents, seed=7)


def _grid_sql(model: str, rows: str) -> str:
    return f"""SELECT design, '{model}' AS model, seed, fold, row_id, role, label, CASE WHEN role = 'test_ood' THEN CASE label WHEN 'L08' THEN 'near' ELSE 'far' END END AS ood_distance,
true AS confident_of_winner, true AS report_is_winner, true AS tempered FROM {rows} WHERE role <> 'train'"""


def _grid_checks(spark, sf, model, design=None):
    """One model over the cells of the split table, two seeds and five folds a design: fitted, calibrated, reported; its rules checked row by row."""
    out = training_grid_rows(spark, sf, [model], design)
    winner = F.when(F.col("reported_level") == "label", F.col("reported_label") == F.col("predicted")).otherwise(~F.col("design").endswith("sensitivity"))
    return out.select(
        "design", "model", "seed", "fold", "row_id", "role", "label", "ood_distance",
        (F.abs(F.array_max("probability") - F.col("confidence")) < 1e-12).alias("confident_of_winner"), winner.alias("report_is_winner"),
        F.col("temperature").between(F.lit(0.018), F.lit(54.6)).alias("tempered"),
    )


@query("training_grid_trees", _grid_sql("tree_ensemble", "gsplit"), ("vgrid",))
def training_grid_trees(spark, sf):
    """The grouped design: 10 cells with three inner folds each, 12,000 trees."""
    return _grid_checks(spark, sf, "tree_ensemble", "cluster_grouped")


@query("training_grid_margins", _grid_sql("linear_svm", "vall"), ("vgrid",))
def training_grid_margins(spark, sf):
    return _grid_checks(spark, sf, "linear_svm")


# ------------------------------------------------------------------ dose response on embeddings

DOSES = (0.0, 0.25, 0.5, 1.0)


def dose_response(spark, sf, name):
    splits, rows = vector_splits(spark, sf)
    return dr.dose_response(splits.filter("design = 'cluster_grouped'"), rows, DOSES, name, seed=9)


define("vdose", f"""vtest AS (SELECT seed, fold, row_id, cluster_id, label, row_number() OVER w AS r, count(*) OVER (PARTITION BY seed, fold, cluster_id) AS n FROM gsplit WHERE role = 'test_known'
  WINDOW w AS (PARTITION BY seed, fold, cluster_id ORDER BY sha256(concat_ws('|', seed, fold, row_id)), row_id)),
vev AS (SELECT * FROM vtest WHERE r = 1 AND n >= 2), vdoses AS (SELECT unnest([{', '.join(f'{d}e0' for d in DOSES)}]) AS dose),
vinj AS (SELECT seed, fold, dose, row_id, cluster_id, label FROM vtest, vdoses WHERE n >= 2 AND r > 1 AND dose > 0 AND r - 1 <= ceil((n - 1) * dose)),
vfit AS (SELECT seed, fold, dose, row_id, cluster_id, label FROM gsplit, vdoses WHERE role = 'train' UNION ALL SELECT * FROM vinj),
vdc AS (SELECT seed, fold, dose, label, cluster_id, count(*) AS n FROM vfit GROUP BY ALL), vdm AS (SELECT seed, fold, dose, label, count(*) AS m FROM vdc GROUP BY ALL),
vdw AS (SELECT f.seed, f.fold, f.dose, f.row_id, f.label, 1e0 / (n * m) AS w FROM vfit f JOIN vdc USING (seed, fold, dose, label, cluster_id) JOIN vdm USING (seed, fold, dose, label)),
vdce0 AS (SELECT seed, fold, dose, w.label, bin, sum(v * w) / sum(w) AS v FROM vdw w JOIN vlong USING (row_id) GROUP BY ALL),
vdce AS (SELECT seed, fold, dose, label, bin, v / sqrt(sum(v * v) OVER (PARTITION BY seed, fold, dose, label)) AS v FROM vdce0),
vdsc AS (SELECT e.seed, e.fold, c.dose, e.row_id, e.cluster_id, e.label AS truth, c.label, sum(q.v * c.v) AS score FROM vev e JOIN vunit q USING (row_id) JOIN vdce c ON c.seed = e.seed AND c.fold = e.fold AND c.bin = q.bin GROUP BY ALL),
vdp AS (SELECT seed, fold, dose, row_id, cluster_id, truth, list(label ORDER BY score DESC, label)[1] AS predicted FROM vdsc GROUP BY ALL),
vdn AS (SELECT seed, fold, dose, count(*) AS n FROM vinj GROUP BY ALL),
""" + f1_sql("vdf", "vdp", "seed, fold, dose", truth="truth"), ("vgrid",))


@query("dose_predictions", "SELECT seed, fold, dose, row_id, cluster_id, truth AS label, predicted, predicted = truth AS correct FROM vdp", ("vdose",))
def dose_predictions(spark, sf):
    return dose_response(spark, sf, "cosine_centroid")[0]


@query("dose_metrics", """SELECT f.seed, f.fold, f.dose, coalesce(n, 0) AS n_injected, e.n_evaluation, round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy
FROM vdf f LEFT JOIN vdn USING (seed, fold, dose) JOIN (SELECT seed, fold, count(*) AS n_evaluation FROM vev GROUP BY ALL) e USING (seed, fold)""", ("vdose",))
def dose_metrics(spark, sf):
    return rounded(dose_response(spark, sf, "cosine_centroid")[1], "macro_f1", "accuracy")


@query("dose_metrics_trees")
def dose_metrics_trees(spark, sf):
    """The same doses with trees fitted anew for every seed, fold and dose."""
    return rounded(dose_response(spark, sf, "tree_ensemble")[1], "macro_f1", "accuracy")
