"""Splits, weights, source hold-outs and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import audits as au
from kinfold.operators import manifest as mf
from kinfold.operators import splits as sp
from kinfold.operators import weights as wt
from kinfold.queries.base import define, joined_list, manifest, query, rounded, rows
from kinfold.session import durable
from kinfold.sources.writers import split_header

SEEDS, K = (11, 12), 5
COLS = "row_id, cluster_id, label, parent, seed, design, fold, role"

define("grouped", """known AS (SELECT row_id, cluster_id, label, parent FROM manifest WHERE primary_known),
seeds AS (SELECT unnest([11, 12]) AS seed), folds AS (SELECT unnest([0, 1, 2, 3, 4]) AS fold),
cfold AS (SELECT seed, label, cluster_id, (row_number() OVER (PARTITION BY seed, label ORDER BY sha256(concat_ws('|', seed, cluster_id)), cluster_id) - 1) % 5 AS tf
  FROM (SELECT DISTINCT label, cluster_id FROM known), seeds),
crole AS (SELECT seed, fold, label, cluster_id, CASE WHEN fold = tf THEN 'test_known' WHEN r <= CASE WHEN w >= n THEN greatest(1, n - 1) ELSE w END THEN 'calibration' ELSE 'train' END AS role
  FROM (SELECT *, row_number() OVER (PARTITION BY seed, fold, label, fold = tf ORDER BY sha256(concat_ws('|', 'calibration', seed, fold, cluster_id)), cluster_id) AS r,
  count(*) OVER (PARTITION BY seed, fold, label, fold = tf) AS n, greatest(1, ceil(count(*) OVER (PARTITION BY seed, fold, label, fold = tf) * 0.2e0)) AS w FROM cfold, folds)),
gsplit AS (SELECT row_id, cluster_id, label, parent, seed, 'cluster_grouped' AS design, fold, role FROM known JOIN crole USING (label, cluster_id)
  UNION ALL SELECT row_id, cluster_id, label, parent, seed, 'cluster_grouped', fold, 'test_ood' FROM manifest, seeds, folds WHERE primary_ood)""", ("manifest",))
define("randomised", """rfold AS (SELECT row_id, cluster_id, label, parent, seed, (row_number() OVER (PARTITION BY seed, label ORDER BY sha256(concat_ws('|', seed, row_id)), row_id) - 1) % 5 AS tf FROM known, seeds),
rsplit AS (SELECT row_id, cluster_id, label, parent, seed, 'row_random' AS design, fold, CASE WHEN fold = tf THEN 'test_known' WHEN r <= ceil(n * 0.2e0) THEN 'calibration' ELSE 'train' END AS role
  FROM (SELECT *, row_number() OVER (PARTITION BY seed, fold, label, fold = tf ORDER BY sha256(concat_ws('|', 'calibration', seed, fold, row_id)), row_id) AS r,
  count(*) OVER (PARTITION BY seed, fold, label, fold = tf) AS n FROM rfold, folds))""", ("grouped",))
define("stress", """sens AS (SELECT row_id, cluster_id, label, parent FROM manifest WHERE sensitivity_known),
sfold AS (SELECT seed, label, cluster_id, (row_number() OVER (PARTITION BY seed, label ORDER BY sha256(concat_ws('|', seed, cluster_id)), cluster_id) - 1) % 5 AS tf
  FROM (SELECT DISTINCT label, cluster_id FROM sens), seeds),
ssplit AS (SELECT row_id, cluster_id, label, parent, seed, 'cluster_grouped_sensitivity' AS design, fold, CASE WHEN fold = tf THEN 'test_known' ELSE 'train' END AS role
  FROM sens JOIN sfold USING (label, cluster_id), folds)""", ("grouped",))


def _known(spark, sf):
    m = durable(manifest(spark, sf))
    return m, m.filter("primary_known"), m.filter("primary_ood")


def grouped(spark, sf):
    _, known, ood = _known(spark, sf)
    return sp.grouped_splits(known, ood, SEEDS, K)


@query("grouped_splits", f"SELECT {COLS} FROM gsplit", ("grouped",))
def grouped_splits(spark, sf):
    return grouped(spark, sf)


@query("row_random_splits", f"SELECT {COLS} FROM rsplit", ("randomised",))
def row_random_splits(spark, sf):
    return sp.row_random_splits(_known(spark, sf)[1], SEEDS, K)


@query("sensitivity_splits", f"SELECT {COLS} FROM ssplit", ("stress",))
def sensitivity_splits(spark, sf):
    m = durable(manifest(spark, sf)).filter("sensitivity_known")
    return sp.sensitivity_splits(m, SEEDS, min(K, sp.label_shape(m).smallest_clusters))


@query("split_sizes", """+ u AS (SELECT * FROM gsplit UNION ALL SELECT * FROM rsplit UNION ALL SELECT * FROM ssplit)
SELECT design, seed, fold, role, count(*) AS n_rows, count(DISTINCT cluster_id) AS n_clusters, count(DISTINCT label) AS n_labels FROM u GROUP BY ALL""",
       ("randomised", "stress"))
def split_sizes(spark, sf):
    splits = sp.build_splits(durable(manifest(spark, sf)), SEEDS, K, check=False)
    return splits.groupBy("design", "seed", "fold", "role").agg(
        F.count("*").alias("n_rows"), F.countDistinct("cluster_id").alias("n_clusters"), F.countDistinct("label").alias("n_labels"))


@query("split_header", "SELECT '11,12' AS seeds, 'cluster_grouped' AS designs, '0,1,2,3,4' AS folds, count(*) AS assignments FROM gsplit", ("grouped",))
def split_header_row(spark, sf):
    header = split_header(grouped(spark, sf))
    as_text = lambda c: F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",").alias(c)
    return header.select(as_text("seeds"), as_text("designs"), as_text("folds"), "assignments")


@query("split_violations", """+ bad AS (SELECT * FROM gsplit UNION ALL SELECT row_id, cluster_id, label, parent, seed, design, fold, 'train' FROM gsplit WHERE role = 'test_ood' AND fold = 0 AND row_id IN (SELECT row_id FROM rows_ WHERE amount > 480000)
  UNION ALL SELECT row_id, cluster_id, label, parent, seed, design, fold, 'train' FROM gsplit WHERE role = 'test_known' AND row_id IN (SELECT row_id FROM rows_ WHERE amount > 480000))
SELECT design, seed, fold, CAST(row_id AS VARCHAR) AS item, 'repeated row' AS rule FROM bad GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT design, seed, fold, CAST(cluster_id AS VARCHAR), 'cluster in two roles' FROM bad WHERE role <> 'test_ood' GROUP BY design, seed, fold, cluster_id HAVING count(DISTINCT role) > 1
UNION ALL SELECT design, seed, fold, label, 'unknown label used for fitting' FROM bad GROUP BY design, seed, fold, label HAVING bool_or(role IN ('train', 'calibration')) AND bool_or(role = 'test_ood')""",
       ("grouped",))
def split_violations(spark, sf):
    good = grouped(spark, sf)
    large = rows(spark, sf).filter("amount > 480000").select("row_id")
    moved = good.filter("(role = 'test_ood' AND fold = 0) OR role = 'test_known'").join(large, "row_id", "left_semi").withColumn("role", F.lit("train"))
    return sp.split_violations(good.unionByName(moved))


@query("role_overlap", """+ p AS (SELECT DISTINCT seed, fold, cluster_id, role FROM rsplit)
SELECT 'row_random' AS design, a.seed, a.fold, a.role AS role_a, b.role AS role_b, count(*) AS overlap FROM p a JOIN p b USING (seed, fold, cluster_id)
WHERE a.role < b.role GROUP BY ALL""", ("randomised",))
def role_overlap(spark, sf):
    return sp.role_overlap(sp.row_random_splits(_known(spark, sf)[1], SEEDS, K))


@query("missing_split_rows", "SELECT DISTINCT l_orderkey + CASE WHEN l_quantity > 49 THEN 1000000000 ELSE 0 END AS row_id FROM lineitem WHERE l_quantity > 49")
def missing_split_rows(spark, sf):
    from kinfold.queries.base import table
    ids = table(spark, sf, "lineitem", "l_orderkey", "l_quantity").select(
        (F.col("l_orderkey") + F.when(F.col("l_quantity") > 49, 1000000000).otherwise(0)).alias("row_id"))
    return sp.missing_rows(ids, rows(spark, sf))


@query("fold_distance", """+ fit AS (SELECT DISTINCT seed, fold, parent FROM gsplit WHERE role = 'train')
SELECT g.seed, g.fold, row_id, CASE WHEN f.parent IS NULL THEN 'far' ELSE 'near' END AS ood_distance FROM gsplit g LEFT JOIN fit f USING (seed, fold, parent) WHERE role = 'test_ood'""",
       ("grouped",))
def fold_distance(spark, sf):
    g = grouped(spark, sf)
    out = mf.fold_distance(g.filter("role = 'test_ood'"), g.filter("role = 'train'"), ["seed", "fold"])
    return out.select("seed", "fold", "row_id", "ood_distance")


# ------------------------------------------------------------------ weights

@query("training_weights", """+ c AS (SELECT label, cluster_id, count(*) AS n FROM rows_ GROUP BY 1, 2), l AS (SELECT label, count(*) AS m FROM c GROUP BY 1)
SELECT row_id, round(1e0 / (m * n) * (SELECT count(*) FROM rows_) / (SELECT count(*) FROM l), 8) AS weight FROM rows_ JOIN c USING (label, cluster_id) JOIN l USING (label)""", ("rows_",))
def training_weights(spark, sf):
    return rounded(wt.training_weights(rows(spark, sf)).select("row_id", "weight"), "weight", digits=8)


@query("evaluation_weights", """SELECT row_id, round(1e0 / count(*) OVER (PARTITION BY cluster_id) / (SELECT count(DISTINCT cluster_id) FROM rows_), 10) AS weight FROM rows_""", ("rows_",))
def evaluation_weights(spark, sf):
    return rounded(wt.evaluation_weights(rows(spark, sf)).select("row_id", "weight"), "weight", digits=10)


# ------------------------------------------------------------------ source hold-outs

HOLD = ("1-URGENT", "5-LOW")
define("source_base", """srows AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_suppkey * 10 + l_linenumber % 3 AS cluster_id, 'P' || (l_suppkey * 10 + l_linenumber % 3) % 7 AS label, 'G' AS parent,
  CASE WHEN l_suppkey % 4 = 0 AND l_linenumber = 3 THEN 'X' WHEN l_suppkey % 5 = 0 AND l_linenumber = 4 THEN 'Y' ELSE 'Z' END AS source FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem)),
hold AS (SELECT unnest(['X', 'Y']) AS holdout),
sc AS (SELECT holdout, cluster_id, min(label) AS label, count(*) AS total_rows, count(*) FILTER (source = holdout) AS held_rows, count(DISTINCT source) AS source_count,
  count(*) FILTER (source = holdout) > 0 AS is_held FROM srows, hold GROUP BY 1, 2),
scount AS (SELECT holdout, label, CAST(sum(is_held::INT) AS BIGINT) AS held_clusters, count(*) AS total_clusters, CAST(count(*) - sum(is_held::INT) AS BIGINT) AS nonheld_clusters FROM sc GROUP BY 1, 2),
sinc AS (SELECT *, held_clusters >= 2 AND nonheld_clusters >= 5 AS included FROM scount),
scoh AS (SELECT sc.* FROM sc JOIN sinc USING (holdout, label) WHERE included),
sroles AS (SELECT holdout, cluster_id, seed, 'test_source' AS role FROM scoh, (SELECT unnest([11, 12]) AS seed) WHERE is_held
  UNION ALL SELECT holdout, cluster_id, seed, CASE WHEN r <= least(greatest(1, floor(n * 0.2e0)), n - 1) THEN 'calibration' ELSE 'train' END FROM (
  SELECT holdout, cluster_id, seed, row_number() OVER (PARTITION BY seed, holdout, label ORDER BY sha256(concat_ws('|', seed, holdout, label, cluster_id)), cluster_id) AS r,
  count(*) OVER (PARTITION BY seed, holdout, label) AS n FROM scoh, (SELECT unnest([11, 12]) AS seed) WHERE NOT is_held)),
ssrc AS (SELECT holdout, seed, row_id, cluster_id, label, parent, source, role FROM srows JOIN sroles USING (cluster_id))""")


def source_rows(spark, sf):
    from kinfold.queries.base import table
    k, n = F.col("l_suppkey"), F.col("l_linenumber")
    cluster = k * 10 + n % 3
    return table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey").distinct().select(
        (F.col("l_orderkey") * 10 + n).alias("row_id"), cluster.alias("cluster_id"), F.concat(F.lit("P"), (cluster % 7).cast("string")).alias("label"),
        F.lit("G").alias("parent"),
        F.when((k % 4 == 0) & (n == 3), "X").when((k % 5 == 0) & (n == 4), "Y").otherwise("Z").alias("source"),
    )


@query("source_cohort", """SELECT holdout, cluster_id, label, total_rows, held_rows, source_count, is_held, total_rows - held_rows AS other_rows, source_count > 1 AS mixed_source,
CASE WHEN is_held THEN 'test_source' ELSE 'nonheld_pool' END AS source_role FROM scoh""", ("source_base",))
def source_cohort(spark, sf):
    return sp.source_cohorts(source_rows(spark, sf), ["X", "Y"])[0]


@query("source_label_counts", "SELECT * FROM sinc", ("source_base",))
def source_label_counts(spark, sf):
    return sp.source_cohorts(source_rows(spark, sf), ["X", "Y"])[1]


def source_split_frame(spark, sf):
    base = source_rows(spark, sf)
    return sp.source_splits(base, sp.source_cohorts(base, ["X", "Y"])[0], SEEDS)


@query("source_splits", "SELECT * FROM ssrc", ("source_base",))
def source_splits(spark, sf):
    return source_split_frame(spark, sf)


@query("source_split_violations", """+ bad AS (SELECT * REPLACE (CASE WHEN role = 'calibration' AND row_id % 50 = 0 THEN 'test_source' ELSE role END AS role, CASE WHEN role = 'train' AND row_id % 90 = 0 THEN holdout ELSE source END AS source) FROM ssrc),
c AS (SELECT holdout, seed, cluster_id, count(DISTINCT role) AS roles, bool_or(role = 'test_source') AS test, bool_or(role <> 'test_source') AS other, bool_or(source = holdout) AS target FROM bad GROUP BY ALL)
SELECT holdout, seed, cluster_id::VARCHAR AS item, 'cluster in two roles' AS rule FROM c WHERE roles > 1
UNION ALL SELECT holdout, seed, cluster_id::VARCHAR, 'test cluster without the source' FROM c WHERE test AND NOT target
UNION ALL SELECT holdout, seed, row_id::VARCHAR, 'held source used for fitting' FROM bad WHERE role <> 'test_source' AND source = holdout
UNION ALL SELECT holdout, seed, cluster_id::VARCHAR, 'cluster in test and fitting' FROM c WHERE test AND other
UNION ALL SELECT holdout, seed, row_id::VARCHAR, 'repeated row' FROM bad GROUP BY holdout, seed, row_id HAVING count(*) > 1""", ("source_base",))
def source_split_violations(spark, sf):
    good = source_split_frame(spark, sf)
    bad = good.select(
        "holdout", "seed", "row_id", "cluster_id", "label", "parent",
        F.when((F.col("role") == "train") & (F.col("row_id") % 90 == 0), F.col("holdout")).otherwise(F.col("source")).alias("source"),
        F.when((F.col("role") == "calibration") & (F.col("row_id") % 50 == 0), "test_source").otherwise(F.col("role")).alias("role"),
    )
    return sp.source_split_violations(bad)


@query("source_populations", """SELECT holdout, seed, CASE WHEN role = 'test_source' AND source = holdout THEN 'target-label-primary' WHEN role = 'test_source' THEN 'other-label-quarantine-auxiliary' ELSE 'calibration' END AS population,
count(*) AS n_rows FROM ssrc WHERE role <> 'train' GROUP BY ALL""", ("source_base",))
def source_populations(spark, sf):
    from kinfold.plans.source_transport import population
    used = source_split_frame(spark, sf).filter("role != 'train'")
    return used.withColumn("population", population()).groupBy("holdout", "seed", "population").agg(F.count("*").alias("n_rows"))


# ------------------------------------------------------------------ generic audits

@query("grid_completeness", """+ e AS (SELECT design, seed, fold FROM (VALUES ('cluster_grouped'), ('row_random')) AS d(design), (SELECT unnest([11, 12, 13]) AS seed), (SELECT unnest([0, 1, 2, 3]) AS fold)),
o AS (SELECT DISTINCT design, seed, fold FROM gsplit)
SELECT *, 'missing' AS problem FROM (SELECT * FROM e EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM o EXCEPT SELECT * FROM e)""", ("grouped",))
def grid_completeness(spark, sf):
    expected = au.grid(spark, {"design": ["cluster_grouped", "row_random"], "seed": [11, 12, 13], "fold": [0, 1, 2, 3]})
    return au.set_difference(expected, grouped(spark, sf), ["design", "seed", "fold"])


@query("set_equality", """+ a AS (SELECT DISTINCT seed, cluster_id FROM gsplit WHERE role = 'train'), b AS (SELECT DISTINCT seed, cluster_id FROM gsplit WHERE role = 'test_ood' OR (role = 'train' AND fold = 1))
SELECT seed, cluster_id, 'train' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT seed, cluster_id, 'ood' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""", ("grouped",))
def set_equality(spark, sf):
    g = grouped(spark, sf)
    a = g.filter("role = 'train'").withColumn("side", F.lit("train"))
    b = g.filter("role = 'test_ood' OR (role = 'train' AND fold = 1)").withColumn("side", F.lit("ood"))
    return au.same_members(a.unionByName(b), ["seed"], "side", "train", "ood", "cluster_id")


@query("dependency_violations", "SELECT l_suppkey, count(DISTINCT l_linestatus) AS n_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1")
def dependency_violations(spark, sf):
    from kinfold.queries.base import table
    return au.dependency_violations(table(spark, sf, "lineitem", "l_suppkey", "l_linestatus"), "l_suppkey", "l_linestatus")


@query("coverage_violations", """+ l AS (SELECT o_orderkey AS k, 1 AS n FROM orders), r AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT coalesce(l.k, r.k) AS row_id, coalesce(l.n, 0)::BIGINT AS left_rows, coalesce(r.n, 0)::BIGINT AS right_rows FROM l FULL JOIN r ON l.k = r.k WHERE coalesce(l.n, 0) <> 1 OR coalesce(r.n, 0) <> 1""")
def coverage_violations(spark, sf):
    from kinfold.queries.base import table
    left = table(spark, sf, "orders", "o_orderkey").toDF("row_id")
    return au.coverage_violations(left, table(spark, sf, "lineitem", "l_orderkey").toDF("row_id"), "row_id")


@query("ledger_reconciliation", """+ d AS (SELECT url || '#' || page_id AS path, octet_length(encode(html)) AS b, sha256(html) AS s FROM pages WHERE page_id % 11 <> 0),
a AS (SELECT url || '#' || page_id AS path, octet_length(encode(html)) + CASE WHEN page_id % 13 = 0 THEN 1 ELSE 0 END AS b, sha256(html || CASE WHEN page_id % 17 = 0 THEN 'x' ELSE '' END) AS s FROM pages WHERE page_id % 7 <> 0)
SELECT path, d.b AS declared_bytes, d.s AS declared_sha256, a.b AS actual_bytes, a.s AS actual_sha256, CASE WHEN a.s IS NULL THEN 'missing' WHEN d.s IS NULL THEN 'extra' ELSE 'changed' END AS status
FROM d FULL JOIN a USING (path) WHERE a.s IS NULL OR d.s IS NULL OR a.s <> d.s OR a.b <> d.b""")
def ledger_reconciliation(spark, sf):
    from kinfold.queries.base import table
    p, pages = F.col("page_id"), table(spark, sf, "pages")
    path = F.concat("url", F.lit("#"), p.cast("string")).alias("path")
    declared = pages.filter(p % 11 != 0).select(path, F.octet_length("html").alias("bytes"), F.sha2("html", 256).alias("sha256"))
    actual = pages.filter(p % 7 != 0).select(
        path, (F.octet_length("html") + F.when(p % 13 == 0, 1).otherwise(0)).alias("bytes"),
        F.sha2(F.concat("html", F.when(p % 17 == 0, "x").otherwise("")), 256).alias("sha256"))
    return au.reconcile(declared, actual)


@query("cell_reconciliation", """+ e AS (SELECT seed, fold, count(*) AS n, min(design) AS design FROM gsplit GROUP BY 1, 2)
SELECT seed, fold, CASE WHEN seed = 11 AND fold = 0 THEN 'missing' WHEN seed = 12 AND fold = 1 THEN 'repeated' WHEN seed = 12 AND fold = 2 THEN 'incomplete' WHEN fold = 3 THEN 'field mismatch' END AS problem
FROM e WHERE (seed = 11 AND fold = 0) OR (seed = 12 AND fold = 1) OR (seed = 12 AND fold = 2) OR fold = 3 UNION ALL SELECT 11, 9, 'unexpected'""", ("grouped",))
def cell_reconciliation(spark, sf):
    cells = grouped(spark, sf).groupBy("seed", "fold").agg(F.count("*").alias("n"))
    s, f = F.col("seed"), F.col("fold")
    stored = cells.filter(~((s == 11) & (f == 0))).select(
        "seed", "fold", F.when(f == 3, F.col("n") + 1).otherwise(F.col("n")).alias("n"),
        F.when((s == 12) & (f == 2), "running").otherwise("complete").alias("status"))
    extra = stored.filter((s == 12) & (f == 1)).unionByName(stored.filter((s == 11) & (f == 4)).withColumn("fold", F.lit(9)))
    return au.reconcile_cells(cells, stored.unionByName(extra), ["seed", "fold"], ["n"])
