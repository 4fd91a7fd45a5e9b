"""Identity components, exclusions and what remains without them."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import identity as idn
from kinfold.operators import metrics as me
from kinfold.plans import identity_exclusion as ie
from kinfold.queries.base import define, query, rounded, rows, table
from kinfold.queries.calibration import decisions
from kinfold.queries.metrics import f1_sql, prob_rows
from kinfold.queries.splitting import grouped
from kinfold.session import durable

define("idm", """idm AS (SELECT r.row_id, r.cluster_id, r.label, r.parent, label || '|' || (CAST(floor(c_acctbal / 20) AS BIGINT) + CASE WHEN amount > 497000 THEN 1 ELSE 0 END) AS identity
  FROM rows_ r JOIN customer ON c_custkey = r.cluster_id),
idc AS (SELECT *, cluster_id IN (SELECT cluster_id FROM idm GROUP BY 1 HAVING count(DISTINCT identity) > 1) AS identity_conflict FROM idm),
ied AS (SELECT DISTINCT cluster_id, identity FROM idm),
reach AS (SELECT cluster_id AS src, cluster_id AS dst FROM ied UNION SELECT r.src, b.cluster_id FROM reach r JOIN ied a ON a.cluster_id = r.dst JOIN ied b ON b.identity = a.identity),
mem AS (SELECT src AS cluster_id, min(dst::VARCHAR) AS root FROM reach GROUP BY src),
cf AS (SELECT cluster_id, count(DISTINCT row_id) AS n_rows, bool_or(identity_conflict) AS conflict FROM idc GROUP BY 1),
comp AS (SELECT root, count(*) AS n_clusters, sum(n_rows)::BIGINT AS n_rows, sum(conflict::INT)::BIGINT AS n_conflict_clusters, bool_or(conflict) AS has_conflict, count(*) > 1 AS spans_clusters, bool_or(conflict) OR count(*) > 1 AS excluded,
  list(cluster_id::VARCHAR ORDER BY cluster_id::VARCHAR) AS cluster_ids, (SELECT count(DISTINCT identity) FROM ied JOIN mem m2 USING (cluster_id) WHERE m2.root = m.root) AS n_identities,
  (SELECT list(DISTINCT identity ORDER BY identity) FROM ied JOIN mem m2 USING (cluster_id) WHERE m2.root = m.root) AS identities FROM mem m JOIN cf USING (cluster_id) GROUP BY root),
excl AS (SELECT cluster_id, cf.n_rows, conflict, c.* EXCLUDE (n_rows) FROM mem JOIN cf USING (cluster_id) JOIN comp c USING (root) WHERE excluded)""", ("rows_",))


def id_manifest(spark, sf):
    balance = table(spark, sf, "customer", "c_custkey", "c_acctbal")
    joined = rows(spark, sf).join(balance, F.col("cluster_id") == F.col("c_custkey"))
    slot = F.floor(F.col("c_acctbal") / 20).cast("bigint") + F.when(F.col("amount") > 497000, 1).otherwise(0)
    base = joined.select("row_id", "cluster_id", "label", "parent", F.concat_ws("|", "label", slot.cast("string")).alias("identity"))
    from kinfold.operators.manifest import identity_conflicts
    return durable(identity_conflicts(base))


@query("identity_components", "RECURSIVE SELECT cluster_id, 'c:' || root AS component FROM mem", ("idm",))
def identity_components(spark, sf):
    return idn.cluster_components(id_manifest(spark, sf))


@query("component_summary", """RECURSIVE SELECT 'component_' || substr(sha256(to_json({'cluster_ids': cluster_ids, 'identities': identities})::VARCHAR), 1, 16) AS component_id, n_clusters, n_rows, n_identities, n_conflict_clusters, has_conflict, spans_clusters, excluded,
to_json(cluster_ids)::VARCHAR AS cluster_ids FROM comp""", ("idm",))
def component_summary(spark, sf):
    out = idn.component_tables(id_manifest(spark, sf))[0]
    return out.select("component_id", "n_clusters", "n_rows", "n_identities", "n_conflict_clusters", "has_conflict", "spans_clusters", "excluded", F.to_json("cluster_ids").alias("cluster_ids"))


@query("excluded_clusters", """RECURSIVE SELECT cluster_id, n_rows, conflict, has_conflict, spans_clusters, n_clusters, n_identities, concat_ws(';', CASE WHEN conflict THEN 'within_cluster_conflict' END, CASE WHEN has_conflict THEN 'component_contains_conflict' END,
CASE WHEN spans_clusters THEN 'component_spans_clusters' END) AS reason FROM excl""", ("idm",))
def excluded_clusters(spark, sf):
    return idn.component_tables(id_manifest(spark, sf))[1].drop("component_id")


@query("exclusion_counts", """RECURSIVE SELECT count(*) AS components, sum(excluded::INT)::BIGINT AS excluded_components, sum(spans_clusters::INT)::BIGINT AS spanning_components, sum(has_conflict::INT)::BIGINT AS conflict_components, sum(n_clusters)::BIGINT AS clusters,
sum(CASE WHEN excluded THEN n_clusters ELSE 0 END)::BIGINT AS excluded_clusters, sum(n_rows)::BIGINT AS rows, sum(CASE WHEN excluded THEN n_rows ELSE 0 END)::BIGINT AS excluded_rows, max(n_clusters) AS largest_component FROM comp""", ("idm",))
def exclusion_counts(spark, sf):
    return idn.exclusion_summary(idn.component_tables(id_manifest(spark, sf))[0])


define("idm0", """idm0 AS (SELECT r.row_id, r.cluster_id, label || '|' || (CAST(floor(c_acctbal / 20) AS BIGINT) + CASE WHEN amount > 497000 THEN 1 ELSE 0 END) AS identity FROM rows_ r JOIN customer ON c_custkey = r.cluster_id)""", ("rows_",))
define("idx", """badc AS (SELECT DISTINCT cluster_id FROM idm0 WHERE identity IN (SELECT identity FROM idm0 GROUP BY 1 HAVING count(DISTINCT cluster_id) > 1))""", ("idm0",))


def _pair_sql(table_: str, item: str) -> str:
    return ", ".join(f"count(DISTINCT {item}) FILTER (list_contains(r, '{a}') AND list_contains(r, '{b}')) AS {a}__{b}__{table_}_overlap" for a, b in idn.ROLE_PAIRS)


@query("isolation_audit", f"""+ use AS (SELECT DISTINCT seed, fold, cluster_id, role FROM gsplit), lk AS (SELECT seed, fold, cluster_id, role, identity FROM use JOIN (SELECT DISTINCT cluster_id, identity FROM idm0) USING (cluster_id)),
bi AS (SELECT seed, fold, identity, list(DISTINCT role) AS r FROM lk GROUP BY ALL), bc AS (SELECT seed, fold, cluster_id, list(DISTINCT role) AS r FROM lk GROUP BY ALL),
ti AS (SELECT seed, fold, count(*) AS n_identities, {_pair_sql('identity', 'identity')}, count(*) FILTER (len(r) > 1) AS any_overlap FROM bi GROUP BY ALL), tc AS (SELECT seed, fold, count(*) AS n_clusters, {_pair_sql('cluster', 'cluster_id')} FROM bc GROUP BY ALL),
rep AS (SELECT count(*) AS repeated_identities FROM (SELECT identity FROM idm0 GROUP BY 1 HAVING count(DISTINCT cluster_id) > 1))
SELECT *, repeated_identities = 0 AND any_overlap = 0 AS passed FROM ti JOIN tc USING (seed, fold), rep""", ("grouped", "idm0"))
def isolation_audit(spark, sf):
    return idn.isolation_audit(id_manifest(spark, sf), durable(grouped(spark, sf)))


def shared_clusters(spark, sf):
    """Clusters whose identity is used by another cluster."""
    pairs = idn.identity_edges(id_manifest(spark, sf))
    shared = pairs.groupBy("identity").agg(F.countDistinct("cluster_id").alias("n")).filter("n > 1")
    return durable(pairs.join(shared, "identity", "left_semi").select("cluster_id").distinct())


@query("clean_leakage", "+ ck AS (SELECT * FROM pw WHERE cluster_id NOT IN (SELECT cluster_id FROM badc)), cc AS (SELECT * FROM cm WHERE cluster_id NOT IN (SELECT cluster_id FROM badc)),\n"
       + f1_sql("c1", "ck", "design, seed") + ",\n" + f1_sql("c2", "ck", "design, seed", weight="cw") + ",\n" + f1_sql("c3", "cc", "design, seed") + """,
cn AS (SELECT design, seed, count(*) AS n_rows, count(DISTINCT cluster_id) AS n_clusters, count(DISTINCT label) AS n_labels FROM ck GROUP BY ALL)
SELECT design, seed, n_rows, n_clusters, n_labels, round(c1.macro_f1, 6) AS pooled_row_macro_f1, round(c2.macro_f1, 6) AS equal_cluster_macro_f1, round(c3.macro_f1, 6) AS cluster_mean_macro_f1, round(c3.balanced_accuracy, 6) AS cluster_mean_balanced_accuracy
FROM cn JOIN c1 USING (design, seed) JOIN c2 USING (design, seed) JOIN c3 USING (design, seed)""", ("leak", "idx"))
def clean_leakage(spark, sf):
    classes, known = prob_rows(spark, sf)
    clusters = durable(me.cluster_mean_predictions(known, ["seed", "design"], classes))
    metrics = ie.clean_leakage(known, clusters, shared_clusters(spark, sf))[0]
    return rounded(metrics, *me.ESTIMANDS, "cluster_mean_balanced_accuracy")


@query("clean_cohort_check", """+ k AS (SELECT * FROM pk WHERE cluster_id NOT IN (SELECT cluster_id FROM badc) AND NOT (design = 'row_random' AND row_id % 97 = 0)),
p AS (SELECT seed, row_id, max((design = 'row_random')::INT) AS r, max((design = 'cluster_grouped')::INT) AS g FROM k GROUP BY ALL)
SELECT seed, sum(r)::BIGINT AS random_rows, sum(g)::BIGINT AS grouped_rows, sum((r > g)::INT)::BIGINT AS random_only, sum((g > r)::INT)::BIGINT AS grouped_only, CAST(0 AS BIGINT) AS label_conflicts, sum((r <> g)::INT) = 0 AS passed FROM p GROUP BY seed""", ("prw", "idx"))
def clean_cohort_check(spark, sf):
    from kinfold.operators.manifest import exclude_clusters
    _, known = prob_rows(spark, sf)
    kept = exclude_clusters(known.filter("NOT (design = 'row_random' AND row_id % 97 = 0)"), shared_clusters(spark, sf))
    return ie.cohort_check(kept, ["seed"])


@query("label_type_sensitivity", """+ b AS (SELECT d.*, CASE WHEN right(d.label, 1) = '2' THEN 'sp_unspecified' ELSE 'explicit_binomial' END AS lt FROM dm d WHERE role <> 'calibration' AND cluster_id NOT IN (SELECT cluster_id FROM badc)),
s AS (SELECT *, unnest(CASE WHEN role = 'test_known' THEN ['known'] WHEN ood_distance = 'near' THEN ['all_ood', 'same_parent_ood'] ELSE ['all_ood', 'different_parent_ood'] END) AS selector2, CASE WHEN role = 'test_ood' THEN fold END AS instance_fold FROM b),
c AS (SELECT design, selector2, lt, seed, instance_fold, cluster_id, avg(ca::INT) AS m, sum(ca::INT) AS s, count(*) AS n, avg((ca AND ct = label)::INT) AS mh, sum((ca AND ct = label)::INT) AS sh FROM s GROUP BY ALL)
SELECT design, selector2 AS selector, lt AS label_type, seed, instance_fold, sum(n)::BIGINT AS n_rows, count(*) AS n_clusters, round(sum(s) / sum(n), 6) AS corrected_accept__row, round(avg(m), 6) AS corrected_accept__cluster,
round(sum(sh) / nullif(sum(s), 0), 6) AS label_accuracy__row, round(sum(mh) / nullif(sum(m), 0), 6) AS label_accuracy__cluster FROM c GROUP BY ALL""", ("sel", "idx"))
def label_type_sensitivity(spark, sf):
    kind = F.when(F.substring("label", -1, 1) == "2", "sp_unspecified").otherwise("explicit_binomial")
    out = ie.label_sensitivity(decisions(spark, sf), shared_clusters(spark, sf), ["design"], kind)[0]
    columns = ["corrected_accept__row", "corrected_accept__cluster", "label_accuracy__row", "label_accuracy__cluster"]
    return rounded(out.select("design", "selector", "label_type", "seed", "instance_fold", "n_rows", "n_clusters", *columns), *columns)
