"""Ingest, text, matching, membership, features and signal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions import formats as fm
from kinfold.functions import hashing as hs
from kinfold.functions import text as tx
from kinfold.functions import arrays as ar
from kinfold.operators import features as ft
from kinfold.operators import manifest as mf
from kinfold.operators import matching as mt
from kinfold.operators import signal as sg
from kinfold.operators.ranking import add_group_size
from kinfold.queries.base import GRID, N_BINS, define, manifest, minima, peaks, query, rounded, rows, table
from kinfold.sources.readers import parse_acquisition


def features(spark, sf):
    return ft.bin_peaks(peaks(spark, sf), **GRID)


# ------------------------------------------------------------------ features

@query("bin_peaks", "SELECT row_id, bin, round(value, 6) AS value FROM features", ("features",))
def bin_peaks(spark, sf):
    return rounded(features(spark, sf), "value")


@query("valid_peaks_of_known_rows", """SELECT row_id, count(*) AS n_peaks, round(sum(intensity), 6) AS total FROM peaks
WHERE mass >= 2000 AND mass < 102000 AND intensity > 0 AND row_id IN (SELECT row_id FROM manifest WHERE primary_known) GROUP BY row_id""",
       ("peaks", "manifest"))
def valid_peaks_of_known_rows(spark, sf):
    known = manifest(spark, sf).filter("primary_known")
    kept = ft.valid_peaks(peaks(spark, sf), GRID["mass_min"], GRID["mass_max"], known)
    return rounded(kept.groupBy("row_id").agg(F.count("*").alias("n_peaks"), F.sum("intensity").alias("total")), "total")


@query("rebin_features", """SELECT row_id, CAST(bin // 3 AS INTEGER) AS bin, round(sum(value), 6) AS value FROM features
WHERE bin < 1998 GROUP BY 1, 2""", ("features",))
def rebin_features(spark, sf):
    return rounded(ft.rebin(features(spark, sf), source_width=50.0, target_width=150.0, n_bins=N_BINS), "value")


@query("feature_row_audit", "SELECT row_id, round(sum(v), 6) AS row_sum, 0 AS not_finite FROM binned GROUP BY row_id HAVING abs(sum(v) - 1) > 1e-6",
       ("features",))
def feature_row_audit(spark, sf):
    raw = ft.sum_bins(ft.valid_peaks(peaks(spark, sf), GRID["mass_min"], GRID["mass_max"]), GRID["mass_min"], GRID["bin_width"])
    return rounded(ft.row_sum_violations(raw), "row_sum")


@query("feature_density", """SELECT (SELECT count(*) FROM rows_) AS n_rows, CAST(2000 AS BIGINT) AS n_bins, count(*) AS nnz,
round(count(*) / ((SELECT count(*) FROM rows_) * 2000e0), 9) AS density FROM features""", ("features", "rows_"))
def feature_density(spark, sf):
    return rounded(ft.density(features(spark, sf), rows(spark, sf), N_BINS), "density", digits=9)


@query("l2_features", """SELECT row_id, bin, round(value / sqrt(sum(value * value) OVER (PARTITION BY row_id)), 6) AS value FROM features""",
       ("features",))
def l2_features(spark, sf):
    return rounded(ft.l2_normalise(features(spark, sf)), "value")


# ------------------------------------------------------------------ membership and audit of records

@query("membership", """SELECT row_id, label_cluster_count, primary_known, primary_ood, sensitivity_known, analysis_set, ood_distance, ood_singleton
FROM manifest""", ("manifest",))
def membership(spark, sf):
    return manifest(spark, sf).select(
        "row_id", "label_cluster_count", "primary_known", "primary_ood", "sensitivity_known", "analysis_set", "ood_distance", "ood_singleton"
    )


@query("dataset_summary", """SELECT count(*) AS rows, count(DISTINCT cluster_id) AS clusters, count(DISTINCT label) AS labels,
count(DISTINCT parent) AS parents, CAST(0 AS BIGINT) AS unresolved_rows,
count(DISTINCT label) FILTER (primary_known) AS known_labels, count(DISTINCT cluster_id) FILTER (primary_known) AS known_clusters,
count(DISTINCT label) FILTER (sensitivity_known) AS sensitivity_known_labels,
count(DISTINCT label) FILTER (primary_ood) AS ood_labels, count(DISTINCT label) FILTER (ood_singleton) AS singleton_ood_labels FROM manifest""",
       ("manifest",))
def dataset_summary(spark, sf):
    return mf.dataset_summary(manifest(spark, sf))


@query("label_counts", """SELECT s_name AS label, coalesce(count(DISTINCT l_partkey), 0) AS observed_clusters, count(l_orderkey) AS observed_rows
FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_name""")
def label_counts(spark, sf):
    names = table(spark, sf, "supplier", "s_suppkey", "s_name")
    seen = table(spark, sf, "lineitem", "l_suppkey", "l_partkey", "l_orderkey").join(names, F.col("l_suppkey") == F.col("s_suppkey"))
    seen = seen.select(F.col("s_name").alias("label"), F.col("l_partkey").alias("cluster_id"), F.col("l_orderkey").alias("row_id"))
    return mf.label_counts(names.select(F.col("s_name").alias("label")), seen)


@query("replicate_ordinal", "SELECT row_id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY row_id) AS ordinal FROM rows_", ("rows_",))
def replicate_ordinal(spark, sf):
    return mf.ordinal_in_group(rows(spark, sf).select("row_id", "cluster_id"), "cluster_id", "row_id", "ordinal")


@query("exact_duplicates", """SELECT doc_id AS row_id, doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS duplicate FROM documents""")
def exact_duplicates(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text").select(F.col("doc_id").alias("row_id"), F.sha2("text", 256).alias("digest"))
    return mf.mark_duplicates(docs).select("row_id", "duplicate")


define("records", """counted AS (SELECT row_id, count(*) AS c FROM peaks WHERE mass >= 2000 AND mass < 102000 AND intensity > 0 GROUP BY row_id),
records AS (SELECT r.row_id, r.cluster_id, r.label, r.parent, coalesce(c, 0) AS peak_count,
  CASE WHEN source = '5-LOW' AND amount > 400000 THEN 'unresolved' ELSE 'matched' END AS taxonomy_status,
  CASE WHEN source = '1-URGENT' AND amount > 450000 THEN NULL ELSE sha256(concat_ws('|', r.cluster_id, CAST(floor(amount / 40000) AS BIGINT))) END AS digest,
  CASE WHEN amount > 495000 THEN 'b' ELSE 'a' END AS identity FROM rows_ r LEFT JOIN counted USING (row_id)),
flagged AS (SELECT *, cluster_id IN (SELECT cluster_id FROM records GROUP BY 1 HAVING count(DISTINCT identity) > 1) AS identity_conflict,
  digest IS NOT NULL AND row_id <> min(row_id) OVER (PARTITION BY digest) AS duplicate FROM records),
decided AS (SELECT *, taxonomy_status = 'matched' AND peak_count > 0 AND digest IS NOT NULL AND NOT duplicate AS included,
  CASE WHEN duplicate THEN 'exact_raw_duplicate' WHEN peak_count = 0 THEN 'zero-peaks' WHEN taxonomy_status = 'unresolved' THEN 'unresolved-taxonomy' ELSE '' END AS exclusion_reason,
  concat_ws(';', CASE WHEN peak_count = 0 THEN 'zero-peaks' END, CASE WHEN identity_conflict THEN 'cmt-identity-conflict' END) AS qc_flags FROM flagged)""",
       ("peaks", "rows_"))


def records(spark, sf):
    counts = ft.valid_peaks(peaks(spark, sf), GRID["mass_min"], GRID["mass_max"]).groupBy("row_id").agg(F.count("*").alias("peak_count"))
    base = rows(spark, sf).join(counts, "row_id", "left").withColumn("peak_count", F.coalesce("peak_count", F.lit(0)))
    low = (F.col("source") == "5-LOW") & (F.col("amount") > 400000)
    lost = (F.col("source") == "1-URGENT") & (F.col("amount") > 450000)
    part = F.floor(F.col("amount") / 40000).cast("bigint")
    return base.select(
        "row_id", "cluster_id", "label", "parent", "peak_count",
        F.when(low, "unresolved").otherwise("matched").alias("taxonomy_status"),
        F.when(~lost, hs.hash_key(F.col("cluster_id"), part)).alias("digest"),
        F.when(F.col("amount") > 495000, "b").otherwise("a").alias("identity"),
    )


@query("identity_conflicts", "SELECT row_id, identity_conflict FROM flagged", ("records",))
def identity_conflicts(spark, sf):
    return mf.identity_conflicts(records(spark, sf)).select("row_id", "identity_conflict")


@query("manifest_build", """+ kept AS (SELECT * FROM decided WHERE included),
kept_n AS (SELECT label, CAST(count(DISTINCT cluster_id) AS INTEGER) AS n FROM kept GROUP BY label),
kept_near AS (SELECT DISTINCT parent FROM kept JOIN kept_n USING (label), minima WHERE n >= k)
SELECT row_id, included, exclusion_reason, qc_flags, CASE WHEN included THEN n ELSE 0 END AS label_cluster_count,
CASE WHEN NOT included THEN 'excluded' WHEN n >= k THEN 'primary_known' ELSE 'ood' END AS analysis_set,
included AND n >= k AS primary_known, included AND n < k AS primary_ood, included AND n >= s AS sensitivity_known,
CASE WHEN included AND n < k THEN CASE WHEN parent IN (SELECT parent FROM kept_near) THEN 'near' ELSE 'far' END END AS ood_distance,
included AND n = 1 AND n < k AS ood_singleton
FROM decided LEFT JOIN kept_n USING (label), minima""", ("records", "manifest"))
def manifest_build(spark, sf):
    flagged = mf.identity_conflicts(records(spark, sf)).withColumn(
        "qc_flags", mf.qc_flags(F.col("peak_count"), F.col("identity_conflict")))
    done = mf.finish_manifest(mf.apply_inclusion(flagged), *minima(spark, sf))
    return mf.keep_existing(done, ["row_id", "included", "exclusion_reason", "qc_flags", "label_cluster_count", "analysis_set",
                                   "primary_known", "primary_ood", "sensitivity_known", "ood_distance", "ood_singleton"])


# ------------------------------------------------------------------ matching and joins

@query("longest_prefix_match", """+ names AS (SELECT p_partkey, p_name || ' ' || p_brand AS name FROM part),
labels_ AS (SELECT DISTINCT p_name AS label FROM part WHERE p_type = 'ECONOMY' AND p_size > 30 UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part)
SELECT p_partkey, arg_max(label, length(label)) AS matched FROM names LEFT JOIN labels_
ON lower(name) = lower(label) OR starts_with(lower(name), lower(label) || ' ') GROUP BY p_partkey""")
def longest_prefix_match(spark, sf):
    part = table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    names = part.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    full = part.filter("p_type = 'ECONOMY' AND p_size > 30").select(F.col("p_name").alias("label"))
    labels = full.unionByName(part.select(tx.first_token(F.col("p_name")).alias("label"))).distinct()
    return mf.match_longest_prefix(names, labels, "name", "label").select("p_partkey", "matched")


@query("longest_substring_match", """+ names AS (SELECT DISTINCT source AS name FROM documents UNION SELECT DISTINCT lang FROM documents UNION SELECT DISTINCT lang || ' ' FROM documents),
urls AS (SELECT page_id, lower(trim(regexp_replace(regexp_replace(url, '[_/\\\\]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS t FROM pages),
hits AS (SELECT page_id, name, row_number() OVER (PARTITION BY page_id ORDER BY length(name) DESC, name) AS r FROM urls JOIN names ON contains(t, lower(name)) AND name <> '')
SELECT page_id, (SELECT name FROM hits h WHERE h.page_id = u.page_id AND r = 1) AS matched FROM urls u""")
def longest_substring_match(spark, sf):
    docs = table(spark, sf, "documents", "source", "lang")
    names = docs.select(F.col("source").alias("name")).union(docs.select("lang")).union(docs.select(F.concat("lang", F.lit(" ")))).distinct()
    pages = table(spark, sf, "pages", "page_id", "url")
    return mf.match_longest_substring(pages, names, "url", "name").select("page_id", "matched")


@query("cluster_resolution", """+ names AS (SELECT DISTINCT p_name || ' ' || p_brand AS name FROM part WHERE p_type IN ('STANDARD', 'SMALL')
  UNION SELECT DISTINCT 'x' || p_type || ' ' || p_brand FROM part UNION SELECT DISTINCT p_type FROM part WHERE p_size > 40),
recs AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS genus, split_part(p_name, ' ', 2) AS epithet, p_brand AS strain,
  CASE WHEN p_size > 25 THEN 'x' || p_type ELSE '' END AS directory_label, p_type || '/' || p_brand || '/' || p_size AS source_path FROM part),
a AS (SELECT r.*, lower(trim(directory_label || ' ' || strain)) AS k1, lower(genus || ' ' || epithet || ' ' || strain) AS k2,
  lower(replace(source_path, '/', ' ')) AS t FROM recs r),
sub AS (SELECT t, arg_max(name, length(name)) AS n3 FROM (SELECT DISTINCT t FROM a) JOIN names ON contains(t, lower(name)) GROUP BY t)
SELECT p_partkey, coalesce(n1.name, n2.name, n3) AS cluster_name FROM a LEFT JOIN names n1 ON k1 = lower(n1.name)
LEFT JOIN names n2 ON k2 = lower(n2.name) LEFT JOIN sub USING (t)""")
def cluster_resolution(spark, sf):
    part = table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    brand = lambda c: F.concat_ws(" ", c, "p_brand").alias("name")
    names = (
        part.filter(F.col("p_type").isin("STANDARD", "SMALL")).select(brand(F.col("p_name")))
        .union(part.select(brand(F.concat(F.lit("x"), "p_type"))))
        .union(part.filter("p_size > 40").select("p_type")).distinct()
    )
    words = F.split("p_name", " ")
    recs = part.select(
        "p_partkey", words[0].alias("genus"), words[1].alias("epithet"), F.col("p_brand").alias("strain"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("x"), "p_type")).otherwise("").alias("directory_label"),
        F.concat_ws("/", "p_type", "p_brand", "p_size").alias("source_path"),
    )
    return mf.resolve_clusters(recs, names).select("p_partkey", "cluster_name")


@query("positional_pairing", """+ l AS (SELECT o_orderkey, o_custkey AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
r AS (SELECT event_id, user_id AS g, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
SELECT o_orderkey, event_id FROM l LEFT JOIN r USING (g, i)""")
def positional_pairing(spark, sf):
    left = table(spark, sf, "orders", "o_orderkey", "o_custkey").withColumnRenamed("o_custkey", "g")
    right = table(spark, sf, "events", "event_id", "user_id").withColumnRenamed("user_id", "g")
    return mf.pair_by_position(left, right, "g", "o_orderkey", "event_id", "event_id", "event_id").select("o_orderkey", "event_id")


@query("alias_lookup", """SELECT row_id, coalesce(r_name, label) AS canonical FROM rows_ LEFT JOIN
(SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name < 'B') ON label = n_name""", ("rows_",))
def alias_lookup(spark, sf):
    names = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).filter("r_name < 'B'")
    aliases = names.select(F.col("n_name").alias("alias"), F.col("r_name").alias("canonical"))
    return mf.resolve_alias(rows(spark, sf), aliases, "label", "canonical").select("row_id", "canonical")


def _keyed(spark, sf):
    path = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("\\"), F.col("o_orderkey").cast("string"))
    recs = table(spark, sf, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("row_id"), tx.source_key(path).alias("source_key"))
    both = table(spark, sf, "lineitem", "l_orderkey", "l_quantity").join(
        table(spark, sf, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    meta = both.groupBy(tx.source_key(path).alias("source_key")).agg(F.sum("l_quantity").alias("quantity"))
    return recs, meta


@query("attach_metadata", """+ m AS (SELECT l_orderkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1)
SELECT o_orderkey AS row_id, 'c' || o_custkey || '/' || o_orderkey || '/fid' AS source_key, quantity, quantity IS NOT NULL AS metadata_found
FROM orders LEFT JOIN m ON o_orderkey = l_orderkey""")
def attach_metadata(spark, sf):
    return mf.attach_metadata(*_keyed(spark, sf))


@query("metadata_violations", """SELECT 'c' || o_custkey || '/' || o_orderkey || '/fid' AS source_key, 'no metadata' AS problem FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def metadata_violations(spark, sf):
    return mf.metadata_violations(*_keyed(spark, sf))


@query("exclude_clusters", """SELECT label, count(*) AS n FROM rows_ WHERE cluster_id NOT IN (SELECT cluster_id FROM flagged WHERE identity_conflict) GROUP BY label""",
       ("records",))
def exclude_clusters(spark, sf):
    bad = mf.identity_conflicts(records(spark, sf)).filter("identity_conflict")
    return mf.exclude_clusters(rows(spark, sf), bad).groupBy("label").agg(F.count("*").alias("n"))


@query("group_size", "SELECT row_id, count(*) OVER (PARTITION BY cluster_id) AS group_size FROM rows_", ("rows_",))
def group_size(spark, sf):
    return add_group_size(rows(spark, sf), ["cluster_id"]).select("row_id", "group_size")


@query("hash_sample", """SELECT row_id, label, sample_rank FROM (SELECT row_id, label,
row_number() OVER (PARTITION BY label ORDER BY sha256(concat_ws('|', 7, label, row_id)), row_id) AS sample_rank FROM rows_) WHERE sample_rank <= 20""",
       ("rows_",))
def hash_sample(spark, sf):
    return mf.hash_sample(rows(spark, sf).select("row_id", "label"), ["label"], 20, F.lit(7), F.col("label"), F.col("row_id"), tie=["row_id"])


# ------------------------------------------------------------------ scalar functions

@query("stable_ids", """SELECT o_orderkey, 'strain_' || substr(sha256(concat_ws(chr(31), o_custkey, o_orderkey)), 1, 20) AS id,
sha256(concat_ws(chr(31), 'spectrum', o_orderkey)) AS token,
('0x' || substr(sha256(concat_ws(chr(31), 'bootstrap', o_orderkey)), 1, 8))::BIGINT & 2147483647 AS seed,
sha256(concat_ws('|', 7, 3, o_orderkey)) AS order_key FROM orders""")
def stable_ids(spark, sf):
    key = F.col("o_orderkey")
    return table(spark, sf, "orders", "o_orderkey", "o_custkey").select(
        "o_orderkey", hs.stable_id(F.col("o_custkey"), key, prefix="strain_").alias("id"), hs.stable_token("spectrum", key).alias("token"),
        hs.stable_seed("bootstrap", key).alias("seed"), hs.hash_key(7, 3, key).alias("order_key"),
    )


@query("record_fingerprint", """SELECT c_custkey, sha256(to_json({'c_custkey': c_custkey, 'c_mktsegment': c_mktsegment, 'c_name': c_name, 'c_nationkey': c_nationkey})::VARCHAR) AS fingerprint FROM customer""")
def record_fingerprint(spark, sf):
    df = table(spark, sf, "customer", "c_nationkey", "c_name", "c_custkey", "c_mktsegment")
    return df.select("c_custkey", hs.row_fingerprint(df.columns).alias("fingerprint"))


@query("table_fingerprint", """+ d AS (SELECT sha256(to_json({'c_custkey': c_custkey, 'c_mktsegment': c_mktsegment, 'c_name': c_name, 'c_nationkey': c_nationkey})::VARCHAR) AS d FROM customer),
g AS (SELECT substr(d, 61, 2) AS g, count(*) AS n, """ + ", ".join(f"sum(('0x' || substr(d, {1 + 12 * i}, 12))::BIGINT) AS s{i}" for i in range(5)) + """ FROM d GROUP BY 1),
t AS (SELECT n, concat_ws(':', g, n, s0, s1, s2, s3, s4) AS t FROM g)
SELECT sum(n)::BIGINT AS n_rows, sha256(string_agg(t, ';' ORDER BY t)) AS fingerprint FROM t""")
def table_fingerprint(spark, sf):
    return hs.table_fingerprint(table(spark, sf, "customer", "c_nationkey", "c_name", "c_custkey", "c_mktsegment"))


@query("normalise_labels", """SELECT p_partkey, trim(regexp_replace(regexp_replace('  ' || p_name || '_/' || p_brand || '\\x  ', '[_/\\\\]+', ' ', 'g'), '\\s+', ' ', 'g')) AS normal,
split_part(p_name, ' ', 1) AS first_word, concat_ws('|', p_name, p_brand, '') AS identity,
CASE WHEN p_size > 25 THEN p_brand END AS cleaned FROM part""")
def normalise_labels(spark, sf):
    raw = F.concat(F.lit("  "), "p_name", F.lit("_/"), "p_brand", F.lit("\\x  "))
    return table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_size").select(
        "p_partkey", tx.normalize_label(raw).alias("normal"), tx.first_token(F.concat(F.lit(" "), "p_name")).alias("first_word"),
        tx.identity_string(F.col("p_name"), F.col("p_brand"), F.lit(None).cast("string")).alias("identity"),
        tx.clean_identity(F.when(F.col("p_size") > 25, F.concat(F.lit(" "), "p_brand", F.lit(" "))).otherwise("  ")).alias("cleaned"),
    )


@query("normalise_documents", """+ n AS (SELECT doc_id, nfc_normalize(text) AS t FROM documents)
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(t, '[_/\\\\]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS normal, sha256(trim(regexp_replace(replace(replace(lower(t), 'ß', 'ss'), '|', ' '), '\\s+', ' ', 'g'))) AS folded FROM n""")
def normalise_documents(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text")
    return docs.select("doc_id", F.sha2(tx.normalize_label(F.col("text")), 256).alias("normal"), F.sha2(tx.fold_identity(F.col("text")), 256).alias("folded"))


@query("label_types", """+ n AS (SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(CASE WHEN p_size > 40 THEN split_part(p_name, ' ', 1) || ' sp.' WHEN p_size > 35 THEN p_name || ' x' ELSE p_name END, 2) AS name FROM part)
SELECT p_partkey, CASE WHEN regexp_full_match(name, '[A-Z][A-Za-z-]+ sp\\.') THEN 'sp_unspecified' WHEN regexp_full_match(name, '[A-Z][A-Za-z-]+ [a-z][A-Za-z-]+') THEN 'explicit_binomial' ELSE 'other' END AS label_type,
len(string_split(name, ' ')) = 2 AND lower(split_part(name, ' ', 2)) <> 'sp.' AS explicit FROM n""")
def label_types(spark, sf):
    part = table(spark, sf, "part", "p_partkey", "p_name", "p_size")
    name = F.when(F.col("p_size") > 40, F.concat(tx.first_token(F.col("p_name")), F.lit(" sp."))).when(
        F.col("p_size") > 35, F.concat("p_name", F.lit(" x"))).otherwise(F.col("p_name"))
    named = part.withColumn("name", F.concat(F.upper(F.substring(name, 1, 1)), F.substr(name, F.lit(2))))
    return named.select("p_partkey", tx.label_type(F.col("name")).alias("label_type"), tx.is_explicit_binomial(F.col("name")).alias("explicit"))


@query("path_pieces", """+ s AS (SELECT page_id, string_split(replace(url, '\\', '/'), '/') AS p FROM pages)
SELECT page_id, p[3] AS host, p[4] AS section, CASE WHEN list_position(p, 'en') > 0 THEN array_to_string(p[1:list_position(p, 'en') - 1], '/')
WHEN len(p) > 4 THEN array_to_string(p[1:len(p) - 4], '/') ELSE array_to_string(p, '/') END AS group_path FROM s""")
def path_pieces(spark, sf):
    return table(spark, sf, "pages", "page_id", "url").select(
        "page_id", tx.path_part(F.col("url"), 2).alias("host"), tx.path_part(F.col("url"), 3).alias("section"),
        tx.group_path(F.col("url"), F.lit("en")).alias("group_path"),
    )


@query("acquisition_tags", """SELECT p_partkey, split_part(p_name, ' ', 1) AS raw_genus_label, split_part(p_name, ' ', 2) AS raw_species_epithet,
p_name AS raw_species_label, replace(p_brand, '#', ' ') AS raw_strain_label, CAST(NULL AS VARCHAR) AS raw_type_label,
CASE WHEN p_size > 25 THEN p_size ELSE p_partkey END AS taxid, p_type AS prep_method,
'2020-01-' || p_size AS acquisition_date FROM part""")
def acquisition_tags(spark, sf):
    part = table(spark, sf, "part")
    words = F.split("p_name", " ")
    uie = F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("")
    text = F.concat(
        F.lit("##TITLE= x\n##$CMT1= <#GEN="), words[0], F.lit("#SPE="), words[1], F.lit("#STR="), F.replace(F.col("p_brand"), F.lit("#"), F.lit(" ")), F.lit("#TYP=#UIE="), uie,
        F.lit("#UID="), F.col("p_partkey").cast("string"), F.lit(">\n##$CMT3= <#TRT= "), "p_type", F.lit(">\n##$AQ_DATE= <2020-01-"),
        F.col("p_size").cast("string"), F.lit(">\n"),
    )
    return parse_acquisition(part.select("p_partkey", text.alias("value"))).select(
        "p_partkey", "raw_genus_label", "raw_species_epithet", "raw_species_label", "raw_strain_label", "raw_type_label", "taxid",
        "prep_method", "acquisition_date",
    )


@query("taxonomy_numbers", "SELECT p_partkey, CASE WHEN p_size > 25 THEN TRY_CAST(p_size AS BIGINT) ELSE TRY_CAST(substr(p_brand, 7) AS BIGINT) END AS taxid FROM part")
def taxonomy_numbers(spark, sf):
    part = table(spark, sf, "part", "p_partkey", "p_size", "p_brand")
    uie = F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("")
    return part.select("p_partkey", tx.taxonomy_number(uie, F.substr(F.col("p_brand"), F.lit(7))).alias("taxid"))


@query("file_categories", """SELECT page_id, CASE WHEN p LIKE '%.xlsx' AND p LIKE '%taxonomy%' THEN 'taxonomy' WHEN p LIKE '%metadata.pdf' THEN 'metadata'
WHEN p LIKE '%.pkf' THEN 'pkf' WHEN p LIKE '%.zip' THEN 'raw' WHEN p LIKE '%.btmsp' THEN 'btmsp' ELSE 'other' END AS category
FROM (SELECT page_id, lower(url || list_extract(['.PKF', '.zip', '_Taxonomy.xlsx', '.xlsx', 'Metadata.pdf', '.btmsp', ''], CAST(length(html) % 7 + 1 AS INTEGER))) AS p FROM pages)""")
def file_categories(spark, sf):
    ends = F.array(*[F.lit(x) for x in (".PKF", ".zip", "_Taxonomy.xlsx", ".xlsx", "Metadata.pdf", ".btmsp", "")])
    path = F.concat("url", F.get(ends, F.length("html") % 7))
    return table(spark, sf, "pages").select("page_id", tx.file_category(path).alias("category"))


@query("label_sets", """+ g AS (SELECT cluster_id, list(DISTINCT source ORDER BY source) AS s, count(*) AS n FROM rows_ GROUP BY cluster_id)
SELECT cluster_id, to_json(s)::VARCHAR AS text, CAST(len(s) AS INTEGER) AS parsed_size, CASE WHEN len(s) = 1 THEN s[1] END AS only_label,
CAST(NULL AS VARCHAR) AS repeated FROM g""", ("rows_",))
def label_sets(spark, sf):
    sets = rows(spark, sf).groupBy("cluster_id").agg(F.collect_set("source").alias("s"))
    texts = sets.select("cluster_id", ar.sorted_json(F.col("s")).alias("text"))
    twice = F.concat(F.lit('["a","a",'), F.substr(F.col("text"), F.lit(2)))
    return texts.select(
        "cluster_id", "text", F.size(ar.parse_label_set(F.col("text"))).alias("parsed_size"),
        ar.only_member(ar.parse_label_set(F.col("text"))).alias("only_label"), ar.parse_label_set(twice).cast("string").alias("repeated"),
    )


@query("report_formats", """SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN format('{:.3f}', s_acctbal / 7) ELSE 'not estimable' END AS shown,
format('{:.3f}', s_acctbal) || ' (95% CI, ' || format('{:.3f}', s_acctbal - 1) || ' to ' || format('{:.3f}', s_acctbal + 1) || ')' AS interval_text,
'p-' || replace(format('{:.2f}', s_suppkey % 5 / 4), '.', 'p') AS prevalence, 'r-' || (s_suppkey % 5) AS intensity, round(s_acctbal / 7, 4) AS rounded FROM supplier""")
def report_formats(spark, sf):
    s = table(spark, sf, "supplier", "s_suppkey", "s_acctbal")
    b, k = F.col("s_acctbal"), F.col("s_suppkey") % 5
    out = s.select(
        "s_suppkey", fm.fixed(F.when(b > 0, b / 7)).alias("shown"), fm.interval_text(b, b - 1, b + 1).alias("interval_text"),
        fm.level_token(F.lit("prevalence"), k / 4).alias("prevalence"), fm.level_token(F.lit("intensity"), k).alias("intensity"), (b / 7).alias("rounded"),
    )
    return fm.round_numeric(out)


# ------------------------------------------------------------------ peak lists

define("matching", """ref AS (SELECT p_brand AS identity, p_partkey, p_retailprice * 50 AS mass FROM part),
loc AS (SELECT s_suppkey AS cluster_id, l_extendedprice AS mass, 'Brand#' || (s_suppkey % 40 + 1) AS identity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
local_m AS (SELECT DISTINCT identity, mass FROM loc),
dist AS (SELECT r.identity, r.p_partkey, (SELECT min(abs(l.mass - r.mass)) FROM local_m l WHERE l.identity = r.identity) AS distance FROM ref r)""")


def _match_inputs(spark, sf):
    ref = table(spark, sf, "part", "p_brand", "p_partkey", "p_retailprice").select(
        F.col("p_brand").alias("identity"), "p_partkey", (F.col("p_retailprice") * 50).alias("mass"))
    key = F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 40 + 1).cast("string"))
    loc = table(spark, sf, "lineitem", "l_suppkey", "l_extendedprice").select(
        F.col("l_suppkey").alias("cluster_id"), F.col("l_extendedprice").alias("mass"), key.alias("identity"))
    return ref, loc


@query("unambiguous_identities", """SELECT 'S' || CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey ELSE l_suppkey - l_suppkey % 4 END AS identity,
min(l_suppkey) AS cluster_id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1""")
def unambiguous_identities(spark, sf):
    key = F.when(F.col("l_suppkey") % 3 == 0, F.col("l_suppkey")).otherwise(F.col("l_suppkey") - F.col("l_suppkey") % 4)
    seen = table(spark, sf, "lineitem", "l_suppkey").select(
        F.col("l_suppkey").alias("cluster_id"), F.concat(F.lit("S"), key.cast("string")).alias("identity"))
    return mt.unambiguous_clusters(seen)


@query("ambiguous_identities", """SELECT r.identity, coalesce(n, 0) AS matched_clusters FROM (SELECT DISTINCT identity FROM ref) r
LEFT JOIN (SELECT identity, count(DISTINCT cluster_id) AS n FROM loc GROUP BY 1) USING (identity) WHERE coalesce(n, 0) <> 1""", ("matching",))
def ambiguous_identities(spark, sf):
    ref, loc = _match_inputs(spark, sf)
    return mt.ambiguous_identities(ref, loc)


@query("nearest_mass", "SELECT identity, round(mass, 4) AS mass, round(distance, 4) AS distance FROM dist JOIN ref USING (identity, p_partkey)", ("matching",))
def nearest_mass(spark, sf):
    ref, loc = _match_inputs(spark, sf)
    return rounded(mt.nearest_mass(ref, loc, ["identity"]), "mass", "distance", digits=4)


@query("match_quality", """SELECT identity, count(*) AS n_peaks, count(*) FILTER (distance <= 2) AS matched, round(avg(CASE WHEN distance <= 2 THEN 1e0 ELSE 0e0 END) FILTER (distance IS NOT NULL), 6) AS match_share,
round(max(distance), 4) AS max_error, round(median(distance), 4) AS median_error FROM dist GROUP BY identity""", ("matching",))
def match_quality(spark, sf):
    ref, loc = _match_inputs(spark, sf)
    quality = mt.match_quality(mt.nearest_mass(ref, loc, ["identity"]), ["identity"])
    return rounded(rounded(quality, "match_share"), "max_error", "median_error", digits=4)


@query("match_summary", """+ q AS (SELECT identity, avg(CASE WHEN distance <= 2 THEN 1e0 ELSE 0e0 END) AS s, max(distance) AS e FROM dist WHERE distance IS NOT NULL GROUP BY identity)
SELECT count(*) AS n_clusters, round(median(s), 6) AS median_match_share, round(min(s), 6) AS min_match_share, round(max(e), 4) AS max_error FROM q""", ("matching",))
def match_summary(spark, sf):
    ref, loc = _match_inputs(spark, sf)
    summary = mt.quality_summary(mt.match_quality(mt.nearest_mass(ref, loc, ["identity"]), ["identity"]))
    return rounded(rounded(summary, "median_match_share", "min_match_share"), "max_error", digits=4)


# ------------------------------------------------------------------ profiles

def profiles(spark, sf):
    return table(spark, sf, "events", "user_id", "ts", "value").select(
        F.col("user_id").alias("row_id"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("mass"), F.col("value").alias("intensity"))


define("prof", "prof AS (SELECT user_id AS row_id, epoch_us(ts)::DOUBLE AS mass, sqrt(value) AS y FROM events)")


def _weights_sql() -> str:
    m = 10
    return "[" + ", ".join("[" + ", ".join(f"{float(c):.17e}" for c in r) + "]" for r in sg.smoothing_rows(m)) + "]"


@query("smooth_profiles", f"""+ o AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY row_id) AS n FROM prof WINDOW w AS (PARTITION BY row_id ORDER BY mass)),
s AS (SELECT row_id, pos, mass, n, y, CASE WHEN n >= 21 THEN least(greatest(pos - 10, 0), n - 21) END AS st FROM o),
f AS (SELECT a.row_id, a.mass, sum(b.y * list_extract(list_extract({_weights_sql()}, CAST(a.pos - a.st + 1 AS INTEGER)), CAST(b.pos - a.st + 1 AS INTEGER))) AS v
  FROM s a JOIN s b ON a.row_id = b.row_id AND b.pos BETWEEN a.st AND a.st + 20 GROUP BY 1, 2)
SELECT s.row_id, s.mass, round(coalesce(f.v, s.y), 5) AS intensity FROM s LEFT JOIN f ON s.row_id = f.row_id AND s.mass = f.mass""", ("prof",))
def smooth_profiles(spark, sf):
    return rounded(sg.smooth(sg.square_root(profiles(spark, sf)), 10), "intensity", digits=5)


@query("baseline_profiles")
def baseline_profiles(spark, sf):
    return rounded(sg.preprocess(profiles(spark, sf), 10, 100), "intensity")


@query("profile_bins", """+ b AS (SELECT row_id, CAST(floor((mass - 1704067200000000) / 3600000000) AS INTEGER) AS bin, sum(y) AS v FROM prof GROUP BY 1, 2)
SELECT row_id, bin, round(v / sum(v) OVER (PARTITION BY row_id), 6) AS value FROM b WHERE bin >= 0 AND bin < 100000""", ("prof",))
def profile_bins(spark, sf):
    start, hour = 1704067200000000.0, 3600000000.0
    return rounded(sg.bin_profile(sg.square_root(profiles(spark, sf)), start, start + 100000 * hour, hour), "value")


define("peaks_of", """med AS (SELECT row_id, median(y) AS m FROM prof GROUP BY 1),
noise AS (SELECT row_id, median(abs(y - m)) * 1.4826e0 AS noise FROM prof JOIN med USING (row_id) GROUP BY 1),
top AS (SELECT *, max(y) OVER (PARTITION BY row_id ORDER BY mass ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS t FROM prof),
found AS (SELECT row_id, mass, y, noise FROM top JOIN noise USING (row_id) WHERE y = t AND y > 2e0 * noise)""", ("prof",))


@query("detect_peaks", "SELECT row_id, mass, round(y, 6) AS intensity, round(noise, 6) AS noise FROM found", ("peaks_of",))
def detect_peaks(spark, sf):
    return rounded(sg.detect_peaks(sg.square_root(profiles(spark, sf))), "intensity", "noise")


@query("profile_stats", """SELECT row_id, count(*) AS point_count, min(mass) AS min_mass, max(mass) AS max_mass,
(SELECT count(*) FROM found f WHERE f.row_id = p.row_id) AS peak_count FROM prof p GROUP BY row_id""", ("peaks_of",))
def profile_stats(spark, sf):
    points = sg.square_root(profiles(spark, sf))
    return sg.profile_stats(points, sg.detect_peaks(points))
