"""Registered queries of the corpus operators: each over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import bitplanes, fingerprints, hyperminhash, katz, language, merkle, norm_buckets, packing, posting_lists, resampling, suffix_pieces, toxicity, url_cascade
from kinfold.llm.common import crc_fold, new_path, query

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op2_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_url_cascade", """
WITH parts AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (SELECT page_id, rule_host || rule_path AS rule, verdict FROM parts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)""")
def url_rules(spark: SparkSession, sf: str) -> DataFrame:
    return url_cascade.judge(table(spark, sf, "pages").select("page_id", "url"), RULES).drop("url")


@query("op9_bitplane_ids")
def bitplane_ids(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "ids")
    bitplanes.write_ids(table(spark, sf, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return bitplanes.read_documents(spark, path)


@query("op6_simhash_groups")
def simhash_groups(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.near_duplicates(table(spark, sf, "documents"))


@query("op4_language_spans")
def language_spans(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    fold = crc_fold("doc_id", 4)
    model = language.fit(docs.filter(fold != 2))
    return language.identify(docs, model, keep=((F.coalesce(fold == 2, F.lit(False))).alias("held_out"),)).drop("spans")


@query("op7_toxicity_trees")
def toxicity_trees(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    fold = crc_fold("doc_id", 3)
    model = toxicity.fit(docs, labels.filter(fold != 1))
    return toxicity.score(docs, model, keep=("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out")))


def every_fiftieth(vec_id):
    return vec_id % 50 == 0


@query("op1_posting_lists")
def posting_list_search(spark: SparkSession, sf: str) -> DataFrame:
    return posting_lists.search(table(spark, sf, "embeddings"), every_fiftieth)


@query("op5_norm_buckets", """
WITH whole AS (SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'max') = 0),
pairs AS (SELECT a.place, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND a.place <> b.place),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""")
def norm_bucket_search(spark: SparkSession, sf: str) -> DataFrame:
    return norm_buckets.search(table(spark, sf, "embeddings"), every_fiftieth)


@query("op8_katz_scores")
def katz_scores(spark: SparkSession, sf: str) -> DataFrame:
    return katz.score(table(spark, sf, "documents"), crc_fold("doc_id", 7) == 2)


@query("op10_suffix_pieces")
def suffix_pieces_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every text, and whether decoding gives the text back."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    plain = F.translate(F.coalesce("text", F.lit("")), suffix_pieces.META, " ")
    encoded = suffix_pieces.encode(docs, model, ("doc_id", F.crc32(plain.cast("binary")).alias("_crc")))
    out = suffix_pieces.decode(encoded, model)
    return out.select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), (F.crc32(F.col("decoded").cast("binary")) == F.col("_crc")).alias("round_trip"))


@query("op11_merkle_manifest", """
WITH RECURSIVE tab AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n,
    list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS v FROM range(256) r(n))),
seen AS (SELECT d.*, CASE WHEN xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS checked
    FROM documents d, tab),
fields AS (SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(checked) || ':' || checked, '-') AS other FROM seen),
leaves AS (SELECT doc_id, source, sha256(head || body) AS leaf, sha256(head || other) AS checked,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM fields),
lower_nodes AS (SELECT source, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM leaves
    UNION ALL SELECT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), CAST((any_value(n) + 2) // 3 AS BIGINT) FROM lower_nodes
    WHERE n > 1 GROUP BY source, level, i // 3),
subroots AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k FROM lower_nodes WHERE n = 1),
upper_nodes AS (SELECT 0 AS level, k AS i, h, count(*) OVER () AS n FROM subroots
    UNION ALL SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), CAST((any_value(n) + 2) // 3 AS BIGINT) FROM upper_nodes WHERE n > 1 GROUP BY level, i // 3),
lower_runs AS (SELECT source, level, i // 3 AS run, list(h ORDER BY i) AS hs FROM lower_nodes WHERE n > 1 GROUP BY ALL),
upper_runs AS (SELECT level, i // 3 AS run, list(h ORDER BY i) AS hs FROM upper_nodes WHERE n > 1 GROUP BY ALL),
steps AS (SELECT l.doc_id, r.level, r.hs, CAST(l.i // CAST(pow(3, r.level) AS BIGINT) % 3 AS INTEGER) AS place FROM leaves l JOIN lower_runs r
        ON r.source IS NOT DISTINCT FROM l.source AND r.run = l.i // CAST(pow(3, r.level + 1) AS BIGINT)
    UNION ALL SELECT l.doc_id, 1000 + r.level, r.hs, CAST(s.k // CAST(pow(3, r.level) AS BIGINT) % 3 AS INTEGER) FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
        JOIN upper_runs r ON r.run = s.k // CAST(pow(3, r.level + 1) AS BIGINT)),
paths AS (SELECT doc_id, list({'l': array_to_string(list_slice(hs, 1, place), ''), 'r': array_to_string(list_slice(hs, place + 2, 3), '')} ORDER BY level) AS path FROM steps GROUP BY doc_id),
folds AS (SELECT l.doc_id, l.leaf, s.h AS subroot, u.h AS root, coalesce(p.path, []) AS path, l.checked FROM leaves l
    JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source CROSS JOIN (SELECT h FROM upper_nodes WHERE n = 1) u LEFT JOIN paths p ON p.doc_id = l.doc_id),
climbed AS (SELECT doc_id, 1 AS k, checked AS h FROM folds
    UNION ALL SELECT c.doc_id, k + 1, sha256(path[k].l || h || path[k].r) FROM climbed c JOIN folds f USING (doc_id) WHERE k <= len(path))
SELECT f.doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda p: p.l || p.r), '')) AS proof_sha256, c.h AS folded_root, c.h = root AS verified
FROM folds f JOIN climbed c ON c.doc_id = f.doc_id AND c.k = len(path) + 1""")
def merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    even = F.coalesce(crc_fold("doc_id", 2) == 0, F.lit(False))
    tampered = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(docs, tampered).drop("source", "path")


@query("op12_target_resampling", r"""
WITH tab AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n,
    list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS v FROM range(256) r(n))),
texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS x FROM words),
hexed AS (SELECT x, hex(encode(x)) AS h FROM (SELECT DISTINCT x FROM features)),
hashed AS (SELECT x, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM hexed, tab),
placed AS (SELECT side, id, bucket FROM features JOIN hashed USING (x)),
counts AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM placed GROUP BY bucket),
sums AS (SELECT sum(s) AS ss, sum(t) AS tt FROM counts),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(ss + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(tt + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM counts, sums),
weights AS (SELECT id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM placed JOIN gains USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
    FROM words LEFT JOIN weights USING (id) WHERE side = 0),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)""")
def target_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.draw(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op13_hyperminhash_groups", r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS x FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sets a JOIN sets b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, s.b FROM reached r JOIN steps s ON s.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)""")
def hyperminhash_groups(spark: SparkSession, sf: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf, "documents"), size=2)
