"""Shared inputs of the registered queries, as DataFrames and as SQL text.

Roles: region / nation / customer / orders play parent / label / cluster / row; lineitem
plays the peak table; embeddings plays dense vectors. Predictions are derived from the
tables by integer arithmetic, so that both engines see the same ones.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import manifest as mf
from kinfold.session import dealt

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

GRID = dict(mass_min=2000.0, mass_max=102000.0, bin_width=50.0)
N_BINS = 2000
DESIGNS, MODELS, SEEDS, FOLDS = ("row_random", "cluster_grouped"), ("m_a", "m_b"), (1, 2), 5


def compose(sql: str, ctes: tuple[str, ...]) -> str:
    """Full SQL text: shared blocks, then own blocks (after a leading ``+``) or a plain SELECT."""
    body = sql.strip()
    head = "WITH "
    if body.startswith("RECURSIVE"):
        head, body = "WITH RECURSIVE ", body[len("RECURSIVE"):].strip()
    blocks = [CTE[c] for c in _closure(ctes)]
    if body.startswith("+"):
        return head + ",\n".join([*blocks, body[1:].strip()])
    return head + ",\n".join(blocks) + "\n" + body if blocks else body


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register a query; ``ctes`` names the shared SQL blocks its text builds on."""

    def wrap(fn):
        REGISTRY[name] = fn
        if sql is not None:
            SQL[name] = compose(sql, ctes)
        return fn

    return wrap


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def joined_list(column: str):
    return F.array_join(F.col(column), ",").alias(column)


def rows(spark: SparkSession, sf: str) -> DataFrame:
    """row_id, cluster_id, label, parent, source, amount."""
    orders = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    customer = table(spark, sf, "customer", "c_custkey", "c_nationkey")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    names = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # one row per nation
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(names, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("cluster_id"), F.col("n_name").alias("label"),
            F.col("r_name").alias("parent"), F.col("o_orderpriority").alias("source"), F.col("o_totalprice").alias("amount"),
        )
    )


def peaks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem", "l_orderkey", "l_extendedprice", "l_quantity").toDF("row_id", "mass", "intensity")


@lru_cache(maxsize=None)
def minima(spark: SparkSession, sf: str) -> tuple[int, int]:
    """Membership thresholds that leave four known and ten sensitivity-known labels (ties aside)."""
    top = rows(spark, sf).groupBy("label").agg(F.countDistinct("cluster_id").alias("n")).orderBy(F.desc("n")).limit(10).collect()
    return int(top[3]["n"]), int(top[9]["n"])


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    return mf.assign_sets(rows(spark, sf), *minima(spark, sf))


@lru_cache(maxsize=None)
def known_classes(spark: SparkSession, sf: str) -> dict[str, str]:
    """Known label -> parent, in label order (a handful of names)."""
    found = manifest(spark, sf).filter("primary_known").groupBy("label").agg(F.min("parent").alias("parent")).orderBy("label").collect()
    return {r["label"]: r["parent"] for r in found}


def _members(spark: SparkSession, sf: str) -> DataFrame:
    """What cells need of the manifest."""
    return manifest(spark, sf).select("row_id", "cluster_id", "label", "parent", "primary_known", "primary_ood", "ood_distance", "ood_singleton")


def _cells(base: DataFrame, models: tuple[str, ...]) -> DataFrame:
    out = dealt(base, "cluster_id")  # whole clusters, before rows are copied to cells
    for name, values in (("design", DESIGNS), ("model", models), ("seed", SEEDS)):
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    out = out.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))))
    unit = F.when(F.col("design") == "row_random", F.col("row_id")).otherwise(F.col("cluster_id"))
    held = (unit * 3 + F.col("seed")) % FOLDS
    role = F.when(F.col("primary_ood"), "test_ood").when(F.col("fold") == held, "test_known").when(
        F.col("fold") == (held + 1) % FOLDS, "calibration")
    return out.withColumn("role", role).filter(F.col("role").isNotNull()).withColumn(
        "d", (F.col("design") == "cluster_grouped").cast("int")).withColumn("m", (F.col("model") == "m_b").cast("int"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Known rows once per (design, model, seed) and role; unknown rows once per fold."""
    parents = known_classes(spark, sf)
    classes = list(parents)
    names = F.array(*[F.lit(c) for c in classes])
    tops = F.array(*[F.lit(parents[c]) for c in classes])
    base = _cells(_members(spark, sf), MODELS)
    u = (F.col("row_id") * 7919 + F.col("seed") * 104729 + F.col("fold") * 1299 + F.col("d") * 15485 + F.col("m") * 32452) % 1000003
    base = base.withColumn("u", u)
    correct = F.col("primary_known") & (F.col("u") % 100 < F.when(F.col("d") == 0, 85).otherwise(70))
    at = F.when(correct, F.array_position(names, F.col("label")) - 1).otherwise(F.col("u") % len(classes)).cast("int")
    confidence = F.when(correct, 0.4).otherwise(0.1) + (F.col("u") % 997) / 997.0 * 0.6
    done = base.select(
        "row_id", "cluster_id", "label", "parent", "ood_distance", "ood_singleton", "design", "model", "seed", "fold", "role",
        F.get(names, at).alias("predicted"), F.get(tops, at).alias("predicted_parent"), confidence.alias("confidence"),
    )
    accepted = F.col("confidence") >= 0.6
    level = F.when(accepted, "label").when(F.col("confidence") >= 0.4, "parent").otherwise("unidentified")
    return done.select(
        "*", accepted.alias("accepted"), (F.col("predicted") == F.col("label")).alias("correct"),
        level.alias("reported_level"),
        F.when(level == "label", F.col("predicted")).when(level == "parent", F.col("predicted_parent")).otherwise(level).alias("reported_label"),
    )


def scored(spark: SparkSession, sf: str, parents: dict[str, str]) -> DataFrame:
    """Probability array over the known classes for every row of every cell of one model."""
    classes = list(parents)
    base = _cells(_members(spark, sf), MODELS[:1])

    def raw(j: int):
        noise = (F.col("row_id") * 31 + j * 1009 + F.col("seed") * 101 + F.col("fold") * 53 + F.col("d") * 17) * 7919 % 97
        bonus = F.when((F.col("label") == classes[j]) & ((F.col("row_id") + F.col("seed")) % 10 < 8), 150).otherwise(0)
        return (1 + noise + bonus).cast("double").alias(f"raw{j}")

    values = base.select("*", *[raw(j) for j in range(len(classes))])
    whole = reduce(lambda a, b: a + b, [F.col(f"raw{j}") for j in range(len(classes))])
    return values.withColumn("whole", whole).select(
        "row_id", "cluster_id", "label", "parent", "ood_distance", "ood_singleton", "design", "seed", "fold", "role",
        F.array(*[F.col(f"raw{j}") / F.col("whole") for j in range(len(classes))]).alias("probability"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as rows with a dense vector; clusters are seven per label."""
    text = F.concat(F.lit("L"), F.format_string("%02d", "label"))
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.concat(text, F.lit("-"), (F.col("vec_id") % 7).cast("string")).alias("cluster_id"),
        text.alias("label"), F.col("embedding").alias("vector"),
    )


# ---------------------------------------------------------------- shared SQL blocks

CTE: dict[str, str] = {
    "rows_": """rows_ AS (SELECT o_orderkey AS row_id, o_custkey AS cluster_id, n_name AS label, r_name AS parent,
  o_orderpriority AS source, o_totalprice AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)""",
    "peaks": "peaks AS (SELECT l_orderkey AS row_id, l_extendedprice AS mass, l_quantity AS intensity FROM lineitem)",
    "features": """binned AS (SELECT row_id, CAST(floor((mass - 2000) / 50) AS INTEGER) AS bin, sum(intensity) AS v FROM peaks
  WHERE mass >= 2000 AND mass < 102000 AND intensity > 0 GROUP BY 1, 2),
features AS (SELECT row_id, bin, v / sum(v) OVER (PARTITION BY row_id) AS value FROM binned)""",
    "manifest": """label_n AS (SELECT label, CAST(count(DISTINCT cluster_id) AS INTEGER) AS n FROM rows_ GROUP BY label),
minima AS (SELECT (SELECT n FROM label_n ORDER BY n DESC LIMIT 1 OFFSET 3) AS k, (SELECT n FROM label_n ORDER BY n DESC LIMIT 1 OFFSET 9) AS s),
near_parent AS (SELECT DISTINCT parent FROM rows_ JOIN label_n USING (label), minima WHERE n >= k),
manifest AS (SELECT r.*, n AS label_cluster_count, n >= k AS primary_known, n < k AS primary_ood, n >= s AS sensitivity_known,
  CASE WHEN n >= k THEN 'primary_known' ELSE 'ood' END AS analysis_set,
  CASE WHEN n >= k THEN NULL WHEN parent IN (SELECT parent FROM near_parent) THEN 'near' ELSE 'far' END AS ood_distance,
  (n < k AND n = 1) AS ood_singleton FROM rows_ r JOIN label_n USING (label), minima)""",
    "classes": """classes AS (SELECT label AS class, min(parent) AS class_parent, row_number() OVER (ORDER BY label) - 1 AS j,
  count(*) OVER () AS k FROM manifest WHERE primary_known GROUP BY label)""",
    "cells": """cells AS (SELECT *, CASE WHEN primary_ood THEN 'test_ood' WHEN fold = held THEN 'test_known'
  WHEN fold = (held + 1) % 5 THEN 'calibration' END AS role FROM (
  SELECT m.*, design, model, seed, fold, CASE design WHEN 'cluster_grouped' THEN 1 ELSE 0 END AS d,
  CASE model WHEN 'm_b' THEN 1 ELSE 0 END AS mm,
  ((CASE design WHEN 'row_random' THEN row_id ELSE cluster_id END) * 3 + seed) % 5 AS held
  FROM manifest m, (VALUES ('row_random'), ('cluster_grouped')) AS dd(design), (VALUES ('m_a'), ('m_b')) AS ml(model),
  (VALUES (1), (2)) AS sd(seed), (VALUES (0), (1), (2), (3), (4)) AS fd(fold)))""",
    "preds": """preds0 AS (SELECT c.*, (row_id * 7919 + seed * 104729 + fold * 1299 + d * 15485 + mm * 32452) % 1000003 AS u
  FROM cells c WHERE role IS NOT NULL),
preds1 AS (SELECT *, primary_known AND u % 100 < CASE WHEN d = 0 THEN 85 ELSE 70 END AS ok FROM preds0),
preds AS (SELECT p.row_id, p.cluster_id, p.label, p.parent, p.ood_distance, p.ood_singleton, p.design, p.model, p.seed, p.fold, p.role,
  class AS predicted, class_parent AS predicted_parent,
  CASE WHEN ok THEN 0.4e0 ELSE 0.1e0 END + (u % 997) / 997e0 * 0.6e0 AS confidence
  FROM preds1 p JOIN classes c ON (ok AND p.label = c.class) OR (NOT ok AND p.u % c.k = c.j)),
predictions AS (SELECT *, confidence >= 0.6e0 AS accepted, predicted = label AS correct,
  CASE WHEN confidence >= 0.6e0 THEN 'label' WHEN confidence >= 0.4e0 THEN 'parent' ELSE 'unidentified' END AS reported_level,
  CASE WHEN confidence >= 0.6e0 THEN predicted WHEN confidence >= 0.4e0 THEN predicted_parent ELSE 'unidentified' END AS reported_label
  FROM preds)""",
    "scored": """scored0 AS (SELECT row_id, cluster_id, label, parent, ood_distance, ood_singleton, design, seed, fold, role, j, class, class_parent,
  CAST(1 + (row_id * 31 + j * 1009 + seed * 101 + fold * 53 + d * 17) * 7919 % 97
  + CASE WHEN class = label AND (row_id + seed) % 10 < 8 THEN 150 ELSE 0 END AS DOUBLE) AS raw
  FROM cells, classes WHERE role IS NOT NULL AND model = 'm_a'),
scored AS (SELECT *, raw / sum(raw) OVER (PARTITION BY design, seed, fold, row_id) AS p FROM scored0)""",
    "vec": """vec AS (SELECT vec_id AS row_id, 'L' || lpad(label::VARCHAR, 2, '0') || '-' || (vec_id % 7)::VARCHAR AS cluster_id,
  'L' || lpad(label::VARCHAR, 2, '0') AS label, embedding FROM embeddings),
vlong AS (SELECT row_id, cluster_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS bin FROM vec),
vnorm AS (SELECT row_id, sqrt(sum(v * v)) AS norm FROM vlong GROUP BY row_id),
vunit AS (SELECT l.row_id, cluster_id, label, bin, v / norm AS v FROM vlong l JOIN vnorm USING (row_id))""",
}
_NEEDS = {
    "rows_": (), "peaks": (), "features": ("peaks",), "manifest": ("rows_",), "classes": ("manifest",), "cells": ("manifest",),
    "preds": ("cells", "classes"), "scored": ("cells", "classes"), "vec": (),
}


def _closure(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, ()):
            add(other)
        if name not in out:
            out.append(name)

    for n in names:
        add(n)
    return out


def define(name: str, text: str, needs: tuple[str, ...] = ()) -> None:
    """Add a shared SQL block."""
    CTE[name] = text
    _NEEDS[name] = needs
