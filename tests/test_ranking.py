"""Hot-group paths must give the plain answer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import ranking as rk


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(0)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, float(np.round(rng.beta(5, 1), 3))) for i in range(900)]
    return spark.createDataFrame(rows, "g string, id long, s double").cache()


def test_cut_rank_equals_window_rank(scores):
    token = F.sha2(F.col("id").cast("string"), 256)
    plain = {(r["g"], r["id"]): (r["rank"], r["n"]) for r in rk.hash_rank(scores, ["g"], token, ["id"], size="n").collect()}
    cut = {(r["g"], r["id"]): (r["rank"], r["n"]) for r in rk.hash_rank(scores, ["g"], token, ["id"], size="n", hot_rows=50).collect()}
    assert plain == cut


def test_global_rank(scores):
    token = F.sha2(F.col("id").cast("string"), 256)
    ranks = sorted(r["rank"] for r in rk.hash_rank(scores, [], token, ["id"], hot_rows=100).collect())
    assert ranks == list(range(1, 901))


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(scores, descending):
    out = rk.running_totals(scores, ["g"], "s", {"c": F.count("*"), "w": F.sum("id")}, descending).collect()
    pdf = scores.toPandas()
    for r in out:
        part = pdf[pdf.g == r["g"]]
        upto = part[part.s >= r["s"]] if descending else part[part.s <= r["s"]]
        assert (r["c__cum"], r["w__cum"], r["c__all"]) == (len(upto), upto.id.sum(), len(part))


def test_order_statistic_and_quantiles(scores):
    pdf = scores.toPandas()
    got = {r["g"]: r for r in rk.quantiles(scores, ["g"], "s", {"lo": 0.025, "mid": 0.5, "hi": 0.975}).collect()}
    third = {r["g"]: r["threshold"] for r in rk.order_statistic(scores, ["g"], "s", F.lit(3)).collect()}
    for g, part in pdf.groupby("g"):
        assert np.allclose([got[g]["lo"], got[g]["mid"], got[g]["hi"]], np.quantile(part.s, [0.025, 0.5, 0.975]))
        assert third[g] == sorted(part.s)[2]


def test_group_size(scores):
    out = rk.add_group_size(scores, ["g"]).groupBy("g").agg(F.max("group_size").alias("m"), F.count("*").alias("n")).collect()
    assert all(r["m"] == r["n"] for r in out)


def test_numeric_order_is_cut_inside_each_group(scores):
    from kinfold.operators.manifest import ordinal_in_group
    plain = ordinal_in_group(scores, "g", "id", "r")
    assert plain.exceptAll(ordinal_in_group(scores, "g", "id", "r", hot_rows=40)).count() == 0
