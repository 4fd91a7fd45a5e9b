"""Cells of rows that were dealt by cluster: means and counts without a copy or another shuffle of the rows."""

from pyspark.sql import functions as F

from kinfold.operators import metrics as me
from kinfold.operators import rates as rt
from kinfold.queries import base
from kinfold import session


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_means_of_known_size_multiply_no_rows(spark):
    rows = [("a", [1.0, 3.0]), ("a", [2.0, None]), ("b", [4.0, 5.0]), ("c", None)]
    df = spark.createDataFrame(rows, "cluster_id string, p array<double>")
    out = me.mean_vectors(df, ["cluster_id"], "p", 2)
    plain = {r["cluster_id"]: r["p"] for r in me.mean_vectors(df, ["cluster_id"], "p").collect()}
    assert {r["cluster_id"]: r["p"] for r in out.collect()} == plain == {"a": [1.5, 3.0], "b": [4.0, 5.0]}
    assert "Generate" not in plan(out)


def test_false_acceptance_counts_clusters_and_labels_without_copies(spark):
    rows = [(1, "c1", "x", "near", True), (1, "c1", "y", "near", False), (1, "c2", "x", "far", True), (1, None, "x", "far", None)]
    df = spark.createDataFrame(rows, "run int, cluster_id string, label string, ood_distance string, accepted boolean").withColumn("role", F.lit("test_ood"))
    out = me.false_acceptance(df, ["run"])
    got = {r["population"]: tuple(r)[2:] for r in out.collect()}
    assert got == {"all": (4, 2, 2, 2, 2 / 3), "same-parent": (2, 1, 2, 1, 0.5), "different-parent": (2, 1, 1, 1, 1.0)}
    assert "Expand" not in plan(out)


def test_cells_are_summed_by_cluster_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(session, "DEALT", 10)
    traits = "label string, parent string, primary_known boolean, primary_ood boolean, ood_distance string, ood_singleton boolean"
    rows = [(i, i % 7, "x", "p", i % 2 == 0, i % 2 == 1, "near", False) for i in range(90)]
    df = spark.createDataFrame(rows, f"row_id long, cluster_id long, {traits}")
    cells = base._cells(df, ("m_a",)).withColumn("confidence", F.lit(0.5))
    assert cells.rdd.getNumPartitions() == 9
    summed = rt.cluster_scores(cells, ["design", "model", "seed"])
    text = summed._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1  # rows by cluster, before they are copied
