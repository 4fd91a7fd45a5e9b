"""Registered queries ask their operators for the whole job."""

from pyspark.sql import functions as F

from kinfold.operators import decisions as de
from kinfold.plans import open_set
from kinfold.queries import inference


def test_bootstrap_tables_runs_all_replicates_and_outcomes(spark, monkeypatch):
    asked = {}

    def stub(decisions, replicates, seed, outcomes=de.OUTCOMES, keys=("model",), explicit=None):
        asked.update(replicates=replicates, outcomes=tuple(outcomes))
        return spark.range(1).select(*[F.lit(1.0).alias(c) for c in ("estimate", "ci_low", "ci_high")]), None

    monkeypatch.setattr(inference, "decision_rows", lambda spark, sf: spark.range(1).select(F.lit("cluster_grouped").alias("design")))
    monkeypatch.setattr(open_set, "bootstrap_tables", stub)
    inference.bootstrap_tables(spark, "")
    assert asked["replicates"] == 2_000 and asked["outcomes"] == tuple(de.OUTCOMES)
