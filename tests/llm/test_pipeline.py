"""The pipeline's stages and its queries over the smallest tables."""

import random
import time
import tracemalloc

import __spark_entry__ as entry
import corpus_pipeline
import numpy as np
from kinfold.llm import fingerprints
from kinfold.llm.common import CLEANUP, stage

SMALL = "/root/testdata/sf0.001"


def test_names():
    names = list(entry.queries())
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


def test_stages_on_odd_rows(spark):
    random_ = random.Random(3)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = " ".join(random_.choices(docs.first().text.split(), k=100))
    odd = spark.createDataFrame([(None, text, "en", None, 1), (9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, text, None, "s", 1), (9003, text, None, "s", 1), (9004, "12 !", "fr", "s", 4)], docs.schema)
    clash = docs.unionByName(odd).selectExpr("*", "1 AS predicted", "'x' AS features", "2 AS score", "'y' AS spans", "3 AS sequence_id")
    now = clash
    for name, step in corpus_pipeline.STAGES[:-1]:
        before, now = now, step(spark, now, SMALL)
        assert now.columns == clash.columns, name
        kept = {(r.doc_id, r.text) for r in now.collect()}
        assert kept <= {(r.doc_id, r.text) for r in before.collect()}
    assert (9003, text) in kept and (9001, None) not in kept and (9004, "12 !") not in kept
    assert len(kept) == now.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SMALL)
    assert packed.select("doc_id").distinct().count() == len({i for i, _ in kept})
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), SMALL).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_staged_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        names = (files.apply(i).getName() for i in range(files.size()))
        return {n for n in names if n.startswith("shuffle_")}

    before, conf = shuffles(), spark.conf.get(CLEANUP, None)
    table = spark.range(1000).repartition(3, "id").groupBy("id").count()
    staged = stage(table, "test")  # ``table`` still refers to its shuffles
    for _ in range(40):
        left = shuffles() - before
        if not left:
            break
        time.sleep(0.25)
    assert not left and staged.count() == 1000 and table.count() == 1000
    assert spark.conf.get(CLEANUP, None) == conf


def test_forest_of_a_crowd_holds_few_links():
    draws, n = np.random.default_rng(1), 1800
    lanes = np.tile(draws.integers(0, 2**63, 16).astype(np.uint64), (n, 1))
    for _ in range(6):
        lanes[np.arange(n), draws.integers(0, 16, n)] ^= np.uint64(1) << draws.integers(0, 63, n).astype(np.uint64)
    tracemalloc.start()
    a, b, _ = fingerprints.forest(np.zeros(n, np.int64), np.zeros(n, np.int8), np.arange(n), lanes, 100)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) == n - 1 and len(set(a.tolist()) | set(b.tolist())) == n
    assert most < 70_000_000
