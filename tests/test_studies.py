import pytest
from pyspark.sql import functions as F

from kinfold.operators import audits as au
from kinfold.operators import contamination as ct
from kinfold.operators import identity as idn
from kinfold.operators import scoring as sc
from kinfold.plans import contamination_study as study
from kinfold.plans import identity_exclusion as ie
from kinfold.schema import Violations, assert_empty
from kinfold.sources import readers, writers

INT = ct.Experiment("intensity", 5, 5, (0.0, 1.0, 2.0, 4.0))
PREV = ct.Experiment("prevalence", 2, 2, (0.0, 0.25, 0.5, 0.75, 1.0))


@pytest.fixture(scope="module")
def cohort_rows(spark):
    rows = [(f"{l}-{c}-{r}", f"{l}-{c}", l) for l in ("A a", "B b") for c in range(10) for r in range(5)]
    return spark.createDataFrame(rows, "row_id string, cluster_id string, label string").cache()


def test_rotations_cover_each_block_once(cohort_rows):
    parts = study.prepare(cohort_rows, INT, [1])
    roles = parts["roles"].collect()
    for rotation in range(5):
        part = [r for r in roles if r["rotation"] == rotation]
        assert sum(r["cluster_role"] == "evaluation" for r in part) == 4 and sum(r["cluster_role"] == "donor" for r in part) == 4
    assert len({r["cluster_id"] for r in roles if r["cluster_role"] == "evaluation"}) == 20
    sizes = {(r["rotation"], r["level"], r["arm"]): r["n"] for r in parts["injected"].groupBy("rotation", "level", "arm").agg(F.count("*").alias("n")).collect()}
    assert {sizes[(0, level, "leakage")] for level in (1.0, 2.0, 4.0)} == {4, 8, 16}
    assert all(sizes[(r, l, "leakage")] == sizes[(r, l, "matched_control")] for r in range(5) for l in (1.0, 2.0, 4.0))
    assert ct.training_violations(parts["training"]).count() == 0


def test_cohort_does_not_depend_on_row_order(cohort_rows):
    a = ct.build_cohort(cohort_rows, PREV)[0].select("row_id", "selected_rank")
    b = ct.build_cohort(cohort_rows.orderBy(F.rand(3)), PREV)[0].select("row_id", "selected_rank")
    assert a.exceptAll(b).count() == 0 and a.count() == 40


def test_exposure_is_nested_and_exact(cohort_rows):
    parts = study.prepare(cohort_rows, PREV, [1])
    exposed = ct.exposed_pairs(parts["pairs"], PREV).filter("rotation = 0").collect()
    by_level = {l: {r["pair_id"] for r in exposed if r["level"] == l} for l in (0.25, 0.5, 0.75, 1.0)}
    assert [len(by_level[l]) for l in (0.25, 0.5, 0.75, 1.0)] == [1, 2, 3, 4]
    assert by_level[0.25] <= by_level[0.5] <= by_level[0.75] <= by_level[1.0]
    with pytest.raises(Violations):
        ct.exposed_pairs(parts["pairs"], ct.Experiment("prevalence", 2, 2, (0.0, 0.3)))


def test_identity_components(spark):
    rows = [("s1", "A"), ("s2", "A"), ("s3", "B"), ("s3", "C"), ("s4", "C"), ("s5", "D"), ("s6", " ")]
    base = [(f"r{i}", c, i_, c == "s3", "L", "P") for i, (c, i_) in enumerate(rows)]
    m = spark.createDataFrame(base, "row_id string, cluster_id string, identity string, identity_conflict boolean, label string, parent string")
    summary, excluded = idn.component_tables(m)
    got = {r["cluster_id"]: r["reason"] for r in excluded.collect()}
    assert set(got) == {"s1", "s2", "s3", "s4"} and got["s3"].startswith("within_cluster_conflict;")
    assert summary.filter("NOT excluded").count() == 2


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).select(F.format_string("n%05d", "id").alias("u"), F.format_string("n%05d", F.col("id") + 1).alias("v"))
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v"))
    assert idn.connected_components(nodes, edges).select("component").distinct().collect() == [("n00000",)]


def test_isolation_audit(spark):
    m = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "Y")], "cluster_id string, identity string")
    s = spark.createDataFrame([("1", "a", "train"), ("2", "b", "test_known"), ("3", "c", "train")], "row_id string, cluster_id string, role string")
    s = s.select("*", F.lit("cluster_grouped").alias("design"), F.lit(1).alias("seed"), F.lit(0).alias("fold"))
    row = idn.isolation_audit(m, s).first()
    assert row["train__test_known__identity_overlap"] == 1 and not row["passed"]
    clean = idn.isolation_audit(m, s, spark.createDataFrame([("b",)], "cluster_id string")).first()
    assert clean["any_overlap"] == 0 and clean["passed"]


def leakage_tables(spark, extra=()):
    rows = [(f"r{i}", c, l, p if d == "row_random" else q, d) for d in ("row_random", "cluster_grouped")
            for i, (c, l, p, q) in enumerate([("c1", "A", "A", "A"), ("c1", "A", "A", "B"), ("c2", "B", "B", "A"), ("bad", "A", "B", "B")])]
    rows += list(extra)
    known = spark.createDataFrame(rows, "row_id string, cluster_id string, label string, predicted string, design string").withColumn("seed", F.lit(1))
    clusters = known.select("cluster_id", "label", "predicted", "design", "seed").dropDuplicates(["cluster_id", "design"])
    return known, clusters, spark.createDataFrame([("bad",)], "cluster_id string")


def test_clean_leakage(spark):
    metrics, deltas, summary, cohorts = ie.clean_leakage(*leakage_tables(spark))
    assert all((r["n_rows"], r["n_clusters"]) == (3, 2) for r in metrics.collect())
    assert deltas.count() == 3 and summary.count() == 3 and cohorts.first()["passed"]
    with pytest.raises(Violations):
        ie.clean_leakage(*leakage_tables(spark, [("x", "c1", "A", "A", "row_random")]))


@pytest.mark.parametrize("cells", [4_000_000, 2])
def test_reference_library_ties(spark, cells):
    rows = [("0", "z", "Alpha", [2.0, 0.0]), ("1", "z", "Alpha", [4.0, 0.0]), ("2", "a", "Alpha", [1.0, 0.0]), ("3", "b", "Beta", [0.0, 2.0])]
    train = spark.createDataFrame(rows, "row_id string, cluster_id string, label string, vector array<double>")
    templates = sc.mean_templates(train, ["cluster_id", "label"])
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("t", [1.0, 1.0])], "row_id string, vector array<double>")
    got = {r["row_id"]: r for r in sc.rank_labels(sc.dense_label_scores(q, templates, block_cells=cells), []).collect()}
    assert (got["q"]["predicted"], got["q"]["winning_cluster"]) == ("Alpha", "a")
    assert got["t"]["predicted"] == "Alpha" and got["t"]["top_labels"] == ["Alpha", "Beta"]
    assert got["t"]["score"] == pytest.approx(2**-0.5) and got["t"]["margin"] == pytest.approx(0, abs=1e-15)


def test_template_mean_divides_by_all_rows(spark):
    f = spark.createDataFrame([("1", 0, 1.0), ("2", 1, 1.0), ("2", 0, 1.0)], "row_id string, bin int, value double")
    rows = spark.createDataFrame([("1", "c", "L"), ("2", "c", "L")], "row_id string, cluster_id string, label string")
    got = {r["bin"]: r["value"] for r in sc.cluster_templates(f, rows).collect()}
    assert got[0] / got[1] == pytest.approx(2.0)


def test_ledger_detects_changes(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one")
    (tmp_path / "d" / "b.txt").write_text("two")
    before = readers.file_inventory(spark, str(tmp_path / "d")).collect()
    declared = spark.createDataFrame(before)
    (tmp_path / "d" / "b.txt").write_text("TWO")
    (tmp_path / "d" / "c.txt").write_text("three")
    got = {r["path"].rsplit("/", 1)[1]: r["status"] for r in au.reconcile(declared, readers.file_inventory(spark, str(tmp_path / "d"))).collect()}
    assert got == {"b.txt": "changed", "c.txt": "extra"}


def test_measurement_digest(spark, tmp_path):
    import hashlib
    (tmp_path / "m1").mkdir()
    (tmp_path / "m2").mkdir()
    (tmp_path / "m1" / "fid").write_bytes(b"\x01\x02")
    (tmp_path / "m1" / "acqus").write_bytes(b"q")
    (tmp_path / "m2" / "acqu").write_bytes(b"x")
    got = {r["directory"].rsplit("/", 1)[1]: r["digest"] for r in readers.measurement_digests(spark, str(tmp_path)).collect()}
    assert got == {"m1": hashlib.sha256(b"fid\0\x01\x02acqus\0q").hexdigest()}


def test_acquisition_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "acqu").write_text("##TITLE= t\n##$AQ_DATE= <2019-01-02>\n##$CMT1= <#GEN=Bacillus#SPE=cereus#STR=S 1#UIE=#UID=77>\n##$CMT2= plain\n##$CMT3= <#CUS= Lab >\n")
    row = readers.read_acquisition(spark, str(tmp_path)).first()
    assert (row["raw_species_label"], row["taxid"], row["acquisition_date"], row["measurement_label"], row["source_lab"]) == (
        "Bacillus cereus", 77, "2019-01-02", "plain", "Lab")


def test_json_sources(spark, tmp_path):
    from pyspark.sql import types as T
    (tmp_path / "e.json").write_text('{"records": [{"row_id": "a", "peak_count": 3},\n {"row_id": "b", "peak_count": 0}]}')
    schema = T.StructType([T.StructField("row_id", T.StringType()), T.StructField("peak_count", T.IntegerType())])
    got = readers.read_export_manifest(spark, str(tmp_path / "e.json"), schema).orderBy("profile_row").collect()
    assert [(r["profile_row"], r["row_id"], r["peak_count"]) for r in got] == [(0, "a", 3), (1, "b", 0)]
    (tmp_path / "al.json").write_text('{"alias_map": {"x": "y"}}')
    assert readers.read_aliases(spark, str(tmp_path / "al.json")).collect() == [("x", "y")]
    (tmp_path / "m.jsonl").write_text('{"archive_spectrum_dir": "a\\\\b", "uid": 5}\n')
    row = readers.read_metadata(spark, str(tmp_path / "m.jsonl"), ["archive_spectrum_dir", "uid"]).first()
    assert (row["source_key"], row["uid"]) == ("a/b/fid", "5")


def test_bundle_round_trip_and_split_table(spark, tmp_path):
    f = spark.createDataFrame([("a", 0, 0.5), ("a", 2, 0.5)], "row_id string, bin int, value double")
    rows = spark.createDataFrame([("a",), ("b",)], "row_id string")
    writers.write_bundle(f, rows, str(tmp_path / "b"), 4, {"bin_width": 1.0})
    _, _, meta = writers.read_bundle(spark, str(tmp_path / "b"))
    assert (meta.first()["nnz"], meta.first()["density"]) == (2, 0.25)
    writers.write_bundle(f, rows.filter("row_id = 'b'"), str(tmp_path / "c"), 4, {})
    with pytest.raises(Violations):
        writers.read_bundle(spark, str(tmp_path / "c"))
    s = spark.createDataFrame([("a", 1, "d", 0), ("a", 2, "d", 1)], "row_id string, seed int, design string, fold int")
    writers.write_splits(s, str(tmp_path / "s"))
    header = writers.split_header(writers.read_splits(spark, str(tmp_path / "s"))).first()
    assert (header["seeds"], header["folds"], header["assignments"]) == ([1, 2], [0, 1], 2)


def test_peak_sources(spark, tmp_path):
    (tmp_path / "p.csv").write_text("row_id,mass,intensity,scan\na,2000.5,1.5,0\nb,bad,2,0\n")
    got = readers.read_peaks(spark, str(tmp_path / "p.csv")).collect()
    assert [tuple(r) for r in got] == [("a", 2000.5, 1.5), ("b", None, 2.0)]


def test_only_complete_runs_are_read(spark, tmp_path):
    p = spark.createDataFrame([("r", "d", "m", 1, 0), ("r", "d", "m", 1, 1)], "row_id string, design string, model string, seed int, fold int")
    writers.write_table(p, str(tmp_path / "p"), partition_by=["design", "model", "seed", "fold"])
    runs = spark.createDataFrame([("d", "m", 1, 0, "complete"), ("d", "m", 1, 1, "running")], "design string, model string, seed int, fold int, status string")
    writers.write_table(runs, str(tmp_path / "r"))
    assert [r["fold"] for r in readers.read_runs(spark, str(tmp_path / "p"), str(tmp_path / "r")).collect()] == [0]


def test_assert_empty(spark):
    assert_empty(spark.range(0), "none")
    with pytest.raises(Violations):
        assert_empty(spark.range(1), "one")


def test_write_ledger_checks_runs(spark, tmp_path):
    from kinfold.sources import writers

    files = spark.createDataFrame([("a.txt", 3)], "path string, bytes long")
    expected = spark.createDataFrame([(1, 0), (1, 1)], "seed int, fold int")
    writers.write_ledger(files, expected.withColumn("ok", F.lit(True)), expected, str(tmp_path / "ledger"))
    assert spark.read.json(str(tmp_path / "ledger" / "expected")).count() == 2
    with pytest.raises(Violations):
        writers.write_ledger(files, expected.limit(1).withColumn("ok", F.lit(True)), expected, str(tmp_path / "other"))
