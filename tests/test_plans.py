import math

import pytest
from pyspark.sql import functions as F

from kinfold.config import Study
from kinfold.functions import arrays as ar
from kinfold.operators import metrics as me
from kinfold.plans import open_set, preparation, reporting, training
from kinfold.schema import Violations
from kinfold.sources import writers


def test_study_settings():
    assert Study().bins == 11_000
    assert Study.from_json('{"seeds": [1, 2], "outer": 3}').seeds == (1, 2)
    with pytest.raises(ValueError):
        Study(coverage=1.0)


def test_preparation(spark, tmp_path):
    study = Study(mass_min=2000, mass_max=2004, known_min_clusters=2, sensitivity_min_clusters=1)
    recs, meta, digs, pk = [], [], [], []
    for i, (label, strain, n_peaks) in enumerate([("Gen_a", "s1", 2), ("Gen_a", "s2", 2), ("Gen b", "s3", 2), ("Alias x", "s4", 1), ("Nope z", "s5", 2), ("Gen b", "s3", 0)]):
        folder = f"{label}\\{strain}\\m{i}\\1"
        recs.append((f"r{i}", f"{folder}\\fid", n_peaks))
        meta.append((f"{folder}\\fid".replace("\\", "/"), folder, label, f"m{i}", "Gen", "a", strain, "", "12"))
        digs.append((f"{folder}\\fid", f"d{i}"))
        pk += [(f"r{i}", 2000.5 + j, 1.0) for j in range(n_peaks)]
    records = spark.createDataFrame(recs, "row_id string, source_path string, peak_count int")
    metadata = spark.createDataFrame(meta, "source_key string, archive_spectrum_dir string, folder_species string, folder_measurement string, gen string, spe string, str string, uie string, uid string")
    aliases = spark.createDataFrame([("Alias x", "Gen b")], "alias string, canonical string")
    labels = spark.createDataFrame([("Gen a",), ("Gen b",)], "label string")
    m = preparation.build_manifest(records, metadata, aliases, labels, spark.createDataFrame(digs, "source_path string, digest string"), study)
    got = {r["row_id"]: (r["included"], r["exclusion_reason"], r["analysis_set"], r["label"]) for r in m.collect()}
    assert got["r0"] == (True, "", "primary_known", "Gen a") and got["r3"] == (True, "", "primary_known", "Gen b")
    assert got["r4"] == (False, "unresolved-taxonomy", "excluded", "Nope z") and got["r5"][1] == "zero-peaks"
    peaks = spark.createDataFrame(pk, "row_id string, mass double, intensity double")
    preparation.prepare_features(peaks, m, study, str(tmp_path / "b"))
    features, rows, info = writers.read_bundle(spark, str(tmp_path / "b"))
    assert rows.count() == 4 and info.first()["n_bins"] == 4 and features.count() == 7
    with pytest.raises(Violations):
        preparation.build_manifest(records, metadata.limit(2), aliases, labels, spark.createDataFrame(digs, "source_path string, digest string"), study)


def test_taxonomy_summary(spark):
    listing = spark.createDataFrame([(1, "Gen a X_1"), (2, "Gen a X 1"), (3, "Gen a Y"), (4, "Other q"), (5, " ")], "ordinal long, name string")
    labels = spark.createDataFrame([("Gen a", 2), ("Gen c", 1)], "label string, declared_clusters int")
    manifest, counts, summary = preparation.taxonomy_summary(listing, labels, Study(known_min_clusters=2, sensitivity_min_clusters=1))
    row = summary.first()
    assert (row["rows"], row["clusters"], row["unresolved_rows"], row["known_labels"]) == (4, 3, 1, 1)
    assert {r["label"]: r["observed_clusters"] for r in counts.collect()} == {"Gen a": 2, "Gen c": 0}
    assert {r["row_id"]: r["replicate_ordinal"] for r in manifest.collect()}["row_000002"] == 2


PARENTS = {"A a": "A", "A b": "A", "B c": "B"}


@pytest.fixture(scope="module")
def runs(spark):
    classes, rows = sorted(PARENTS), []
    for design in ("row_random", "cluster_grouped"):
        for fold in (0, 1):
            for i in range(60):
                label = classes[i % 3]
                role = "test_known" if (i // 3) % 2 == fold else "calibration"
                noise = ((i * 37 + fold * 11 + (design == "row_random") * 5) % 19) / 19
                good = 0.4 + 0.5 * noise
                p = [good if c == label else (1 - good) / 2 for c in classes]
                if i % 7 == 0:
                    p = p[1:] + p[:1]
                rows.append((f"r{i}", f"c{i % 20}-{i % 3}", label, PARENTS[label], role, None, False, design, "m", 1, fold, p))
            for i in range(12):
                q = 0.34 + 0.05 * (i % 7)
                rows.append((f"o{i}", f"oc{i % 4}", "A z" if i % 4 < 2 else "Z z", "A" if i % 4 < 2 else "Z", "test_ood", "near" if i % 4 < 2 else "far", False, design, "m", 1, fold,
                             [q, (1 - q) / 2, (1 - q) / 2]))
    schema = ("row_id string, cluster_id string, label string, parent string, role string, ood_distance string, ood_singleton boolean, design string, model string, "
              "seed int, fold int, probability array<double>")
    return spark.createDataFrame(rows, schema).cache()


def test_open_set_correction(runs):
    tables = open_set.correct_all_runs(runs, PARENTS, 10, 3)
    decisions = tables["decisions"].cache()
    assert decisions.count() == runs.count()
    assert decisions.filter("corrected_accept AND NOT legacy_accept").count() == 0
    summary = tables["per_run"].filter("selector = 'known' AND design = 'cluster_grouped' AND fold = 0").first()
    part = decisions.filter("role = 'test_known' AND design = 'cluster_grouped' AND fold = 0")
    assert summary["corrected_label_n"] == part.filter("corrected_accept").count() and summary["n_rows"] == part.count()
    assert summary["corrected_accept__row"] == pytest.approx(part.filter("corrected_accept").count() / part.count())
    interval = tables["intervals"].filter("metric = 'corrected_accept' AND selector = 'same_parent_ood'").first()
    assert interval["ci_low"] <= interval["estimate"] <= interval["ci_high"] and interval["replicates"] == 10
    assert tables["calibration_support"].filter("level = 'parent'").select("class").distinct().count() == 2


def test_evaluate_all(runs):
    names = ar.class_array(sorted(PARENTS))
    rows = runs.withColumn("predicted", ar.argmax_label(F.col("probability"), names)).withColumn("confidence", F.array_max("probability"))
    rows = me.enrich_rows(rows, sorted(PARENTS)).withColumn("accepted", F.col("confidence") >= 0.6).withColumn(
        "reported_level", F.when(F.col("accepted"), "label").otherwise("parent")).withColumn("reported_label", F.col("parent")).cache()
    out = reporting.evaluate_all(rows, "m", 10)
    assert out["runs"].count() == 4 and out["seeds"].count() == 2
    endpoints = {r["endpoint"]: r for r in out["endpoints"].collect()}
    assert len(endpoints) == 2 and all(r["holm_adjusted_p"] >= r["p_value"] - 1e-12 for r in endpoints.values())
    seed = out["seeds"].filter("design = 'cluster_grouped'").first()
    known = rows.filter("design = 'cluster_grouped' AND role = 'test_known'").collect()
    assert seed["n_rows"] == len(known) == 60
    weights = {}
    for r in known:
        weights[r["cluster_id"]] = weights.get(r["cluster_id"], 0) + 1
    loss = sum(-math.log(r["true_probability"]) / weights[r["cluster_id"]] for r in known) / len(weights)
    assert seed["log_loss"] == pytest.approx(loss)


def test_consolidation_needs_every_cell(spark):
    m = spark.createDataFrame([("a", "d", "m", "h", 1, 0, (0.5,))], "analysis string, design string, model string, holdout string, seed int, fold int, test struct<f1: double>")
    expected = m.select("analysis", "design", "model", "holdout", "seed", "fold")
    _, flat, summary = reporting.consolidate([expected], [m], expected, ["test__f1"])
    assert flat.first()["test__f1"] == 0.5 and summary.first()["test__f1_mean"] == 0.5
    with pytest.raises(Violations):
        reporting.consolidate([expected], [m], expected.unionByName(expected.withColumn("fold", F.lit(1))), ["test__f1"])


def test_training_cell(spark):
    rows = [(f"r{l}{c}{i}", f"{l}{c}", l, l[0], [float(l == "A a") + 0.1 * c, float(l == "B b") + 0.1 * i]) for l in ("A a", "B b") for c in range(6) for i in range(3)]
    rows += [(f"o{i}", "oc", "A z", "A", [0.6, 0.5]) for i in range(2)]
    m = spark.createDataFrame(rows, "row_id string, cluster_id string, label string, parent string, vector array<double>")
    role = F.when(F.col("label") == "A z", "test_ood").when(F.substring("cluster_id", -1, 1) == "0", "test_known").when(
        F.substring("cluster_id", -1, 1) == "1", "calibration").otherwise("train")
    splits = m.drop("vector").withColumn("design", F.lit("cluster_grouped")).withColumn("seed", F.lit(1)).withColumn("fold", F.lit(0)).withColumn("role", role)
    out = training.train_grid(splits, m, ["tree_ensemble"], {"A a": "A", "B b": "B"}, numTrees=3, maxDepth=3).collect()
    assert {r["role"] for r in out} == {"calibration", "test_known", "test_ood"} and len(out) == 14
    assert all(r["predicted"] == r["label"] for r in out if r["role"] == "test_known")
    assert {r["ood_distance"] for r in out if r["role"] == "test_ood"} == {"near"}
    scores = training.centroid_grid(splits, m).collect()
    assert len(scores) == 14 and all(len(r["scores"]) == 2 for r in scores)
