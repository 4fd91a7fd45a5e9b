import unicodedata

from pyspark.sql import functions as F

from kinfold.functions import text as tx
from kinfold.operators import manifest as mf
from kinfold.operators import splits as sp
from kinfold.schema import MissingColumns
import pytest


def test_membership_schemes_overlap(spark):
    rows = [(f"{l}{c}", f"{l}{c}", l, l[0]) for l, n in (("A a", 5), ("B b", 3), ("C c", 1)) for c in range(n)]
    out = mf.assign_sets(spark.createDataFrame(rows, "row_id string, cluster_id string, label string, parent string"), 5, 3)
    b = out.filter("label = 'B b'").collect()
    assert all(r["primary_ood"] and r["sensitivity_known"] and r["ood_distance"] == "far" for r in b)
    assert out.filter("ood_singleton").select("label").distinct().collect()[0][0] == "C c"


def test_exclusion_reasons_in_order(spark):
    rows = [
        ("r1", "c1", "matched", 3, "d1"), ("r2", "c1", "matched", 3, "d1"), ("r3", "c2", "unresolved", 0, "d3"),
        ("r4", "c2", "unresolved", 2, "d4"), ("r5", "c3", "matched", 2, None),
    ]
    df = spark.createDataFrame(rows, "row_id string, cluster_id string, taxonomy_status string, peak_count int, digest string")
    got = {r["row_id"]: (r["included"], r["exclusion_reason"]) for r in mf.apply_inclusion(df).collect()}
    assert got == {"r1": (True, ""), "r2": (False, "exact_raw_duplicate"), "r3": (False, "zero-peaks"),
                   "r4": (False, "unresolved-taxonomy"), "r5": (False, "")}


def test_prefix_needs_a_word_boundary(spark):
    names = spark.createDataFrame([("Bacillus cereus X",), ("Bacillus cereusY",), ("bacillus CEREUS",), ("Bacillus sp. 4",)], "name string")
    labels = spark.createDataFrame([("Bacillus",), ("Bacillus cereus",), ("Bacillus sp.",)], "label string")
    got = {r["name"]: r["matched"] for r in mf.match_longest_prefix(names, labels, "name", "label").collect()}
    assert got == {"Bacillus cereus X": "Bacillus cereus", "Bacillus cereusY": "Bacillus", "bacillus CEREUS": "Bacillus cereus",
                   "Bacillus sp. 4": "Bacillus sp."}


def test_label_normalisation(spark):
    raw = ["  A_b//c  ", "ｆｕｌｌ　width", "x y z", None, "Straße|B", "ﬁne"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, v string")
    got = [r[1] for r in df.select("i", tx.normalize_label(F.col("v"))).orderBy("i").collect()]
    assert got[:4] == ["A b c", "full width", "x y z", ""] and got[5] == unicodedata.normalize("NFKC", "ﬁne")
    folded = [r[1] for r in df.select("i", tx.fold_identity(F.col("v"))).orderBy("i").collect()]
    assert folded[4] == "strasse b"


def test_group_path(spark):
    df = spark.createDataFrame([("g\\s\\c\\m\\1\\a", "m"), ("g/s/c/x/1/1SLin/fid", ""), ("a/b", "zz")], "p string, m string")
    got = [r[0] for r in df.select(tx.group_path(F.col("p"), F.col("m"))).collect()]
    assert got == ["g/s/c", "g/s/c", "a/b"]


def test_label_classes(spark):
    df = spark.createDataFrame([("Bacillus cereus",), ("Bacillus sp.",), ("bacillus x",), ("A b c",)], "l string")
    got = [(r[0], r[1]) for r in df.select(tx.label_type(F.col("l")), tx.is_explicit_binomial(F.col("l"))).collect()]
    assert got == [("explicit_binomial", True), ("sp_unspecified", False), ("other", True), ("other", False)]


def test_required_columns(spark):
    with pytest.raises(MissingColumns):
        mf.assign_sets(spark.createDataFrame([(1,)], "row_id int"))


@pytest.fixture(scope="module")
def bundle(spark):
    rows = [(f"k{l}-{c}-{r}", f"k{l}-{c}", f"K {l}", "K", "primary_known", True) for l in range(6) for c in range(5) for r in range(3)]
    rows += [(f"o{l}-{c}-{r}", f"o{l}-{c}", f"O {l}", "O", "ood", False) for l, n in enumerate((2, 2, 1)) for c in range(n) for r in range(3)]
    return spark.createDataFrame(rows, "row_id string, cluster_id string, label string, parent string, analysis_set string, sensitivity_known boolean").cache()


def test_splits_are_leak_free_and_repeatable(bundle):
    splits = sp.build_splits(bundle, [7], 5).cache()
    grouped = splits.filter("design = 'cluster_grouped'")
    assert sp.role_overlap(grouped.filter("role != 'test_ood'")).count() == 0
    assert splits.filter("label LIKE 'O%' AND role != 'test_ood'").count() == 0
    assert splits.exceptAll(sp.build_splits(bundle.orderBy(F.desc("row_id")), [7], 5)).count() == 0
    per_fold = grouped.filter("role = 'test_known'").groupBy("fold", "label").agg(F.countDistinct("cluster_id").alias("n")).collect()
    assert all(r["n"] == 1 for r in per_fold)
    cal = grouped.filter("role = 'calibration'").groupBy("fold", "label").agg(F.countDistinct("cluster_id").alias("n")).collect()
    assert all(r["n"] == 1 for r in cal)


def test_hot_label_is_cut_without_changing_the_split(bundle, monkeypatch):
    known = bundle.filter("analysis_set = 'primary_known'")
    plain = sp.row_random_splits(known, [7], 5)
    from kinfold.operators import ranking
    original = ranking.rank_in_group
    monkeypatch.setattr(ranking, "rank_in_group", lambda *a, **k: original(*a[:6], 4, None))
    assert plain.exceptAll(sp.row_random_splits(known, [7], 5)).count() == 0


def test_unknown_label_in_calibration_is_reported(bundle):
    splits = sp.build_splits(bundle, [7], 5)
    moved = splits.withColumn("role", F.when((F.col("label") == "O 0") & (F.col("fold") == 0), "calibration").otherwise(F.col("role")))
    extra = splits.filter("label = 'O 0' AND fold = 0")
    found = sp.split_violations(moved.unionByName(extra).filter("design = 'cluster_grouped'")).select("rule").distinct().collect()
    assert "unknown label used for fitting" in {r[0] for r in found}


def test_too_few_clusters_raise(bundle):
    with pytest.raises(ValueError):
        sp.build_splits(bundle, [7], 6)


def test_source_holdout(spark):
    rows = []
    for l in ("A", "B"):
        for c in range(7):
            for r in range(2):
                src = "H" if c == 6 or (c == 5 and r == 0) else "Z"
                rows.append((f"{l}{c}{r}", f"{l}{c}", l, "P", src))
    m = spark.createDataFrame(rows, "row_id string, cluster_id string, label string, parent string, source string")
    cohort, counts = sp.source_cohorts(m, ["H"])
    assert all((r["held_clusters"], r["nonheld_clusters"]) == (2, 5) for r in counts.collect())
    splits = sp.source_splits(m, cohort, [1, 2]).cache()
    assert sp.source_split_violations(splits).count() == 0
    assert {r["role"] for r in splits.filter("cluster_id = 'A5'").collect()} == {"test_source"}
    dropped = m.filter("cluster_id != 'A6'")
    assert {r["label"] for r in sp.source_cohorts(dropped, ["H"])[0].collect()} == {"B"}


def test_names_match_beyond_ascii(spark):
    from kinfold.operators import manifest as mf

    paths = spark.createDataFrame([("x/STRASSE_ﬁn/1",), ("y/Ångström/2",)], "path string")
    names = spark.createDataFrame([("Straße fin",), ("ångström",)], "name string")
    got = {r["path"]: r["matched"] for r in mf.match_longest_substring(paths, names, "path", "name").collect()}
    assert got == {"x/STRASSE_ﬁn/1": "Straße fin", "y/Ångström/2": "ångström"}
