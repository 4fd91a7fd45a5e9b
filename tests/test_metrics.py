import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions import arrays as ar
from kinfold.operators import bootstrap as bs
from kinfold.operators import calibration as cal
from kinfold.operators import curves as cv
from kinfold.operators import decisions as de
from kinfold.operators import metrics as me
from kinfold.operators import weights as wt


def test_perfect_two_class_run(spark):
    rows = [("1", "a", "A", [0.9, 0.1]), ("2", "b", "B", [0.2, 0.8])]
    df = spark.createDataFrame(rows, "row_id string, cluster_id string, label string, probability array<double>").withColumn("run", F.lit(1))
    names = ar.class_array(["A", "B"])
    df = df.withColumn("predicted", ar.argmax_label(F.col("probability"), names)).withColumn("confidence", F.array_max("probability"))
    rows = me.enrich_rows(df, ["A", "B"])
    out = me.run_scores(rows, ["run"]).first()
    assert out["macro_f1"] == 1 and out["top3_accuracy"] == 1 and out["balanced_accuracy"] == 1
    assert cv.area_under_risk(wt.evaluation_weights(rows, ["run"]), ["run"]).first()["aurc"] == 0
    known = df.select("run", F.col("confidence"), F.lit(False).alias("is_ood"))
    ood = spark.createDataFrame([(1, 0.3, True), (1, 0.4, True)], "run int, confidence double, is_ood boolean")
    det = cv.detection_metrics(known.unionByName(ood), ["run"]).first()
    assert det["auroc"] == 1 and det["auprc"] == 1 and det["fpr_at_tpr"] == 0


def test_equal_cluster_mass(spark):
    df = spark.createDataFrame([("many",)] * 3 + [("single",)], "cluster_id string")
    got = {r[0]: r[1] for r in wt.evaluation_weights(df).groupBy("cluster_id").agg(F.sum("weight")).collect()}
    assert got == pytest.approx({"many": 0.5, "single": 0.5})


def test_risk_coverage_ties(spark):
    df = spark.createDataFrame([(True, 0.9, 0.25), (False, 0.9, 0.25), (True, 0.2, 0.5)], "correct boolean, confidence double, weight double")
    df = df.withColumn("run", F.lit(0))
    got = [(r["coverage"], r["risk"]) for r in cv.risk_coverage(df, ["run"]).orderBy("coverage").collect()]
    assert got == [(0.5, 0.5), (1.0, 0.25)]
    assert cv.area_under_risk(df, ["run"]).first()["aurc"] == pytest.approx(np.trapezoid([0, 0.5, 0.25], [0, 0.5, 1]))


def test_detection_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    conf = np.round(rng.uniform(0, 1, 300), 2)
    ood = rng.uniform(0, 1, 300) < 0.4 - 0.3 * conf
    df = spark.createDataFrame([(0, float(c), bool(o)) for c, o in zip(conf, ood)], "run int, confidence double, is_ood boolean")
    got = cv.detection_metrics(df, ["run"]).first()
    s = 1 - conf
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for a in s[ood] for b in s[~ood]]
    assert got["auroc"] == pytest.approx(np.mean(pairs))
    ap, seen = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp, fp = (ood & (s >= t)).sum(), (~ood & (s >= t)).sum()
        ap += (tp / ood.sum() - seen) * tp / (tp + fp)
        seen = tp / ood.sum()
    assert got["auprc"] == pytest.approx(ap)


@pytest.mark.parametrize("n,expected", [(3, 1.0), (18, 1.0), (19, 18.0), (20, 19.0)])
def test_finite_sample_quantile(spark, n, expected):
    df = spark.createDataFrame([(0, float(i)) for i in range(n)], "run int, score double")
    assert cal.finite_sample_quantile(df, ["run"], "score").first()["threshold"] == expected


def test_lower_quantile_and_retained_fraction(spark):
    df = spark.createDataFrame([(0, v) for v in (0.51, 0.72, 0.81, 0.93, 0.99)], "run int, v double")
    assert cal.lower_quantile(df, ["run"], "v", 0.2).first()["threshold"] == 0.51
    rows = [(0, "a", 0.1)] * 10 + [(0, "b", 0.8), (0, "c", 0.9)]
    got = cal.retained_fraction_threshold(spark.createDataFrame(rows, "run int, cluster_id string, score double"), ["run"]).first()
    assert (got["threshold"], got["n_clusters"]) == (0.1, 3)
    rows = [(0, str(i), float(i)) for i in range(20)]
    assert cal.retained_fraction_threshold(spark.createDataFrame(rows, "run int, cluster_id string, score double"), ["run"]).first()["threshold"] == 1.0


def test_sparse_class_uses_the_pooled_threshold(spark):
    rows = [(0, "A", 0.1), (0, "A", 0.2), (0, "B", 0.3), (0, "B", 0.4)]
    out = cal.class_thresholds(spark.createDataFrame(rows, "run int, label string, score double"), ["run"], ["A", "B", "C"], min_rows=10).collect()
    assert len(out) == 3 and all(r["threshold"] == r["global_threshold"] and r["threshold_source"] == "pooled-fallback" for r in out)


def test_temperature_finds_the_weighted_minimum(spark):
    z, y, w = [[8.0, 0.0], [8.0, 0.0], [0.0, 8.0]], ["A", "B", "B"], [1.0, 1.0, 1.0]

    def nll(lt, weights):
        t = math.exp(lt)
        loss = [math.log(sum(math.exp(v / t) for v in r)) - r["AB".index(c)] / t for r, c in zip(z, y)]
        return np.average(loss, weights=weights)

    found = []
    for weights in (w, [1.0, 0.01, 1.0]):
        df = spark.createDataFrame(list(zip(z, y, weights)), "logits array<double>, label string, weight double")
        got = cal.fit_temperature(df, [], ["A", "B"]).first()
        grid = np.linspace(-4, 4, 16001)
        best = grid[np.argmin([nll(g, weights) for g in grid])]
        assert abs(got["log_temperature"] - best) < 1e-3
        found.append(got["temperature"])
    assert found[1] < found[0]


def decision_rows(spark):
    classes, parents = ["Alpha one", "Alpha two", "Beta one"], ["Alpha", "Beta"]
    rows = [  # the first row has a singleton that is not the argmax; the last sits exactly on tau
        ("r0", "s0", "Alpha one", "Alpha", [0.35, 0.40, 0.25], ["Alpha one"], ["Alpha"], 0.4, 0.3, True, "label", "Alpha one", "Alpha two"),
        ("r1", "s1", "Alpha two", "Alpha", [0.05, 0.90, 0.05], ["Alpha two"], ["Alpha"], 0.9, 0.3, True, "label", "Alpha two", "Alpha two"),
        ("r2", "s2", "Beta one", "Beta", [0.30, 0.35, 0.35], ["Alpha two", "Beta one"], ["Alpha"], 0.35, 0.3, False, "parent", "Alpha", "Alpha two"),
        ("r3", "s3", "Beta one", "Beta", [0.10, 0.10, 0.80], ["Beta one"], ["Beta"], 0.8, 0.8, True, "label", "Beta one", "Beta one"),
    ]
    schema = ("row_id string, cluster_id string, label string, parent string, probability array<float>, label_set array<string>, parent_set array<string>, "
              "confidence double, tau double, accepted boolean, reported_level string, reported_label string, predicted string")
    df = spark.createDataFrame(rows, schema).withColumn("label_set_size", F.size("label_set")).withColumn("parent_set_size", F.size("parent_set"))
    df, tops = cal.parent_probability(df, classes, {"Alpha one": "Alpha", "Alpha two": "Alpha", "Beta one": "Beta"})
    assert tops == parents
    return de.decision_frame(df.withColumn("run", F.lit(0)), classes, tops)


def test_corrected_rule(spark):
    out = decision_rows(spark).orderBy("row_id")
    rows = out.collect()
    assert [r["legacy_accept"] for r in rows] == [True, True, False, True]
    assert [r["corrected_accept"] for r in rows] == [False, True, False, True]
    assert (rows[0]["corrected_level"], rows[0]["corrected_label"]) == ("parent", "Alpha")
    assert de.precision_audit(out, ["run"]).first()["accepted_not_argmax"] == 1
    assert de.reproduction_violations(out).count() == 0
    assert all(r["legacy_accept"] or not r["corrected_accept"] for r in rows)


def test_cluster_mean_rule_uses_its_own_tau(spark):
    rows = [(f"r{i}", f"c{i}", "A", "P", "calibration", [0.6, 0.4] if i == 0 else [0.9, 0.1]) for i in range(20)]
    rows.append(("t", "t", "A", "P", "test_known", [0.8, 0.2]))
    df = spark.createDataFrame(rows, "row_id string, cluster_id string, label string, parent string, role string, probability array<double>").withColumn("run", F.lit(0))
    out, support = de.cluster_mean_decisions(df, ["run"], ["A", "B"], {"A": "P", "B": "Q"})
    assert support.first()["tau"] == pytest.approx(0.6)
    assert out.filter("role = 'test_known'").first()["confidence_only_accept"]


def test_probability_set_parsing(spark):
    df = spark.createDataFrame([('["a","b"]',), ('["a","a"]',), ("[]",), ('{"a":1}',), ("[1,2]",), ('["x, y"]',)], "t string")
    got = [r[0] for r in df.select(ar.parse_label_set(F.col("t"))).collect()]
    assert got == [["a", "b"], None, [], None, None, ["x, y"]]


# ------------------------------------------------------------------ bootstraps against plain Python

def hash_index(*parts, n):
    return int(hashlib.sha256("|".join(str(p) for p in parts).encode()).hexdigest()[:8], 16) % n


def by_hash(values):
    return sorted(values, key=lambda v: (hashlib.sha256(str(v).encode()).hexdigest(), v))


@pytest.fixture(scope="module")
def observations(spark):
    rng = np.random.default_rng(5)
    rows = [(l, f"{l}{c}", s, f, float(rng.integers(0, 2))) for l, n in (("A", 2), ("B", 3), ("C", 1)) for c in range(n)
            for s in (1, 2) for f in (0, 1) if not (l == "B" and c == 0 and f == 1) for _ in range(2)]
    return rows, spark.createDataFrame(rows, "label string, cluster_id string, seed int, fold int, v double").cache()


@pytest.mark.parametrize("overall", [False, True])
def test_hierarchical_bootstrap_equals_plain_python(observations, overall):
    rows, df = observations
    clusters = {l: by_hash({r[1] for r in rows if r[0] == l}) for l in "ABC"}
    labels = by_hash("ABC")
    cell = lambda c, s, f: [r[4] for r in rows if (r[1], r[2], r[3]) == (c, s, f)]
    got = {r["replicate"]: r["v"] for r in bs.hierarchical(df, ["v"], 12, 3, overall=overall).collect()}
    for b in range(12):
        picks = []
        for occ in range(3):
            label = labels[hash_index(3, b, occ, n=3)]
            n = len(clusters[label])
            picks.append([clusters[label][hash_index(3, b, occ, slot, n=n)] for slot in range(n)])
        instances = []
        for s in (1, 2):
            for f in (0, 1):
                means = [[np.mean(cell(c, s, f)) for c in group if cell(c, s, f)] for group in picks]
                means = [m for m in means if m]
                flat = [x for m in means for x in m]
                if flat:
                    instances.append(np.mean(flat) if overall else np.mean([np.mean(m) for m in means]))
        assert got[b] == pytest.approx(np.mean(instances))


def test_point_estimates_differ_by_level(spark):
    df = spark.createDataFrame([("A", "a1", 1, 0, 0.0), ("A", "a2", 1, 0, 0.0), ("B", "b1", 1, 0, 1.0)], "label string, cluster_id string, seed int, fold int, v double")
    point = lambda overall: bs.hierarchical_point(df, [], ["seed", "fold"], ["v"], overall).first()["v"]
    assert point(True) == pytest.approx(1 / 3) and point(False) == pytest.approx(1 / 2)


def test_duplicate_label_draws_are_independent(observations):
    values = {round(r["v"], 6) for r in bs.hierarchical(observations[1], ["v"], 60, 9).collect()}
    assert len(values) > 6


def test_holm_and_p_value(spark):
    df = spark.createDataFrame([("a", 0.04), ("b", 0.01), ("c", None)], "endpoint string, p_value double")
    got = {r["endpoint"]: r["holm_adjusted_p"] for r in bs.holm(df).collect()}
    assert got == {"a": pytest.approx(0.04), "b": pytest.approx(0.02), "c": None}
    draws = spark.createDataFrame([(0, x) for x in (-1.0, 0.0, 1.0, 2.0)], "k int, v double")
    assert bs.one_sided_p(draws, ["k"], "v").first()["p_value"] == pytest.approx(3 / 5)


def test_equal_cluster_means_tie_at_any_partitioning(spark):
    from kinfold.operators import rates as rt

    orders = ([0.1, 0.2, 0.3], [0.3, 0.2, 0.1], [0.2, 0.3, 0.1], [0.3, 0.1, 0.2])
    rows = [(1, f"c{k}", "test_ood" if k % 2 else "test_known", s) for k in range(8) for s in orders[k % 4]]
    df = spark.createDataFrame(rows, "run int, cluster_id string, role string, confidence double")
    found = {tuple(cv.detection_metrics(rt.cluster_scores(df.repartition(n), ["run"]), ["run"]).first()) for n in (1, 4, 8)}
    assert len(found) == 1
    assert cv.detection_metrics(rt.cluster_scores(df, ["run"]), ["run"]).first()["auroc"] == 0.5


@pytest.mark.parametrize("sent", [0, 200_000])
def test_draws_meet_records_either_way(spark, monkeypatch, sent):
    """Records above the limit are merged by key instead of sent; both count every draw once."""
    monkeypatch.setattr(bs, "SENT_RECORDS", sent)
    records = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), (None, 0, 5.0)], "k string, index long, v double")
    draws = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1), (None, 0)], "k string, index long")
    met = bs.meet_draws(draws, records, ["k", "index"])
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == (sent > 0) and sorted(r.v for r in met.collect()) == [1.0, 2.0, 2.0, 5.0]


def test_drawn_sums_equal_a_join_and_hold_no_row_per_draw_and_record(spark, monkeypatch):
    monkeypatch.setattr(bs, "BLOCK", 7)
    monkeypatch.setattr(bs, "PACKED", 50)
    monkeypatch.setattr(bs, "COUNTED", 40)
    draws = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("k"), (F.col("id") % 11).alias("replicate"), (F.col("id") * 37 % 23).alias("index"))
    records = spark.range(60).select(
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("k"), (F.col("id") % 20).alias("index"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("g"), F.col("id").alias("n"), (F.col("id") / 4).alias("v"))
    got = bs.drawn_sums(draws, records, ["k"], "replicate", ["g"], ["n", "v"])
    plain = draws.alias("d").join(records.alias("r"), (F.col("d.k").eqNullSafe(F.col("r.k"))) & (F.col("d.index") == F.col("r.index")))
    want = plain.groupBy("d.k", "replicate", "g").agg(F.sum("n"), F.sum("v"))
    assert dict(got.dtypes)["n"] == "bigint" and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert "Join" not in pack_plan(bs.pack_draws(draws.select(F.lit(1).cast("long").alias("place"), F.col("replicate").alias("run"), "index")))


def pack_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packed_slots_are_the_draws_of_the_hash_rule(spark, monkeypatch):
    monkeypatch.setattr(bs, "BLOCK", 16)
    monkeypatch.setattr(bs, "SLOT_CHUNK", 10)
    sizes = spark.createDataFrame([("a", None, 45), ("b", 0.25, 3)], "k string, level double, n_units long")
    packed = bs.resample(sizes, ["k", "level"], [], 4, 7)
    got = {}
    for r in packed.collect():
        got.setdefault((r["place"], r["run"]), []).extend((np.frombuffer(r["body"], "<u2").astype(int) + 16 * r["block"]).tolist())
    names = {r["p"]: r["k"] for r in sizes.select(bs._number(["k", "level"]).alias("p"), "k").collect()}
    for (place, run), found in got.items():
        k, level, n = ("a", "", 45) if names[place] == "a" else ("b", "0.25", 3)
        want = [int(hashlib.sha256(f"7|{run}|{k}|{level}|{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)]
        assert sorted(found) == sorted(want)
    assert len(got) == 8
