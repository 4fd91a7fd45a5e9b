"""Permutation control: counts of all permutations against plain centroids, whatever is sent at once."""

import numpy as np

from kinfold.operators import models as md


def test_confusion_of_permutations_equals_plain_centroids(spark, monkeypatch):
    rng = np.random.default_rng(4)
    clusters = [f"c{i}" for i in range(12)]
    sizes = {c: int(rng.integers(1, 6)) for c in clusters}
    rows = [(i, c, rng.normal(0, 1, 4).tolist()) for c in clusters for i in range(sizes[c])]
    placed = [(p, c, "xyz"[int(rng.integers(0, 3))], int(rng.integers(0, 3))) for p in range(5) for c in clusters]
    want = {}
    for p in range(5):
        own = {c: (label, fold) for q, c, label, fold in placed if q == p}
        for fold in range(3):
            units = {}
            for label in sorted({label for label, f in own.values() if f != fold}):
                inside = [c for c in clusters if own[c][0] == label and own[c][1] != fold]
                mean = np.mean([np.mean([v for _, k, v in rows if k == c], axis=0) for c in inside], axis=0)
                units[label] = mean / np.linalg.norm(mean)
            for _, c, v in rows:
                if own[c][1] == fold and units:
                    key = (p, own[c][0], max(units, key=lambda u: np.dot(v, units[u])))
                    want[key] = want.get(key, 0) + 1
    vectors = spark.createDataFrame(rows, "row_id long, cluster_id string, vector array<double>")
    table = spark.createDataFrame(placed, "permutation int, cluster_id string, label string, fold int")
    for group in (32_000_000, 1):
        monkeypatch.setattr(md, "GROUP", group)
        got = md.permuted_centroid_confusion(vectors, table, 5, 3).collect()
        assert {(r["permutation"], r["true_label"], r["predicted_label"]): r["n"] for r in got} == want
