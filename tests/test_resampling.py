"""Draws by block against plain Python."""

import hashlib

import numpy as np
import pytest

from kinfold.operators import bootstrap as bs


def test_block_draws_make_one_resample():
    n, made = 40_000, []
    for b in range(200):
        blocks = [bs.block_draws(b"6|%d" % b, n, k) for k in range(3)]
        assert sum(map(len, blocks)) == n and all((x < min(bs.BLOCK, n - k * bs.BLOCK)).all() for k, x in enumerate(blocks))
        made.append(np.bincount(np.concatenate([x.astype(np.int64) + k * bs.BLOCK for k, x in enumerate(blocks)]), minlength=n))
    counts = np.stack(made)
    assert np.array_equal(bs.block_draws(b"6|7", n, 1), bs.block_draws(b"6|7", n, 1)) and not np.array_equal(counts[0], counts[1])
    # counts of a unit are binomial with mean and variance one, those of two units all but independent
    assert abs(counts.var() - 1) < 0.01 and abs(counts[:, : bs.BLOCK].mean() - 1) < 0.005 and abs(counts[:, -100:].mean() - 1) < 0.03
    sides = counts[:, : bs.BLOCK].sum(1)
    assert abs(sides.var() / (n * bs.BLOCK / n * (1 - bs.BLOCK / n)) - 1) < 0.35


@pytest.mark.parametrize("overall", [False, True])
def test_hierarchical_by_block_equals_plain_python(spark, monkeypatch, overall):
    monkeypatch.setattr(bs, "BLOCK", 4)
    sizes, by_hash = {"A": 11, "B": 3, "C": 1}, lambda values: sorted(values, key=lambda v: (hashlib.sha256(v.encode()).hexdigest(), v))
    values = {(l, f"{l}{c}", s): ((c * 7 + s * 3) % 5 / 4, None if l == "B" and c == 1 else c / 10) for l, n in sizes.items() for c in range(n) for s in (1, 2) if not (l == "A" and c == 5 and s == 2)}
    df = spark.createDataFrame([(*k, 0, *v) for k, v in values.items()], "label string, cluster_id string, seed int, fold int, v double, u double")
    names, clusters = by_hash(list(sizes)), {l: by_hash([f"{l}{c}" for c in range(n)]) for l, n in sizes.items()}
    got = {r["replicate"]: (r["v"], r["u"]) for r in bs.hierarchical(df, ["v", "u"], 8, 3, overall=overall, by_block=True).collect()}
    mean = lambda x: np.mean(x) if len(x) else None
    for b in range(8):
        picks = []
        for occ in range(3):
            label = names[int(hashlib.sha256(b"3|%d|%d" % (b, occ)).hexdigest()[:8], 16) % 3]
            n = sizes[label]
            drawn = [4 * k + int(i) for k in range(-(-n // 4)) for i in bs.block_draws(b"3|%d|%d" % (b, occ), n, k, 4)]
            assert len(drawn) == n
            picks.append([(label, clusters[label][i]) for i in drawn])
        for at in (0, 1):
            per = []
            for s in (1, 2):
                groups = [[values[*c, s][at] for c in g if (*c, s) in values and values[*c, s][at] is not None] for g in picks]
                per.append(mean([x for g in groups for x in g]) if overall else mean([np.mean(g) for g in groups if g]))
            want = mean([x for x in per if x is not None])
            assert got[b][at] == (None if want is None else pytest.approx(want))
