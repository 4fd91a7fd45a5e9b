"""Merkle manifest, importance resampling and HyperMinHash groups against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import components, exact, hyperminhash, merkle, resampling
from kinfold.llm.ordering import ranked

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, key string, _row int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(n):
    """Null and empty fields, a hot source, repeated rows, clashing extra columns."""
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        source = rnd.choice(["hot"] * 6 + ["a", "b", "ä", "", None])
        text = rnd.choice([None, "", "x\ny" * rnd.randint(1, 4), f"text {i}\n", "é" * 3])
        rows.append((i, text, rnd.choice(["en", None]), source, rnd.choice([i, None]), "clash", "clash", 7))
    rows += [rows[3], rows[3], (None, "no id", "en", "hot", 1, None, None, None), (None, "no id\n", None, "single", 1, None, None, None)]
    return rows


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    path = []
    for level in tree[:-1]:
        a = i // 3 * 3
        path.append((level[a:i], level[i + 1 : a + 3]))
        i //= 3
    return path


@pytest.mark.parametrize("n", [1, 3, 500])
def test_manifest_equals_plain_trees(spark, n):
    rows = documents(n) if n == 500 else [(i, f"t{i}\n", "en", "s", i, "", "", 0) for i in range(n)]

    def leaf(r, text):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[4], text)))

    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {s: levels([leaf(r, r[1]) for r in by[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    want = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path = siblings(trees[s], i) + siblings(top, k)
            text = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            fold = leaf(r, text)
            for left, right in path:
                fold = sha("".join(left) + fold + "".join(right))
            proof = sha("".join("".join(a) + "".join(b) for a, b in path))
            want.append((r[0], s, leaf(r, r[1]), trees[s][-1][0], top[-1][0], proof, fold, fold == top[-1][0]))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = [tuple(r) for r in merkle.manifest(docs, tampered).drop("path").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(r["verified"] for r in merkle.manifest(docs).collect())


def test_manifest_of_an_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_ranks_across_ranges(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 5 + ["b", "c", None]), rnd.randint(0, 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, v int, id int").repartition(5)
    for key in ("key", None):
        groups = defaultdict(list)
        for r in rows:
            groups[r[0] if key else 0].append(r)
        want = {}
        for group in groups.values():
            for i, r in enumerate(sorted(group, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))):
                want[r[2]] = i
        got = ranked(df, [F.asc_nulls_first("key"), F.asc("v"), F.asc("id")], key)
        assert {r["id"]: r["rank"] for r in got.collect()} == want


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("piece", [resampling.PIECE, 40])
def test_feature_hashes_equal_plain_ones(piece, monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", piece)
    for text in (None, "", " ", "One", "one-TWO_3", "ÀB c\x00d É" * 9, "w" * 200 + " a b", "x1 " * 100, "a b c d e f g h i j k l m n o p q r s t u v"):
        words, found = features(text)
        hashes, n = resampling.feature_hashes(text)
        assert n == len(words)
        assert sorted(hashes.tolist()) == sorted(zlib.crc32(x.encode()) for x in found)


def plain_draw(rows, target, percent):
    s, t = np.zeros(10_000), np.zeros(10_000)
    for text in target:
        for x in features(text)[1]:
            t[zlib.crc32(x.encode()) % 10_000] += 1
    for _, text in rows:
        for x in features(text)[1]:
            s[zlib.crc32(x.encode()) % 10_000] += 1
    gain = [math.floor(1000 * math.log((t[i] + 1) * (s.sum() + 10_000) / ((s[i] + 1) * (t.sum() + 10_000)))) for i in range(10_000)]
    out = []
    for doc, text in rows:
        words, found = features(text)
        h = int(sha(f"42:{'' if doc is None else doc}")[:8], 16)
        weight = sum(gain[zlib.crc32(x.encode()) % 10_000] for x in found)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


def test_draw_equals_plain_one(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünder", "X9"]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([3, 19, 20, 40])))) for i in range(400)]
    rows += [rows[1]] * 30 + [(None, rows[2][1]), (400, None), (401, ""), (402, "  ")]
    target = ["w1 w2 w3 ünder x9"] * 5 + [None]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, score string, weight int").repartition(4)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (0, 5, 60, 100):
        got = [tuple(r) for r in resampling.draw(docs, aims, percent).collect()]
        assert sorted(got, key=repr) == sorted(plain_draw(rows, target, percent), key=repr)
    assert resampling.draw(docs.limit(0), aims).collect() == []
    assert len(resampling.draw(docs, aims.limit(0)).collect()) == len(rows)


@pytest.mark.parametrize("pivots", [1, 32])
def test_quickselect_finds_every_place(spark, pivots, monkeypatch):
    monkeypatch.setattr(resampling, "PIVOTS", pivots)
    rnd = random.Random(2)
    keys = [(rnd.randint(0, 3), 0, rnd.randint(0, 5), i) for i in range(60)]
    df = spark.createDataFrame(keys, "k1 long, k2 long, k3 long, k4 long").coalesce(1).cache()
    for place in (1, 17, 60):
        assert resampling.kth_key(df, place) == sorted(keys)[place - 1]


def plain_groups(rows, size, similarity=0.8):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {b" ".join(words)} if words else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for k in range(i):
            both = len(sets[i] & sets[k])
            if both and 100 * both >= round(100 * similarity) * (len(sets[i]) + len(sets[k]) - both):
                up[top(i)] = top(k)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)].append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        component = (min(least[top(i)]) if least[top(i)] else None) if sets[i] else doc
        out.append((doc, len(sets[i]), component, doc is not None and doc == component))
    return out


def test_groups_equal_all_pairs(spark):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for length in (4, 5, 6, 12, 40, 150, 600):
        for _ in range(4):
            base = [rnd.choice(vocabulary) for _ in range(length)]
            rows.append(" ".join(base))
            for share in (0.0, 0.01, 0.03, 0.05, 0.06, 0.08, 0.2):
                rows.append(" ".join(w if rnd.random() >= share else rnd.choice(vocabulary) for w in base).upper())
            rows += [" ".join(base[: int(length * 0.8)]), " ".join(base[int(length * 0.15) :]), " \n".join(base)]
    rows += [None, "", "  ", "One", "one", "two three", "TWO  three"]
    rows = list(enumerate(rows)) + [(None, rows[0]), (None, "alone in this"), (2, rows[2])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key int, n int").repartition(4)
    for size in (2, 5):
        got = [tuple(r) for r in hyperminhash.near_duplicates(docs, size).collect()]
        assert sorted(got, key=repr) == sorted(plain_groups(rows, size), key=repr)
    assert hyperminhash.near_duplicates(docs.limit(0)).collect() == []


def test_crowded_cells_and_hubs_are_cut(spark, monkeypatch):
    monkeypatch.setattr(hyperminhash, "BLOCK", 16)
    monkeypatch.setattr(exact, "PART", 8)
    rnd = random.Random(4)
    base = [f"w{rnd.randint(0, 300)}" for _ in range(120)]
    rows = [(i, " ".join(w if rnd.random() >= 0.04 else f"v{rnd.randint(0, 99)}" for w in base)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in hyperminhash.near_duplicates(docs, 2).collect()]
    assert sorted(got) == sorted(plain_groups(rows, 2))


@pytest.mark.parametrize("block", [1024, 32])
def test_points_that_share_many_cells_meet_as_a_crowd(spark, block):
    rnd = random.Random(6)
    cells = {c: rnd.sample(range(60), 50) for c in range(40)} | {50: [0, 100], 51: [100, 101, 102], 52: list(range(40))}
    cells |= {60 + i: [*range(1000 + 10 * i, 1020 + 10 * i)] for i in range(30)}  # a chain, less work cell by cell
    root = {k: 0 if k < 40 else k for c in cells.values() for k in c}
    shared = spark.createDataFrame([(c, k) for c, keys in cells.items() for k in keys], "cell long, key long")
    groups = spark.createDataFrame([(k, 0) for k in range(40)], "key long, root long")
    points = spark.createDataFrame([(k, 1) for k in root], "key long, n long")
    spots = defaultdict(set)
    for r in exact.mixed_spots(shared, groups, points, block).collect():
        assert r["root"] == root[r["key"]] and r["key"] not in spots[r["spot"]]
        spots[r["spot"]].add(r["key"])
    met = {(a, b) for keys in spots.values() for a in keys for b in keys}
    assert all((a, b) in met for keys in cells.values() for a in keys for b in keys if root[a] != root[b])
    assert sum(map(len, spots.values())) <= 60 * max(1, -(-60 // (block // 2)) - 1) + 5 + 30 * 20  # 2,605 rows cell by cell
    assert not any(0 <= a < 60 and b >= 1000 for a, b in met)


def test_single_shared_cells_tie_no_crowd(spark, monkeypatch):
    seen = []

    def counted(edges):
        seen.append(edges.count())
        return components.components(edges)

    monkeypatch.setattr(exact, "components", counted)
    chain = [(c, 19 * c + i) for c in range(100) for i in range(20)]  # each cell shares one point with the next
    crowd = [(1000 + c, 5000 + i) for c in range(6) for i in range(30) if i % 7 != c]  # large cells shared again and again
    rows = exact.mixed_rows(spark.createDataFrame(chain + crowd, "cell long, key long"), spark.createDataFrame([], "key long, root long"))
    found = {r["key"]: r["crowd"] for r in exact.tied(rows).collect()}
    assert set(found) == set(range(5000, 5030)) and set(found.values()) == {5000}
    assert seen[0] <= 60  # some 1,900 more if every shared cell were a tie
    few = spark.createDataFrame([(1, 2), (1, 3)], "cell long, key long")
    assert exact.tied(exact.mixed_rows(few, spark.createDataFrame([], "key long, root long"))) is None


def test_extended_groups(spark, monkeypatch):
    rnd = random.Random(12)
    first = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(150)]
    more = [(rnd.randint(0, 500), rnd.randint(0, 500)) for _ in range(60)] + [(7, 7), first[0]]
    table = lambda edges: spark.createDataFrame(edges, "a long, b long")
    groups = components.components(table(first))
    want = {tuple(r) for r in components.components(table(first + more)).collect()}
    seen = []
    whole = components.components
    monkeypatch.setattr(components, "components", lambda edges: seen.append(edges.filter("a != b").count()) or whole(edges))
    got = [tuple(r) for r in components.extended(groups, table(more)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert seen[0] <= 60  # only the new links, between groups
    assert {tuple(r) for r in components.extended(groups, table([])).collect()} == {tuple(r) for r in groups.collect()}


def test_pairs_just_too_far_apart_are_not_checked(spark, monkeypatch):
    rnd = random.Random(8)
    rows = []
    for i in range(60):
        words = [f"w{j}" for j in range(150)]
        for j in rnd.sample(range(1, 149), 6):
            words[j] = f"v{i} {j}"
        rows.append((i, " ".join(words)))
    checked = []

    def counted(pairs, *more):
        checked.append(pairs.count())
        return exact.verified(pairs, *more)

    monkeypatch.setattr(hyperminhash, "verified", counted)
    got = [tuple(r) for r in hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()]
    assert sorted(got) == sorted(plain_groups(rows, 2))
    assert sum(checked) <= 60  # of 1,770 pairs, 0.7 alike


def test_parities_lose_no_pair():
    rng = np.random.default_rng(5)
    for n in (1, 5, 9, 45, 180, 900, 9_000):
        for _ in range(20):
            whole = np.unique(rng.integers(0, 2**64, 2 * n, np.uint64))[:n]
            rng.shuffle(whole)
            both = -(-4 * n // 5)  # the union has n members: just 0.8
            cut = rng.integers(both, n + 1)
            sets = whole[:cut], np.r_[whole[:both], whole[cut:]]
            x, y = (hyperminhash.bits_of([hyperminhash.parities(s)]) for s in sets)
            assert hyperminhash.within(x, y, *(np.array([len(s)]) for s in sets), 0.8)[0]


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(1)
    for n, m in ((30, 30), (400, 320), (20_000, 18_000), (3_000, 3_000)):
        whole = rng.integers(0, 2**64, n + m, np.uint64)
        for both in (0, m // 2, m):
            a, b = whole[:n], whole[n - both : n - both + m]
            x, y = (hyperminhash.registers(np.unique(s))[None] for s in (a, b))
            _, estimate = hyperminhash.may_be_similar(x, y, np.array([n]), np.array([m]), 0.0)
            assert abs(estimate[0] - both / (n + m - both)) < 0.13


def test_chance_of_agreement_is_what_unlike_sets_show():
    rng = np.random.default_rng(2)
    agree = shared = 0
    for _ in range(400):
        x, y = (hyperminhash.registers(rng.integers(0, 2**64, 5000, np.uint64)) for _ in range(2))
        agree, shared = agree + int(((x == y) & (x != hyperminhash.EMPTY)).sum()), shared + hyperminhash.REGISTERS
    want = hyperminhash.chance(np.array([5000.0]), np.array([5000.0]))[0]
    assert abs(agree / shared - want) < 0.5 * want + 3 * math.sqrt(want / shared)


def test_registers_pack_and_bands_of_few_members_are_filled():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 300, 5000):
        own = hyperminhash.registers(rng.integers(0, 2**64, n, np.uint64))
        assert (hyperminhash.unpacked([hyperminhash.packed(own)])[0] == own).all()
        if n:
            assert len(np.unique(hyperminhash.cells_of(own))) == hyperminhash.BANDS
