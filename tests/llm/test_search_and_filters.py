"""URL rules, vector searches, packing and id files against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kinfold.llm import bitplanes, norm_buckets, packing, posting_lists, url_cascade
from kinfold.llm.bpe_units import encoder
from kinfold.llm.common import new_path
from kinfold.llm.queries import RULES, every_fiftieth

BPE = public_tokenizers.path("byte_bpe_50k.json")


def verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Example.ORG/es/x", "http://a.b.example.org/en/1?q=/es/", "x://org", "x://org/", "x://notorg/", "x://a.com/de/#f",
            "http://COM/fr/", "http://a..com/fr/é", "a://b://c.org/", "http://org.evil.net/", "http://org?x", "http://" + "s." * 300 + "org/" + "p" * 5000] * 2
    rows = [(i, u, "clash", "clash") for i, u in enumerate(urls)]
    table = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_cascade.judge(table, RULES).collect()}
    assert got == {i: verdict(u, RULES) for i, u, *_ in rows}
    assert url_cascade.judge(table.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_cascade.judge(table, []).collect()} == {"allow"}


def test_cascade_is_exact_and_has_levels(spark, monkeypatch):
    monkeypatch.setattr(url_cascade, "BITS", 2)
    listed = spark.range(300).select(F.concat(F.lit("k"), "id").alias("key"))
    universe = spark.range(5000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    levels = url_cascade.fit_cascade(listed, universe)
    assert len(levels) > 2
    found = universe.filter(url_cascade.listed(levels, F.col("key"))).collect()
    assert {r.key for r in found} == {f"k{i}" for i in range(300)}


def vector_rows(n=400):
    random_ = np.random.default_rng(1)
    points = random_.normal(size=(n, 8)).astype(np.float32)
    points[100:220] = points[100] + random_.normal(scale=0.01, size=(120, 8))  # a crowded place
    points[220:240] = points[220]  # ties
    rows = [(i, p.tolist(), "x") for i, p in enumerate(points)]
    rows += [(n, None, "x"), (n + 1, [0.0] * 8, "x"), (n + 2, [None] + [1.0] * 7, "x"), (n + 3, [float("nan")] * 8, "x"), (n + 4, [float("inf")] * 8, "x"), (n + 5, [1.0], "x"), (None, [1.0] * 8, "x"), (n + 6, [], "x")]
    return rows + [rows[0]]


def brute(points, top, score):
    """(query id, its finds) of every query row; rows that share an id are rows of their own."""
    out = []
    for at, (q, point) in enumerate(points):
        if q % 50 == 0:
            out.append((q, sorted((-score(point, other), v) for k, (v, other) in enumerate(points) if k != at)[:top]))
    return sorted(out)


def cosine(a, b):
    return float(a @ b / math.sqrt((a @ a) * (b @ b)))


def test_vector_searches(spark, monkeypatch):
    for module in (posting_lists, norm_buckets):
        monkeypatch.setattr(module, "BLOCK", 64)
        monkeypatch.setattr(module, "QUERIES", 3)
    rows = vector_rows()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    points = [(i, np.array(v, float)) for i, v, _ in [*rows[:400], rows[-1]]]
    near = defaultdict(list)
    for r in posting_lists.search(table, every_fiftieth).collect():
        near[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = defaultdict(list)
    for q, finds in brute(points, 5, cosine):
        want[q] += [v for _, v in finds]
    assert set(near) == set(want) and all(sorted(k for k, *_ in near[q]) == sorted([1, 2, 3, 4, 5] * (len(want[q]) // 5)) for q in want)
    hits = sum((Counter(v for _, v, _ in near[q]) & Counter(want[q])).total() for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    own = dict(points)
    assert all(abs(s - cosine(own[q], own[v])) < 1e-12 for q in near for _, v, s in near[q])
    whole = [(i, np.floor(256 * p)) for i, p in points] + [(401, np.zeros(8))]
    exact = [(r.query_id, r["rank"], r.vec_id, r.score) for r in norm_buckets.search(table, every_fiftieth).collect()]
    assert sorted(exact) == sorted((q, k, v, -s) for q, finds in brute(whole, 5, lambda a, b: int(a @ b)) for k, (s, v) in enumerate(finds, 1))


def test_rows_that_share_an_id(spark):
    """A third of all rows and two queries with one id: each row is a candidate, also of its namesake."""
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [1.0, 3.0]), (2, [2.0, 2.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0])] + [(7, [1.0, 0.01 * k]) for k in range(3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    points = [(i, np.array(v)) for i, v in rows]
    near = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in posting_lists.search(table, every_fiftieth, 9).collect()]
    assert sorted(near) == sorted((q, k, v, round(-s, 9)) for q, finds in brute(points, 9, cosine) for k, (s, v) in enumerate(finds, 1))
    whole = [(i, np.floor(256 * p)) for i, p in points]
    exact = [(r.query_id, r["rank"], r.vec_id, r.score) for r in norm_buckets.search(table, every_fiftieth, 9).collect()]
    assert sorted(exact) == sorted((q, k, v, -s) for q, finds in brute(whole, 9, lambda a, b: int(a @ b)) for k, (s, v) in enumerate(finds, 1))


def test_vector_searches_on_few_rows(spark):
    for search in (posting_lists.search, norm_buckets.search):
        none = spark.createDataFrame([], "vec_id long, embedding array<float>")
        assert search(none, every_fiftieth).count() == 0
        few = spark.createDataFrame([(0, [1.0, 2.0]), (50, [2.0, 1.0]), (7, [3.0, 3.0])], "vec_id long, embedding array<float>")
        assert {(r.query_id, r.vec_id) for r in search(few, every_fiftieth).collect()} == {(0, 50), (0, 7), (50, 0), (50, 7)}


def test_large_products_stay_exact():
    big = np.array([[2.0**60, 3.0], [2.0**60, 4.0]])
    assert norm_buckets.products(big, np.array([8.0, 1.0])).tolist() == [2**63 + 3, 2**63 + 4]
    assert norm_buckets.clipped(np.array([2**63 + 3, -(2**70)], object)).tolist() == [2**63 - 1, -(2**63)]


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_best_fit(seed):
    random_ = random.Random(seed)
    lengths = [random_.choice([1, 2, 3, 5, 7, 8, 11, 13, 20]) for _ in range(300)] + [20] * random_.randint(0, 30)
    room, placed = [], Counter()
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(20 - n)
    used = defaultdict(list)
    for length, first, end, sequence, pieces, at in packing.plan_sequences(dict(Counter(lengths)), 20):
        for k in range(first, end):
            placed[length] += 1
            used[sequence + (k - first) // pieces].append((at + (k - first) % pieces * length, length))
    assert placed == Counter(lengths) and len(used) == len(room)
    for spots in used.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 20


def odd_docs(spark):
    rows = [(1, "one two"), (2, None), (3, ""), (4, "word " * 7000), (None, "no id"), (5, "one two"), (5, "one two"), (6, "  spaced   out \n\n lines ")]
    rows += [(100 + i, "same length") for i in range(60)]
    return spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, offset int, part int"), rows


def test_packing(spark):
    docs, rows = odd_docs(spark)
    encode = encoder(BPE)
    out = packing.pack_documents(docs, BPE).collect()
    ids = Counter((i, zlib.crc32(encode(t) + bytes(4))) for i, t in rows if i != 4)
    assert Counter((r.doc_id, r.ids_crc32) for r in out if r.doc_id != 4) == ids
    long_ = encode(rows[3][1]) + bytes(4)
    parts = sorted((r.piece, r.start, r.length) for r in out if r.doc_id == 4)
    size = len(long_) // 4
    assert parts[0][2] == (size - 1) % 2048 + 1 and all(p[2] == 2048 for p in parts[1:]) and sum(p[2] for p in parts) == size
    spots = defaultdict(list)
    for r in out:
        spots[r.sequence_id].append((r.offset, r.length))
    for own in spots.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(docs.limit(0), BPE).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("count", [1, 7, 8, 1000])
def test_planes(kind, count):
    ids = np.random.default_rng(count).integers(0, 2**32, count, dtype=np.uint32)
    assert bitplanes.from_planes(bitplanes.to_planes(ids, kind), count).tolist() == ids.tolist()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_id_files(spark, kind):
    docs, rows = odd_docs(spark)
    path = new_path(spark, "test-ids")
    bitplanes.write_ids(docs, path, BPE, block=50, kind=kind)
    out = bitplanes.read_documents(spark, path, with_ids=True).orderBy("start").collect()
    encode = encoder(BPE)
    assert Counter((r.doc_id, r.ids_crc32) for r in out) == Counter((i, zlib.crc32(encode(t) + b"\2\0\0\0")) for i, t in rows)
    assert [r.doc_id for r in out] == sorted([i for i, _ in rows], key=lambda i: -1 if i is None else i)
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens
    empty = new_path(spark, "test-ids")
    bitplanes.write_ids(docs.limit(0), empty, BPE)
    assert bitplanes.read_documents(spark, empty).count() == 0


def test_units_equal_the_library():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BPE)
    random_, encode = random.Random(3), encoder(BPE)
    signs = "abcdeABt's'll're   \n\t.,!%$é日🙂<>|_=019  \u0000\x1c²ⅷ्"
    signs = [*signs, "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(random_.choice(signs) for _ in range(random_.randint(0, 40)))
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
