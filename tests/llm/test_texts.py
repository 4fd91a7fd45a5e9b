"""Near copies, language, toxicity, language models and SentencePiece against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from kinfold.llm import fingerprints, katz, language, suffix_pieces, toxicity
from kinfold.llm.common import crc_fold
from kinfold.llm.components import components


def groups(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    random_ = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(random_.randint(2000, 2300), random_.randint(2000, 2300)) for _ in range(150)] + [(5, 5)]
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == groups(nodes, [p for p in pairs if p[0] != p[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [4096, 7])
def test_links_are_complete(spark, monkeypatch, block):
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    random_ = random.Random(block)
    prints = {random_.getrandbits(64) for _ in range(150)}
    for x in list(prints)[:60]:
        for _ in range(3):
            prints.add(x ^ sum(1 << b for b in random_.sample(range(64), random_.randint(1, 4))))
    prints |= {0, 2**64 - 1, 1, 3, 7, 15}
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    points = spark.createDataFrame([(x, x) for x in signed], "key long, f0 long")
    found = [(r.a, r.b) for r in fingerprints.links(points, 3).collect()]
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(bits(a, b) <= 3 for a, b in found)
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bits(a, b) <= 3]
    assert groups(signed, found) == groups(signed, pairs)


def plain_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(spark):
    random_ = random.Random(8)
    base = " ".join(random_.choice("abcdefghij") * random_.randint(1, 3) for _ in range(400))
    rows = [(9, base), (4, base.upper()), (7, base + " tail"), (3, None), (2, ""), (8, " \t\n"), (None, base), (11, "two words"), (12, "Two  WORDS"), (9, base), (20, "é È other text")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    out = fingerprints.near_duplicates(docs).collect()
    prints = {t: plain_fingerprint(t) for _, t in rows}
    assert Counter((r.doc_id, r.fingerprint) for r in out) == Counter((i, "%016x" % prints[t]) for i, t in rows)
    kinds = sorted(set(prints.values()))
    group = groups(kinds, [(a, b) for a in kinds for b in kinds if (a ^ b).bit_count() <= 3])
    least = defaultdict(list)
    for i, t in rows:
        least[group[prints[t]]] += [i] if i is not None else []
    by_print = {"%016x" % p: min(least[g]) for p, g in group.items()}
    assert all(r.component_id == by_print[r.fingerprint] for r in out)
    assert fingerprints.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one(spark):
    random_ = random.Random(5)
    words = ["".join(random_.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(3000)]
    rows, texts = [], []
    for k in range(12):
        base = random_.sample(words, 300)
        texts.append(base)
        for copy in range(8):
            near = list(base)
            for at in random_.sample(range(300), copy % 5):
                near[at] = random_.choice(words)
            rows.append((1000 * k + 100 - copy, " ".join(near)))
    rows += [(1, None), (2, ""), (None, rows[0][1]), rows[3], (90_000, " ".join(texts[0][:150] + texts[1][:150]))]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, first string, _row string").drop("_row")
    kept = sorted(r.doc_id for r in fingerprints.keep_one(docs).collect())
    assert kept == sorted([1000 * k + 93 for k in range(12)] + [1, 90_000])
    assert fingerprints.keep_one(docs).columns == docs.columns
    assert fingerprints.keep_one(docs.limit(0)).count() == 0


def test_keep_one_past_failed_links(spark):
    random_ = random.Random(11)
    words = ["".join(random_.choices("abcdefghijklmnop", k=7)) for _ in range(3000)]
    rows, want = [], []
    for k in range(6):  # 1 to 30: the same words in other orders; 31: a near copy of 1 alone
        base = random_.sample(words, 300)
        near = list(base)
        for at in random_.sample(range(300), 5):
            near[at] = random_.choice(words)
        rows += [(100 * k + 1, " ".join(base)), (100 * k + 31, " ".join(near))]
        for i in range(2, 31):
            parts = [base[i : i + 4] for i in range(0, 300, 4)]
            random_.shuffle(parts)
            rows.append((100 * k + i, " ".join(w for p in parts for w in p)))
        want += range(100 * k + 1, 100 * k + 31)
    assert sorted(r.doc_id for r in fingerprints.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


LANGS = {"en": "the quick brown fox jumps over lazy dogs while reading books about weather", "de": "der schnelle braune fuchs springt über den faulen hund während er bücher liest",
         "ru": "быстрая коричневая лиса прыгает через ленивую собаку и читает книги о погоде"}


def test_language(spark):
    random_ = random.Random(6)
    said = lambda lang, n: " ".join(random_.choices(LANGS[lang].split(), k=n))
    rows = [(i, said(lang, 40), lang) for i, lang in enumerate(sorted(LANGS) * 30)]
    model = language.fit(spark.createDataFrame([*rows, (900, None, "en"), (901, "text", None), (902, "", "xx")], "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en", "ru"]
    mixed = said("en", 30) + ". " + said("de", 20) + "! " + said("ru", 10)
    asked = [(0, said("de", 30)), (1, mixed), (2, None), (3, ""), (4, "12 34 !?"), (5, "собаку"), (None, said("en", 9)), (0, said("en", 9)), (6, "word" * 20_000)]
    got = language.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()
    label = {(r.doc_id, r.lang_pred) for r in got}
    assert {(0, "de"), (0, "en"), (1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "ru"), (None, "en")} <= label and len(got) == len(asked)
    spans = next(r.spans for r in got if r.doc_id == 1)
    assert [s.lang for s in spans] == ["en", "de", "ru"] and mixed[spans[1].start : spans[1].end] == mixed.split(". ")[1].split("!")[0]
    assert all(0 <= r.score <= 1 for r in got)
    none = language.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language.identify(spark.createDataFrame(asked, "doc_id long, text string"), none).collect()} == {"und"}


def test_keep_one_finds_all_pairs(spark):
    random_ = random.Random(12)
    words = ["".join(random_.choices("abcdefghijklmnop", k=7)) for _ in range(3000)]
    line = random_.choices(words, k=12)
    rows = []
    for k in range(40):  # copies with up to a fourth added or dropped at once; every text has one line in common
        base = random_.choices(words, k=random_.randint(12, 200)) + line
        part = max(1, int(len(base) * random_.uniform(0.1, 0.25)))
        rows += [base, random_.choices(words, k=part) + base, base + random_.choices(words, k=part), base[part:]]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    random_.shuffle(rows)
    sets = {i: set(fingerprints.shingles(fingerprints.words_of(t), 5)) for i, t in rows}
    pairs = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(pairs) > 60
    kept = fingerprints.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(groups(sets, pairs).values()))


def test_best_path_is_viterbi():
    random_ = np.random.default_rng(2)
    for _ in range(40):
        scores = random_.normal(size=(6, 3)) * 3
        paths = [[a, b, c, d, e, f] for a in range(3) for b in range(3) for c in range(3) for d in range(3) for e in range(3) for f in range(3)]
        worth = lambda p: sum(scores[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        assert math.isclose(worth(language.best_path(scores, 2.0).tolist()), max(map(worth, paths)))


def test_best_path_without_the_best_language():
    scores = np.array([[0.0, 15.0, -20.0], [0.0, -20.0, 15.0]])
    assert language.best_path(scores, 16.0).tolist() == [1, 2]
    random_ = np.random.default_rng(3)
    for _ in range(200):
        scores = random_.normal(size=(4, 3)) * 3
        scores[:, 0] += 1.0
        paths = [[a, b, c, d] for a in range(3) for b in range(3) for c in range(3) for d in range(3)]
        worth = lambda p: sum(scores[i, k] for i, k in enumerate(p)) - 4.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        assert math.isclose(worth(language.best_path(scores, 4.0).tolist()), max(map(worth, paths)))


def test_toxicity(spark):
    random_ = random.Random(7)
    words = ["".join(random_.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = random_.choices(words, k=60)
        if toxic:
            for _ in range(3):
                text.insert(random_.randint(0, 59), random_.choice(["you zqidiot!", "Zqscum", "zqloserhaft", "zqloserling"]))
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None, "x"), (1001, "", "x"), (None, "zqscum zqscum zqidiot", "x"), (1002, "zqscum word " * 20_000, "x")], "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (5, None), (None, 1), (8, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks.filter(F.coalesce(crc_fold("doc_id", 3) != 1, F.lit(False))))
    got = toxicity.score(docs, model, keep=("doc_id",)).collect()
    right = [r.predicted == dict(labels)[r.doc_id] for r in got if r.doc_id in dict(labels)]
    assert sum(right) >= 0.95 * len(right) and len(got) == docs.count()
    by_id = {r.doc_id: r.predicted for r in got}
    assert by_id[1000] == by_id[1001] == 0 and by_id[1002] == by_id[None] == 1
    assert all(0 <= r.score <= 1 for r in got)
    for some, want in ((marks.filter("toxic = 1"), 1.0), (marks.limit(0), 0.0)):
        assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, some), keep=("doc_id",)).collect()} == {want}


@pytest.mark.parametrize("tokens", [4_000_000, 300])
def test_katz(spark, monkeypatch, tokens):
    monkeypatch.setattr(katz, "BUCKET_TOKENS", tokens)
    monkeypatch.setattr(katz, "CHUNK_BYTES", 2000)
    random_ = random.Random(9)
    words = [f"w{int(random_.paretovariate(0.7)) % 300}" for _ in range(4000)] + ["The", "THE", "é"]
    rows = [(i, " ".join(random_.choices(words, k=random_.randint(0, 60)))) for i in range(120)] + [(500, None), (501, ""), (502, " \n"), (None, "the é unknownword"), (0, "w1 w1 w1"), (700, "w1 w2 " * 3000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int").repartition(3)
    held = lambda i: i is not None and __import__("zlib").crc32(str(i).encode()) % 7 == 2
    got = katz.score(docs, crc_fold("doc_id", 7) == 2).collect()
    said = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    one, two, follow = Counter(), Counter(), defaultdict(dict)
    starts = 0
    for i, w in said:
        if not held(i):
            one.update(w)
            two.update(zip(["^", *w[:-1]], w, strict=True))
            starts += 1
    for (a, b), c in two.items():
        follow[a][b] = c
    total, kinds = sum(one.values()), len(one)
    rate1, rate2 = katz.discounts(Counter(one.values())), katz.discounts(Counter(two.values()))
    cut = lambda c, rate: c * (rate[c] if c <= katz.TOP else 1.0)
    known = {w: cut(c, rate1) / (total + 1) for w, c in one.items()}
    unknown = 1 - sum(known.values())
    context = lambda v: starts if v == "^" else one.get(v, 0)

    def weight(v):
        n = context(v)
        return (1 - sum(cut(c, rate2) for c in follow[v].values()) / (n + 1)) / (1 - sum(known[w] for w in follow[v])) if n else 1.0

    for v in ["^", *list(one)[:30]]:  # each word's followers sum to one
        seen = sum(cut(c, rate2) / (context(v) + 1) for c in follow[v].values())
        left = sum(p for w, p in known.items() if w not in follow[v]) + unknown
        assert v is None or math.isclose(seen + weight(v) * left, 1, rel_tol=1e-9)
    want = []
    for i, w in said:
        base = sum(math.log10((one.get(x, 0) + 1) / (total + kinds + 1)) for x in w)
        pairs = zip(["^", *w[:-1]], w, strict=True)
        full = sum(math.log10(cut(c, rate2) / (context(a) + 1)) if (c := two.get((a, b), 0)) else math.log10(weight(a) * known.get(b, unknown)) for a, b in pairs)
        want.append((i if i is not None else -1, held(i), len(w), sum(x in one for x in w), base, full))
    have = [(r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in got]
    assert {r.train_tokens for r in got} == {total}
    for a, b in zip(sorted(want), sorted(have), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-6)
    assert katz.score(docs.limit(0), crc_fold("doc_id", 7) == 2).count() == 0


def test_suffix_pieces(spark):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    random_ = random.Random(1)
    signs = "abcdefghijklmnopqrstuvwxyz   \n.,éü日本語🙂①<>_=()0123456789▁AB\u0000x\t"
    texts = ["".join(random_.choice(signs) for _ in range(random_.randint(0, 60))) for _ in range(1500)]
    texts += [" " * random_.randint(0, 30) + "x" + " " * random_.randint(0, 30) for _ in range(50)] + ["the" * 3000, "a" * 900, "日" * 5000, ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (0, texts[0]), (9000, None)]
    out = suffix_pieces.decode(suffix_pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), path, ("doc_id", "text")), path).collect()
    assert len(out) == len(rows)
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(r.text or "")
        assert r.decoded == (r.text or "").replace("▁", " ")
    assert suffix_pieces.encode(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
