"""Language-model scores of whole texts: Katz backoff over word pairs, words and an unknown class.

Counts of pairs are discounted by Good-Turing up to ``TOP`` (an absolute discount where the counts of
counts don't allow it), those of words as well; what a word's seen followers leave is spread over all
others by the word probabilities, with a backoff weight that makes each word's followers (the unknown
class included) sum to one. Every context keeps one count in reserve, so that something is always left.

    p(w | v) = d(c(v, w)) c(v, w) / (c(v) + 1)   if the pair is known
             = alpha(v) p(w)                     else; alpha = 1 after an unknown word
    p(w)     = d(c(w)) c(w) / (N + 1)            if the word is known, else what those leave

Texts are cut into chunks of words held as 64-bit hashes. A chunk asks for each of its distinct pairs
and words once, with its own training counts: blobs of sorted arrays go to buckets (by the second word,
so that a bucket knows its word counts; pairs ending in a word of over ``1 / (8 buckets)`` of all tokens
go by both words, with that word's count broadcast: fewer than ``8 buckets`` of them). Buckets merge the
counts into partitioned tables and answer each chunk in the order it asked. What shuffles are the
distinct pairs of chunks, never one row for each token, and one very frequent word or pair is one entry
a chunk. The number of buckets follows the number of tokens.

Null and empty texts are the end token alone. Null ids and repeated rows are kept and scored. An
empty table gives no rows; if nothing is learned from, all words are unknown (score 0 a token).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import stage, text_slices

CHUNK_BYTES, SLICE_BYTES, BUCKET_TOKENS, TOP = 16_000_000, 1_000_000, 4_000_000, 5
START, END = np.uint64(1), np.uint64(2)
ASK = "bucket long, kind int, chunk long, data binary"
DOCS = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_ODD = 0x9E3779B97F4A7C15 | 1


# ------------------------------------------------------------------ arrays in bytes

def pack(*arrays: np.ndarray) -> bytes:
    """Integer or float arrays as one zstandard frame of byte planes."""
    import zstandard

    head, body = [len(arrays)], []
    for a in arrays:
        head += [len(a), "uifb".index(a.dtype.kind), a.dtype.itemsize]
        body.append(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, "<i8").tobytes() + b"".join(body))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    count = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 3 * count, 8).reshape(-1, 3).tolist()
    at, out = 8 + 24 * count, []
    for n, kind, size in head:
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<{'uifb'[kind]}{size}" if kind < 3 else bool))
        at += n * size
    return out


def small(a: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds it."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def steps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(mixed(first) + second * np.uint64(_ODD))


# ------------------------------------------------------------------ texts to chunks

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _ODD, np.uint64)]))
            down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, pow(_ODD, -1, 2**64), np.uint64)]))
        _POWERS[size] = up, down
    return _POWERS[size]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased texts, each text's words and then the end; tokens of each text.

    A word's hash is a polynomial over its bytes modulo 2^64, taken from running sums.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    up, down = powers(len(raw) + 1)
    word = ~_BLANK[raw]
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * up[: len(raw)], dtype=np.uint64)])
        hashes = mixed((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    upto = np.searchsorted(begins, starts[1:])
    return np.insert(hashes, upto, END), np.diff(upto, prepend=0) + 1


def chunks(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, held_out, text)`` as chunks: documents, their lengths, distinct words, word places."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list = []
        tokens: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        size = 0

        def emit() -> pa.RecordBatch:
            nonlocal ids, held, tokens, lengths, size, made
            flat, lens = np.concatenate(tokens), np.concatenate(lengths)
            words, at = np.unique(np.append(flat, START), return_inverse=True)
            learn = np.repeat(~np.array(held, bool), lens)
            counts = np.bincount(at[:-1][learn], minlength=len(words))
            counts[at[-1]] = len(held) - sum(held)
            row = [[(part << 32) + made], [ids], [pack(np.array(held, bool), small(lens))], [pack(steps(words), small(counts))], [pack(small(at[:-1]))], [len(flat)], [int(learn.sum())]]
            ids, held, tokens, lengths, size, made = [], [], [], [], 0, made + 1
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["chunk", "ids", "docs", "words", "places", "n", "learned"])

        for batch in text_slices(batches, SLICE_BYTES):
            texts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in batch.column(2).to_pylist()]
            found, lens = word_hashes(texts)
            ids += batch.column(0).to_pylist()
            held += batch.column(1).to_pylist()
            tokens.append(found)
            lengths.append(lens)
            size += sum(map(len, texts))
            if size >= CHUNK_BYTES:
                yield emit()
        if ids:
            yield emit()

    return docs.mapInArrow(cut, "chunk long, ids array<long>, docs binary, words binary, places binary, n long, learned long")


class Chunk:
    """One chunk with its distinct words and pairs, each in the order in which it asks for them."""

    def __init__(self, row: dict, buckets: int, often: np.ndarray | None):
        self.held, self.lengths = unpack(row["docs"])
        gaps, self.counts = unpack(row["words"])
        with np.errstate(over="ignore"):
            self.words = np.cumsum(gaps, dtype=np.uint64)
        self.word_bucket = (mixed(self.words) % np.uint64(buckets)).astype(np.int64)
        self.word_order = np.argsort(self.word_bucket, kind="stable")
        if often is None:
            return
        now = unpack(row["places"])[0].astype(np.int64)
        opens = np.cumsum(self.lengths.astype(np.int64)) - self.lengths
        before = np.roll(now, 1)
        before[opens] = np.searchsorted(self.words, START)
        self.now, self.before, self.opens = now, before, opens
        size = len(self.words)
        pairs, self.pair_of = np.unique(before * size + now, return_inverse=True)
        self.first, self.second = pairs // size, pairs % size
        learn = np.repeat(~self.held, self.lengths)
        self.pair_counts = np.bincount(self.pair_of[learn], minlength=len(pairs))
        ends = self.words[self.second]
        hot = np.isin(ends, often)
        self.pair_bucket = np.where(hot, pair_hash(self.words[self.first], ends) % np.uint64(buckets), mixed(ends) % np.uint64(buckets)).astype(np.int64)
        self.pair_order = np.argsort(self.pair_bucket, kind="stable")


def runs(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, start, end) of each run."""
    at = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, int)
    for start, end in zip(at.tolist(), [*at[1:].tolist(), len(sorted_keys)], strict=False):
        yield int(sorted_keys[start]), start, end


def asks(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int32(), pa.int64(), pa.binary()], strict=True)], names=["bucket", "kind", "chunk", "data"])


def each_chunk(table: DataFrame, make, out: str = ASK) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield make(batch.slice(k, 1).to_pylist()[0])

    return table.mapInArrow(go, out)


def ask_words(table: DataFrame, buckets: int) -> DataFrame:
    def make(row: dict) -> pa.RecordBatch:
        c = Chunk(row, buckets, None)
        order = c.word_order
        return asks([(b, 0, row["chunk"], pack(steps(c.words[order[s:e]]), c.counts[order[s:e]])) for b, s, e in runs(c.word_bucket[order])])

    return each_chunk(table.select("chunk", "docs", "words"), make)


def ask_pairs(table: DataFrame, buckets: int, often: np.ndarray) -> DataFrame:
    def make(row: dict) -> pa.RecordBatch:
        c = Chunk(row, buckets, often)
        out = []
        for b, s, e in runs(c.pair_bucket[c.pair_order]):
            at = c.pair_order[s:e]
            first, many = np.unique(c.first[at], return_counts=True)  # in order: pairs are sorted by their first word
            second, place = np.unique(c.second[at], return_inverse=True)
            out.append((b, 0, row["chunk"], pack(steps(c.words[first]), small(many), steps(c.words[second]), small(place), small(c.pair_counts[at]))))
        return asks(out)

    return each_chunk(table.select("chunk", "docs", "words", "places"), make)


def each_bucket(table: DataFrame, merge, key: str, out: str) -> DataFrame:
    """``merge(key, rows)`` for all rows of a key, one key after the other."""
    ordered = table.repartition(key).sortWithinPartitions(key, "kind", "chunk")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if now is not None and row[key] != now:
                    yield from merge(now, held)
                    held = []
                now = row[key]
                held.append(row)
        if held:
            yield from merge(now, held)

    return ordered.mapInArrow(go, out)


# ------------------------------------------------------------------ discounts

def discounts(counts: dict[int, int]) -> np.ndarray:
    """d(r) for r = 0..TOP from the counts of counts: Good-Turing, else an absolute discount."""
    n = [counts.get(r, 0) for r in range(TOP + 2)]
    flat = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    out = np.array([1.0] + [(r - flat) / r for r in range(1, TOP + 1)])
    if n[1] and (tail := (TOP + 1) * n[TOP + 1] / n[1]) < 1:
        for r in range(1, TOP + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] else 0.0
            if 0 < d < 1:
                out[r] = d
    return out


def discounted(counts: np.ndarray, rate: np.ndarray) -> np.ndarray:
    return counts * np.where(counts > TOP, 1.0, rate[np.minimum(counts, TOP).astype(np.int64)])


class WordModel:
    """Probabilities of words by their counts; a count of zero is the unknown class."""

    def __init__(self, total: int, kinds: int, counts: dict[int, int], seen_mass: float):
        self.total, self.kinds, self.rate = total, kinds, discounts(counts)
        # known words keep sum of d(r) r; the unknown class gets the rest
        self.unknown = 1.0 - (seen_mass - sum(counts.get(r, 0) * r * (1 - self.rate[r]) for r in range(1, TOP + 1))) / (total + 1)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.rate) / (self.total + 1), self.unknown)


# ------------------------------------------------------------------ buckets

def word_totals(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Distinct words of a bucket and their counts; place of each asked word; (chunk, how many it asked)."""
    asked = [unpack(r["data"]) for r in rows if r["kind"] == 0]
    with np.errstate(over="ignore"):
        words = [np.cumsum(a[0], dtype=np.uint64) for a in asked]
    names, place = np.unique(np.concatenate(words), return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate([a[1] for a in asked]).astype(np.float64), minlength=len(names)).astype(np.int64)
    return names, counts, place, [(r["chunk"], len(w)) for r, w in zip([r for r in rows if r["kind"] == 0], words, strict=True)]


def word_statistics(table: DataFrame, buckets: int, total: int) -> tuple[WordModel, np.ndarray, np.ndarray]:
    """The word model, and the words of over ``1 / (8 buckets)`` of all tokens with their counts."""
    floor = total / (8 * buckets)

    def merge(bucket: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        names, counts, _, _ = word_totals(rows)
        counts = np.where(names == START, 0, counts)
        low = np.bincount(np.minimum(counts, TOP + 2), minlength=TOP + 3)
        hot = counts > floor
        data = pack(low, np.array([(counts > 0).sum(), counts.sum()]), names[hot], counts[hot])
        yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([data], pa.binary())], names=["bucket", "data"])

    found = [unpack(r["data"]) for r in each_bucket(ask_words(table, buckets), merge, "bucket", "bucket long, data binary").collect()]  # one a bucket, a few numbers each
    low = sum((f[0] for f in found), np.zeros(TOP + 3, np.int64))
    kinds, mass = sum((f[1] for f in found), np.zeros(2, np.int64)).tolist()
    hot, many = np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])
    order = np.argsort(hot)
    return WordModel(total, kinds, {r: int(low[r]) for r in range(1, TOP + 2)}, mass), hot[order], many[order]


def merge_pairs(table: DataFrame, buckets: int, model: WordModel, hot: np.ndarray, hot_counts: np.ndarray) -> DataFrame:
    """Answers to chunks (kind 2: counts in the order asked), what contexts have (kind 1: to word buckets), counts of counts (kind 3)."""

    def merge(bucket: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        first, second, count, sizes = [], [], [], []
        for r in rows:
            a, many, b, place, c = unpack(r["data"])
            r["data"] = None
            with np.errstate(over="ignore"):
                first.append(np.repeat(np.cumsum(a, dtype=np.uint64), many))
                second.append(np.cumsum(b, dtype=np.uint64)[place])
            count.append(c.astype(np.uint32))
            sizes.append(len(c))
        first, second, count = np.concatenate(first), np.concatenate(second), np.concatenate(count)
        _, at, place = np.unique(pair_hash(first, second), return_index=True, return_inverse=True)
        total = np.bincount(place, weights=count, minlength=len(at)).astype(np.int64)
        answer, cut = total[place], np.cumsum([0, *sizes])
        del place, count
        yield asks([(bucket, 2, r["chunk"], pack(small(answer[s:e]))) for r, s, e in zip(rows, cut[:-1].tolist(), cut[1:].tolist(), strict=True)])
        del answer
        known = total > 0
        first, second, total = first[at][known], second[at][known], total[known]
        low = np.bincount(np.minimum(total, TOP + 2), minlength=TOP + 3)
        ends, place = np.unique(second, return_inverse=True)
        sums = np.bincount(place, weights=total, minlength=len(ends)).astype(np.int64)
        if len(hot):
            spot = np.minimum(np.searchsorted(hot, ends), len(hot) - 1)
            sums = np.where(hot[spot] == ends, hot_counts[spot], sums)
        chance = model(sums)[place]
        context, place = np.unique(first, return_inverse=True)
        kinds = [np.bincount(place[total == r], minlength=len(context)) for r in range(1, TOP + 1)]
        rest = np.bincount(place, weights=np.where(total > TOP, total, 0), minlength=len(context)).astype(np.int64)
        mass = np.bincount(place, weights=chance, minlength=len(context))
        to = (mixed(context) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        yield asks([(b, 1, bucket, pack(steps(context[order[s:e]]), *[small(k[order[s:e]]) for k in kinds], small(rest[order[s:e]]), mass[order[s:e]].astype(np.float32))) for b, s, e in runs(to[order])])
        yield asks([(bucket, 3, bucket, pack(low))])

    return each_bucket(ask_pairs(table, buckets, hot), merge, "bucket", ASK)


def merge_words(table: DataFrame, contexts: DataFrame, buckets: int, rate: np.ndarray) -> DataFrame:
    """Answers to chunks (kind 1): counts and log10 backoff weights of the words asked for."""

    def merge(bucket: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        names, counts, place, chunks_ = word_totals(rows)
        kept, left = np.zeros(len(names)), np.ones(len(names))
        for r in (r for r in rows if r["kind"] == 1):
            gaps, *kinds, rest, mass = unpack(r["data"])
            with np.errstate(over="ignore"):
                at = np.searchsorted(names, np.cumsum(gaps, dtype=np.uint64))
            kept[at] += rest + sum(k * rate[i + 1] * (i + 1) for i, k in enumerate(kinds))
            left[at] -= mass
        weight = np.log10(np.where(counts > 0, (1 - kept / (counts + 1)) / np.maximum(left, 1e-12), 1.0)).astype(np.float32)
        cut = np.cumsum([0] + [n for _, n in chunks_])
        answer, backoff = counts[place], weight[place]
        yield asks([(bucket, 1, c, pack(small(answer[s:e]), backoff[s:e])) for (c, _), s, e in zip(chunks_, cut[:-1].tolist(), cut[1:].tolist(), strict=True)])

    return each_bucket(ask_words(table, buckets).unionByName(contexts), merge, "bucket", ASK)


# ------------------------------------------------------------------ scores

def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows, learning from those for which ``held_out`` (a boolean column) is false."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    table = stage(chunks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))), "chunks")
    sizes = table.agg(F.sum("n").alias("n"), F.sum("learned").alias("learned")).first()
    if not sizes["n"]:
        return spark.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    total, buckets = sizes["learned"], max(8, -(-sizes["n"] // BUCKET_TOKENS))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # rows are blobs from here on
    model, hot, hot_counts = word_statistics(table, buckets, total)
    pairs = stage(merge_pairs(table, buckets, model, hot, hot_counts), "pairs")
    lows = sum((unpack(r["data"])[0] for r in pairs.filter("kind = 3").select("data").collect()), np.zeros(TOP + 3, np.int64))  # one a bucket
    rate = discounts({r: int(lows[r]) for r in range(1, TOP + 2)})
    words = stage(merge_words(table, pairs.filter("kind = 1"), buckets, rate), "words")
    rows = table.select(F.lit(-1).cast("long").alias("bucket"), F.lit(0).alias("kind"), "chunk", F.lit(None).cast("binary").alias("data"), "docs", "words", "places", "ids")
    none = [F.lit(None).cast("binary").alias(c) for c in ("docs", "words", "places")] + [F.lit(None).cast("array<long>").alias("ids")]
    answers = words.unionByName(pairs.filter("kind = 2")).select("bucket", "kind", "chunk", "data", *none)
    unit = np.log10(total + model.kinds + 1.0)

    def evaluate(chunk: int, parts: list[dict]) -> Iterator[pa.RecordBatch]:
        c = Chunk(parts[0], buckets, hot)
        told = [(p, unpack(p["data"])) for p in sorted(parts[1:], key=lambda p: (p["kind"], p["bucket"]))]
        counts, backoff, pair = np.zeros(len(c.words), np.int64), np.zeros(len(c.words)), np.zeros(len(c.first), np.int64)
        counts[c.word_order] = np.concatenate([a[0] for p, a in told if p["kind"] == 1])
        backoff[c.word_order] = np.concatenate([a[1] for p, a in told if p["kind"] == 1])
        pair[c.pair_order] = np.concatenate([a[0] for p, a in told if p["kind"] == 2])
        own = np.where(c.words == START, 0, counts)
        alone = np.log10(model(own))
        seen = np.log10(np.maximum(discounted(pair, rate), 1e-300)) - np.log10(counts[c.first] + 1.0)
        each = np.where(pair > 0, seen, backoff[c.first] + alone[c.second])[c.pair_of]
        base = (np.log10(own + 1.0) - unit)[c.now]
        sums = [np.add.reduceat(x, c.opens) for x in ((own > 0)[c.now].astype(np.int64), base, each)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(parts[0]["ids"], pa.int64()), pa.array(c.held), pa.array(c.lengths.astype(np.int64)), *[pa.array(s) for s in sums]],
            names=[x.split()[0] for x in DOCS.split(", ")])

    out = each_bucket(rows.unionByName(answers), evaluate, "chunk", DOCS)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
