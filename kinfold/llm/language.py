"""Language of whole texts: letter-trigram scores a word, script ranges, Viterbi spans.

A word (a run of letters) has a score for each learned language: the sum over its letters of the
log probability of the letter with its two neighbours. The script of its first letter leaves only
languages whose training texts use that script; if none does, all stay. Viterbi over the words with
a penalty for each switch labels spans; a text whose single best language can't be beaten on any
stretch by more than half the penalty is one span, which needs no search. The label of a text is the
language with most letters, ties to the smaller name; its score is that language's share of letters.

Null and empty texts and texts without letters: ``und``, score 0, no spans. With nothing to learn
from, every text is ``und``. Null ids and repeated rows are kept. Columns are chosen by name, others
are ignored.

Fitting counts at most ``FIT_ROWS`` texts of each language, chosen by a hash of text and id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import small_batches, text_slices

FIT_ROWS, BUCKETS, SWITCH, OUTSIDE = 5_000, 1 << 16, 16.0, 60.0
PARTS = 16
#: First code points of script ranges, by the Unicode blocks.
SCRIPTS = {
    0x0041: "latin", 0x0370: "greek", 0x0400: "cyrillic", 0x0530: "armenian", 0x0590: "hebrew", 0x0600: "arabic", 0x0900: "devanagari",
    0x0980: "bengali", 0x0A00: "gurmukhi", 0x0A80: "gujarati", 0x0B80: "tamil", 0x0C00: "telugu", 0x0C80: "kannada", 0x0D00: "malayalam",
    0x0E00: "thai", 0x10A0: "georgian", 0x1100: "hangul", 0x1E00: "latin", 0x1F00: "greek", 0x3040: "kana", 0x3100: "han", 0xAC00: "hangul",
    0xF900: "han", 0xFF66: "kana", 0x20000: "han",
}
NAMES = sorted(set(SCRIPTS.values()))


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, its lower case, its script."""
    chars = [chr(i) if not 0xD800 <= i < 0xE000 else "\0" for i in range(0x110000)]
    alpha = np.fromiter((c.isalpha() for c in chars), bool, len(chars))
    lower = np.fromiter((ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars), np.uint32, len(chars))
    starts = np.array(sorted(SCRIPTS))
    kinds = np.array([NAMES.index(SCRIPTS[s]) for s in starts.tolist()], np.int8)
    script = kinds[np.maximum(np.searchsorted(starts, np.arange(0x110000), side="right") - 1, 0)]
    return alpha, lower, script


@dataclass
class Words:
    """Letters and words of some texts: bucket of each letter, first letter of each word, places in the texts."""

    buckets: np.ndarray
    first: np.ndarray
    count: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray


def read_words(texts: list[str | None]) -> Words:
    alpha, lower, script = letters()
    codes = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    gap = np.zeros(1, np.uint32)
    flat = np.concatenate([gap, *[x for c in codes for x in (c, gap)]])
    base = np.cumsum([1] + [len(c) + 1 for c in codes])
    is_letter = alpha[flat]
    low = np.where(is_letter, lower[flat], 0).astype(np.uint64)
    at = np.flatnonzero(is_letter)
    with np.errstate(over="ignore"):
        mix = low[at - 1] * np.uint64(0x9E3779B97F4A7C15) + low[at] * np.uint64(0xC2B2AE3D27D4EB4F) + low[at + 1] * np.uint64(0x165667B19E3779F9)
        buckets = ((mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int32)
    first = np.flatnonzero(~is_letter[at - 1])
    place = at[first]
    count = np.diff(np.append(first, len(at)))
    text = np.searchsorted(base, place, side="right") - 1
    start = place - base[text]
    return Words(buckets, first, count, text, start, start + count, script[flat[place]])


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (BUCKETS, languages) log probabilities
    allowed: np.ndarray  # (scripts, languages)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", rows: int = FIT_ROWS) -> Model:
    """Learn from ``docs``, the rows that may be learned from."""
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in docs.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n")).collect() if r["lang"] is not None}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, rows / n))])
    chosen = known.filter(F.pmod(F.xxhash64("text", "lang"), F.lit(1_000_000)) < F.get(F.array(F.element_at(share, F.col("lang"))), 0) * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in text_slices(batches, 2_000_000):
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in set(langs.tolist()):
                w = read_words([t for t, own in zip(batch.column(1).to_pylist(), langs, strict=True) if own == lang])
                a, b = found.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(len(NAMES), np.int64)))
                a += np.bincount(w.buckets, minlength=BUCKETS)
                b += np.bincount(w.script, weights=w.count, minlength=len(NAMES)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([a.tobytes() for a, _ in found.values()], pa.binary()), pa.array([b.tobytes() for _, b in found.values()], pa.binary())], names=["lang", "counts", "scripts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = [sum(np.frombuffer(x, np.int64) for x in group[c]) for c in ("counts", "scripts")]
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "counts": [total[0].tobytes()], "scripts": [total[1].tobytes()]})

    small_batches(docs.sparkSession)
    kinds = "lang string, counts binary, scripts binary"
    summed = chosen.repartition(PARTS).mapInArrow(count, kinds).groupBy("lang").applyInPandas(add, kinds).collect()  # a row a language
    found = sorted((r["lang"], np.frombuffer(r["counts"], np.int64), np.frombuffer(r["scripts"], np.int64)) for r in summed if r["lang"] is not None)
    found = [x for x in found if x[1].sum()]
    if not found:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    table = np.stack([np.log((c + 0.3) / (c.sum() + 0.3 * BUCKETS)) for _, c, _ in found], axis=1).astype(np.float32)
    return Model([x[0] for x in found], table, np.stack([s >= 0.01 * s.sum() for _, _, s in found], axis=1))


def best_path(scores: np.ndarray, switch: float) -> np.ndarray:
    """Viterbi: the language of each word."""
    total = scores.sum(0)
    best = int(np.argmax(total))
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros((1, gain.shape[1])), gain]), axis=0)[:-1]
    if (gain - low).max() <= switch / 2:  # k stretches without the best language have k - 1 switches at least, and in one language alone no gain
        return np.full(len(scores), best)
    k, back = scores.shape[1], []
    value = scores[0].tolist()
    for row in scores[1:].tolist():
        top = max(value)
        lead, floor = value.index(top), top - switch
        back.append([i if v >= floor else lead for i, v in enumerate(value)])
        value = [(v if v >= floor else floor) + s for v, s in zip(value, row, strict=True)]
    path = [max(range(k), key=value.__getitem__)]
    for step in reversed(back):
        path.append(step[path[-1]])
    return np.array(path[::-1])


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str | Column, ...] = ()) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` (start and end in code points), after the columns ``keep``."""
    spark, langs = docs.sparkSession, model.langs
    shared = spark.sparkContext.broadcast((model.table, model.allowed))  # bounded by the number of languages
    kept = docs.select(*keep).schema if keep else None
    out = "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, allowed = shared.value
        for batch in text_slices(batches, 2_000_000):
            preds, scores, spans = ["und"] * batch.num_rows, [0.0] * batch.num_rows, [[] for _ in range(batch.num_rows)]
            texts = batch.column("_text").to_pylist()
            w = read_words(texts)
            if langs and len(w.first):
                points = np.add.reduceat(table[w.buckets], w.first, axis=0, dtype=np.float64)
                can = allowed[w.script]
                can[~can.any(1)] = True
                points = np.where(can, points, points.max(1, keepdims=True) - OUTSIDE)
                edges = np.searchsorted(w.text, np.arange(batch.num_rows + 1))
                for row in range(batch.num_rows):
                    a, b = edges[row], edges[row + 1]
                    if a == b:
                        continue
                    path = best_path(points[a:b], switch)
                    share = np.bincount(path, weights=w.count[a:b], minlength=len(langs))
                    top = int(np.argmax(share))
                    preds[row], scores[row] = langs[top], float(share[top] / share.sum())
                    cut = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
                    last = np.append(cut[1:], len(path)) - 1
                    spans[row] = [{"start": int(w.start[a + s]), "end": int(w.end[a + e]), "lang": langs[path[s]]} for s, e in zip(cut.tolist(), last.tolist(), strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
            columns = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] not in ("_text", "_id")]
            names = [n for n in batch.schema.names if n not in ("_text", "_id")]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("_id"), pa.array(preds), pa.array(scores), pa.array(spans, kind)], names=[*names, "doc_id", "lang_pred", "score", "spans"])

    small_batches(spark)
    chosen = docs.select(*keep, F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields) + ", " if kept else ""
    return chosen.mapInArrow(label, kinds + out)
