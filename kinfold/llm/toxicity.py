"""Toxicity of whole texts: gradient-boosted trees over dense features, isotonic calibration.

Fitting learns from at most ``FIT_TOXIC`` toxic and ``FIT_CLEAN`` clean labelled texts, chosen by a
hash of the id. From their words and word beginnings it takes a lexicon (``TERMS`` at most) of what
stands in toxic texts far more often than in clean ones; features are densities of its terms, how
near they stand to a second-person word, capitals, punctuation, digits and obfuscated words
(symbols or digits within letters, read back to letters). The calibration learns from each half of the
sample as scored by trees of the other half; the trees that stay learn from all of it.

Null and empty texts have features of zero and a score like any other. With labels of one kind only
the score is that label; with none it is 0. Repeated label rows of an id count as toxic if one is.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import small_batches, stage, text_slices

FIT_TOXIC, FIT_CLEAN, TERMS, CHANCE, LIMIT = 8_000, 16_000, 2_000, 8.0, 0.7
BEGINNINGS, NEAR, PARTS = range(4, 8), 5, 16
EDGES = ".,;:!?\"'()[]{}<>|*%$&#@+-_=/\\~^`…«»“”„’‘¿¡"
#: Second-person words and what obfuscating characters stand for.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tu tus usted ustedes vosotros".split())
READ_AS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t", "*": "", "-": "", ".": "", "_": ""})
HIDDEN = re.compile(r"[^\W\d_][0-9@$!+*._-]+(?:[^\W\d_]+[0-9@$!+*._-]*)+")
FEATURES = ("strong", "strong_n", "weak", "stems", "stems_n", "near_you", "hidden", "hidden_hits", "capitals", "marks", "digits", "loud", "n_words")


def words_of(text: str) -> list[str]:
    return [w.strip(EDGES) for w in text.lower().split()]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Bytes by kind: capitals, digits, punctuation, exclamation and question marks."""
    out = np.zeros((256, 4))
    for i in range(128):
        c = chr(i)
        out[i] = [c.isupper(), c.isdigit(), not c.isalnum() and not c.isspace(), c in "!?"]
    return out


@dataclass
class Lexicon:
    strong: frozenset[str]
    weak: frozenset[str]
    stems: frozenset[str]


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    words = words_of(text)
    n = max(1, len(words))
    seen = set(words)
    strong, weak = seen & lexicon.strong, seen & lexicon.weak
    stems = {w for w in seen if w[:4] in lexicon.stems or w[:5] in lexicon.stems or w[:6] in lexicon.stems or w[:7] in lexicon.stems} if lexicon.stems else set()
    many, few, begun, near = 0, 0, 0, 0
    if strong or weak or stems:
        counts = Counter(words)
        many, few, begun = (sum(counts[w] for w in x) for x in (strong, weak, stems))
        you = [i for i, w in enumerate(words) if w in SECOND]
        if you and (strong or stems):
            spots = np.array(you)
            at = np.array([i for i, w in enumerate(words) if w in strong or w in stems])
            after = np.clip(np.searchsorted(spots, at), 0, len(spots) - 1)
            gap = np.minimum(np.abs(spots[after] - at), np.abs(spots[np.maximum(after - 1, 0)] - at))
            near = int((gap <= NEAR).sum()) / len(at)
    hidden = HIDDEN.findall(text)
    read = [h.lower().translate(READ_AS) for h in hidden]
    hits = sum(r in lexicon.strong or any(r[:k] in lexicon.stems for k in BEGINNINGS) for r in read)
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ classes() / max(1, len(raw))
    return [1000 * many / n, float(np.log1p(many)), 1000 * few / n, 1000 * begun / n, float(np.log1p(begun)), float(near), 1000 * len(hidden) / n, float(hits), *kinds[[0, 2, 1, 3]].tolist(), float(np.log1p(len(words)))]


def featurize(docs: DataFrame, lexicon: Lexicon, keep: tuple[str | Column, ...], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the features of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most TERMS terms
    kept = docs.select(*keep).schema

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 8_000_000):
            rows = np.array([features(t, shared.value) for t in batch.column("_text").to_pylist()], float).reshape(-1, len(FEATURES))
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(rows[:, i].copy()) for i in range(len(FEATURES))], names=[*names, *[f"_{f}" for f in FEATURES]])

    small_batches(docs.sparkSession)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields] + [f"_{f} double" for f in FEATURES]
    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(compute, ", ".join(kinds))


def fit_lexicon(sample: DataFrame) -> Lexicon:
    """Terms of the sample (``text``, ``toxic``) that are far likelier in toxic texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = {w for w in words_of(text or "") if 2 < len(w) < 40}
                counts[toxic].update(terms | {w[:k] + "*" for w in terms for k in BEGINNINGS if len(w) >= k})
        toxic = [(t, n, counts[0][t]) for t, n in counts[1].items()]
        clean = [(t, 0, n) for t, n in counts[0].items() if t not in counts[1]]
        both = toxic + clean
        for at in range(0, len(both), 50_000):
            a, b, c = zip(*both[at : at + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["term", "t", "c"])

    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    terms = sample.select("text", F.col("toxic").cast("int")).mapInArrow(count, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    # a term that only chance puts into toxic texts alone is in few of them: share^t stays below e^-CHANCE
    least = CHANCE / math.log((toxic + clean + 1) / (toxic + 0.5))
    good = terms.filter(F.col("t") >= max(3, 0.001 * toxic, least)).withColumn("odds", odds).filter(F.col("odds") >= 3)
    top = good.orderBy(F.desc("t"), "term").limit(TERMS).collect()  # the lexicon: TERMS at most
    often = [r for r in top if r["t"] >= 0.01 * toxic]
    return Lexicon(
        frozenset(r["term"] for r in often if r["term"][-1] != "*"), frozenset(r["term"] for r in top if r["t"] < 0.01 * toxic and r["term"][-1] != "*"),
        frozenset(r["term"][:-1] for r in often if r["term"][-1] == "*"))


@dataclass
class Model:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None
    constant: float


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from the labels given (leave held-out rows out before)."""
    key = F.col(id_col).cast("long")
    marked = labels.filter(F.col(label_col).isNotNull()).groupBy(key.alias("_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic")).filter(F.col("_id").isNotNull())
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    none = Lexicon(frozenset(), frozenset(), frozenset())
    if len(sizes) < 2:
        return Model(none, None, None, float(max(sizes, default=0)))
    share = F.when(F.col("toxic") == 1, min(1.0, FIT_TOXIC / sizes[1])).otherwise(min(1.0, FIT_CLEAN / sizes[0]))
    chosen = marked.filter(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1_000_000)) < share * 1_000_000)
    rows = docs.select(key.alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")  # FIT_TOXIC + FIT_CLEAN ids
    once = rows.groupBy(F.xxhash64("text").alias("_h")).agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))  # a text counts once
    sample = stage(once.repartition(PARTS, "_h"), "toxic")
    kinds = {r["toxic"] for r in sample.select("toxic").distinct().collect()}
    if len(kinds) < 2:
        return Model(none, None, None, float(max(kinds, default=0)))
    lexicon = fit_lexicon(sample)
    table = stage(assembled(featurize(sample, lexicon, (F.col("_h"), F.col("toxic").cast("double").alias("toxic")))).select("_h", "toxic", "features"), "toxic")
    half = F.pmod(F.xxhash64("_h", F.lit(11)), F.lit(2))
    halves = [table.filter(half == k) for k in range(2)]
    if any(part.select("toxic").distinct().count() < 2 for part in halves):
        halves = [table, table]  # too few rows to part them
    # each half is scored by trees that haven't seen it, for the calibration; the trees kept learn from all
    fitted = [grow(part) for part in halves]
    scored = [fitted[1 - k].transform(part).select(vector_to_array("probability")[1].alias("raw"), "toxic") for k, part in enumerate(halves)]
    trees = grow(table)
    curve = IsotonicRegression(featuresCol="raw", labelCol="toxic", predictionCol="score").fit(scored[0].unionByName(scored[1]))
    return Model(lexicon, trees, curve, 0.0)


def grow(table: DataFrame) -> GBTClassificationModel:
    return GBTClassifier(featuresCol="features", labelCol="toxic", maxIter=12, maxDepth=3, stepSize=0.3, minInstancesPerNode=3, seed=7).fit(table)


def assembled(table: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"_{f}" for f in FEATURES], outputCol="features").transform(table).drop(*[f"_{f}" for f in FEATURES])


def score(docs: DataFrame, model: Model, keep: tuple[str | Column, ...], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with ``score`` (0 to 1) and ``predicted`` (1 from ``LIMIT`` on)."""
    if model.trees is None:
        out = docs.select(*keep, F.lit(model.constant).alias("score"))
    else:
        names = docs.select(*keep).columns
        found = model.trees.transform(assembled(featurize(docs, model.lexicon, keep, text_col)))
        raised = model.curve.transform(found.withColumn("raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction"))
        out = raised.select(*[F.col(f"`{n}`") for n in names], F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))
