"""Importance resampling towards a target: hashed n-gram buckets, array-scored weights, distributed quickselect.

Features are runs of one to three consecutive words, counted into buckets by CRC-32. What a bucket's
count in the target exceeds that in the raw texts by, on a log scale, is its gain; a text's weight is
the sum of its features' gains, looked up in one array of ``buckets`` numbers (the only thing that is sent
to the tasks). A Gumbel key from each id's SHA-256 turns the top of the scores into a draw without
replacement.

The draw's last row is found by quickselect over the key (score descending, id, row): each round takes
rows with the smallest hashes among those still in question as pivots, counts rows before and at each
pivot exactly, and keeps the one interval that holds the wanted place. Only the drawn rows are sorted.

Words are runs of ASCII letters and digits and of all other non-ASCII characters, A-Z lower-cased; null
and empty texts have none. A null id hashes as an empty one and comes last among equal scores. Repeated
rows are kept and drawn one by one, in the order of their place in the table. Long texts are read
piecewise, words never cut. Empty tables give empty results or count as zero. Only id and text are read,
so names of other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import stage, text_slices, with_row_key
from kinfold.llm.ordering import ranked

#: A-Z to a-z; what is neither a letter, a digit nor part of a non-ASCII character to a blank
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PIECE = 1_000_000
PIVOTS = 32


def word_runs(text: str | None) -> Iterator[tuple[list[bytes], int]]:
    """Words of pieces of a text, each with up to two words before it and how many these are."""
    plain = (text or "").encode("utf-8", "surrogatepass").translate(PLAIN)
    tail: list[bytes] = []
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        words = plain[at:end].split()
        yield tail + words, len(tail)
        tail, at = (tail + words)[-2:], end


def feature_hashes(text: str | None) -> tuple[np.ndarray, int]:
    """CRC-32 of every feature of a text, and its number of words."""
    found, total = [np.zeros(0, np.int64)], 0
    for words, old in word_runs(text):
        # a hash goes on where the one of the shorter run ended; runs that end before a new word were counted already
        one = list(map(zlib.crc32, words))
        next_words = [b" " + w for w in words]
        two = list(map(zlib.crc32, next_words[1:], one))
        three = list(map(zlib.crc32, next_words[2:], two))
        for size, hashes in enumerate((one, two, three)):
            found.append(np.array(hashes[max(0, old - size) :], np.int64))
        total += len(words) - old
    return np.concatenate(found), total


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all rows of ``text`` fall into each bucket; tasks send one sum a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in text_slices(batches, 8_000_000):
            held: list[np.ndarray] = []
            for text in batch.column(0).to_pylist():
                held.append(feature_hashes(text)[0] % buckets)
            sums += np.bincount(np.concatenate(held), minlength=buckets)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["bucket", "n"])

    sums = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of shares) of each bucket."""
    many = float(len(raw))
    s, t = raw.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + many) / ((s + 1) * (t.sum() + many)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``docs`` (``doc_id, text, _row``) as ``doc_id, _row, n_words, n_features, weight``."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 8_000_000):
            out = np.zeros((3, batch.num_rows), np.int64)
            for row, text in enumerate(batch.column(2).to_pylist()):
                hashes, out[0, row] = feature_hashes(text)
                out[1, row], out[2, row] = len(hashes), gain[hashes % len(gain)].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out)], names=["doc_id", "_row", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "_row", "text").mapInArrow(weigh, "doc_id long, _row long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def key_columns() -> list[Column]:
    """The order of a draw as ascending numbers: score, then id (null last), then row."""
    return [(-F.col("score")).alias("k1"), F.col("doc_id").isNull().cast("long").alias("k2"), F.coalesce("doc_id", F.lit(0)).alias("k3"), F.col("_row").alias("k4")]


def before(pivot: tuple[int, ...]) -> Column:
    """Whether a row's key comes before ``pivot``."""
    found = F.lit(False)
    for k in reversed(range(len(pivot))):
        own = F.col(f"k{k + 1}")
        found = (own < pivot[k]) | ((own == pivot[k]) & found)
    return found


def same(pivot: tuple[int, ...]) -> Column:
    found = F.lit(True)
    for k, value in enumerate(pivot):
        found = found & (F.col(f"k{k + 1}") == value)
    return found


def kth_key(rows: DataFrame, place: int) -> tuple[int, ...]:
    """The key of the row at ``place`` (from 1) in the order of ``k1, k2, k3, k4``, by quickselect."""
    left, seed = rows, 0
    low: tuple[int, ...] | None = None
    high: tuple[int, ...] | None = None
    while True:
        seed += 1
        chance = F.xxhash64("k1", "k3", "k4", F.lit(seed))
        some = left.groupBy(F.pmod(F.shiftright(chance, 20), F.lit(PIVOTS)).alias("part")).agg(F.min_by(F.struct("k1", "k2", "k3", "k4"), chance).alias("key"))
        pivots = sorted({tuple(r["key"]) for r in some.collect()})  # at most PIVOTS rows
        marks = [F.count_if(before(p)).alias(f"b{i}") for i, p in enumerate(pivots)] + [F.count_if(same(p)).alias(f"s{i}") for i, p in enumerate(pivots)]
        counts = left.agg(*marks).first()
        for i, pivot in enumerate(pivots):
            if place <= counts[f"b{i}"]:
                high = pivot
                break
            if place <= counts[f"b{i}"] + counts[f"s{i}"]:
                return pivot
            low, passed = pivot, counts[f"b{i}"] + counts[f"s{i}"]
        if low is not None and low in pivots:
            place -= passed
        left = rows
        if low is not None:
            # a filter on the first column alone reaches the file scan
            left = left.filter((F.col("k1") >= low[0]) & ~before(low) & ~same(low))
        if high is not None:
            left = left.filter((F.col("k1") <= high[0]) & before(high))


def draw(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; ``rank`` (from 1) is null where a row isn't drawn.

    ``percent`` of the rows with at least ``least_words`` words are drawn, rounded down. ``target`` has a ``text``.
    """
    keyed = with_row_key(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "_row")
    gain = gains(bucket_counts(keyed, buckets), bucket_counts(target, buckets))
    scored = weights(keyed, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    table = stage(scored.select("doc_id", "_row", "n_words", "n_features", "weight", "score", *key_columns()), "scores")
    able = table.filter(F.col("n_words") >= least_words)
    many = able.count() * percent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not many:
        return table.select(*out, F.lit(None).cast("long").alias("rank"))
    last = kth_key(able.select("k1", "k2", "k3", "k4"), many)
    drawn = (F.col("n_words") >= least_words) & (before(last) | same(last))
    winners = ranked(table.filter(drawn).select(*out, "k1", "k2", "k3", "k4"), [F.col(f"k{k}") for k in (1, 2, 3, 4)])
    rest = table.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank"))
    return winners.select(*out, (F.col("rank") + 1).alias("rank")).unionByName(rest)
