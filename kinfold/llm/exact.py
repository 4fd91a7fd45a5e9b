"""Cells in which groups are still apart, and exact checks of pairs on their full shingle sets.

One hub's partners are checked at a time. A text crosses the shuffle compressed, once as the head of each
part of its own partners and once for each hub that it is a partner of; sets are cut anew from the words
where they meet, as words take a fraction of the bytes of their shingles' hashes. A hub with more than
``PART`` partners is cut into parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import small_batches, stage, text_slices
from kinfold.llm.components import components
from kinfold.llm.words import shingles, words_of

PART = 512
#: Points of a cell from which on cells that share points may be taken together.
CROWD = 16
#: Such cells that two points of a crowd share; points that share fewer gain little by meeting once.
TIES = 4


def hash_set(text: str | bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; bytes are words joined by blanks."""
    from xxhash import xxh64_intdigest

    words = text.split(b" ") if isinstance(text, bytes) and text else words_of(text or None)
    return np.unique(np.fromiter(map(xxh64_intdigest, set(shingles(words, size))), np.uint64))


def bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key`` and ``body``, its words joined by blanks and compressed, for ``wanted`` (``key, _row``)."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        for batch in text_slices(batches, 8_000_000):
            small = [ZstdCompressor(3).compress(b" ".join(words_of(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(small, pa.binary())], names=["_row", "body"])

    small_batches(docs.sparkSession)
    return docs.select("_row", "text").mapInArrow(shrink, "_row long, body binary").join(wanted, "_row").select("key", "body")


def verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links ``a, b``: the ``hub, key`` pairs whose full sets reach the similarity; both must be in ``texts``."""
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    split = pairs.join(parts, "hub").select("hub", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), "key")
    heads = split.select("hub", "part").distinct().select("hub", "part", F.col("hub").alias("key"), F.lit(0).alias("role"))
    rows = split.withColumn("role", F.lit(1)).unionByName(heads).join(texts, "key")
    dealt = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "role", "key").select("hub", "key", "role", "body")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdDecompressor

        hub, own, percent = None, np.zeros(0, np.uint64), round(100 * similarity)
        for batch in batches:
            a, b = [], []
            for head, key, role, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if role == 0 and head == hub:
                    continue  # another part of the same hub
                found = hash_set(ZstdDecompressor().decompress(body), size)
                if role == 0:
                    hub, own = head, found
                    continue
                if head != hub:
                    continue  # the hub's own text isn't there
                both = len(np.intersect1d(own, found, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(found) - both):
                    a.append(head)
                    b.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    small_batches(pairs.sparkSession)
    return dealt.mapInArrow(check, "a long, b long")


def rows_made(size: str, blocks: Column) -> Column:
    """How many rows ``size`` points make that meet in ``blocks`` blocks, two by two."""
    return F.col(size) * F.greatest(F.lit(1), blocks - 1)


def pairs_met(size: str, blocks: Column) -> Column:
    """Twice the pairs that ``size`` points are compared in: blocks of two meet as one, each of more meets all others."""
    return F.col(size).cast("double") * F.col(size) * F.greatest(F.lit(1.0), 2 - 2 / blocks)


def mixed_rows(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """``cell, key, root, m, hub``: the cells of ``shared`` that hold points of several ``groups``, their sizes and first points."""
    named = shared.join(groups, "key", "left").withColumn("root", F.coalesce("root", "key"))
    several = named.groupBy("cell").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("m"), F.min("key").alias("hub")).filter("x != y")
    return stage(named.join(several.select("cell", "m", "hub"), "cell").select("cell", "key", "root", "m", "hub"), "mixed")


def tied(rows: DataFrame, least: int = TIES) -> DataFrame | None:
    """``key, crowd``: points of ``rows`` (of ``mixed_rows``) that may meet as one crowd; None if no cell is large.

    Points that share ``least`` cells of ``CROWD`` points or more with the first point of each make a crowd, directly or
    by way of others. Where a cell is a single shingle, one is no tie: the larger a table, the more texts are strung together.
    """
    large = rows.filter(F.col("m") >= CROWD)
    if large.isEmpty():
        return None
    ties = large.filter(F.col("hub") != F.col("key")).groupBy("hub", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return components(ties.select(F.col("hub").alias("a"), F.col("key").alias("b"))).select(F.col("node").alias("key"), F.col("root").alias("crowd"))


def crowds(rows: DataFrame, ties: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """``cell, key, root, blocks``: points of ``rows`` that meet as one crowd of ``ties``, and each ``cell`` that lies within one.

    Near copies meet in many cells; as a crowd each pair meets once or twice. A crowd is only taken if this makes no more rows
    and no more pairs than the cells that lie within it do.
    """
    named = stage(rows.join(ties, "key", "left").select("cell", "key", "root", "m", "crowd"), "named")
    held = named.groupBy("cell").agg(F.min("crowd").alias("crowd"), F.max("crowd").alias("y"), F.count("crowd").alias("n"), F.max("m").alias("m"))
    within = held.filter("n = m AND crowd = y").select("cell", "crowd", "m")
    cut = F.ceil(F.col("m") / block)
    in_cells = within.groupBy("crowd").agg(F.sum(rows_made("m", cut)).alias("made"), F.sum(pairs_met("m", cut)).alias("met"))
    members = named.filter("crowd IS NOT NULL").select("key", "root", "crowd").distinct()
    sizes = members.groupBy("crowd").agg(F.count("*").alias("p")).withColumn("blocks", F.ceil(F.col("p") / (block // 2)).cast("int"))
    less = (rows_made("p", F.col("blocks")) <= F.col("made")) & (pairs_met("p", F.col("blocks")) <= F.col("met"))
    taken = stage(sizes.join(in_cells, "crowd").filter(less).select("crowd", "blocks"), "crowds")
    whole = members.join(taken, "crowd").select(F.xxhash64(F.lit("crowd"), "crowd").alias("cell"), "key", "root", "blocks")
    return whole, within.join(taken, "crowd", "left_semi").select("cell")


def mixed_spots(shared: DataFrame, groups: DataFrame, points: DataFrame, block: int) -> DataFrame:
    """``spot, root`` and the columns of ``points``: where points of several ``groups`` meet that share a cell of ``shared``.

    Such a cell is rarely shared by chance, so that one large cell is tie enough.
    """
    rows = mixed_rows(shared, groups)
    return meeting(rows, tied(rows, 1), points, block)


def meeting(rows: DataFrame, ties: DataFrame | None, points: DataFrame, block: int) -> DataFrame:
    """``spot, root`` and the columns of ``points``: where the points of ``rows`` (of ``mixed_rows``) meet.

    Points that share several large cells meet as a crowd of ``ties``; a cell that lies within one isn't looked at. Other
    cells are spots of their own. Both are counted; where there are more than ``block`` points (half as many for a
    crowd) they are cut into blocks that meet two by two.
    """
    met = rows.select("cell", "key", "root", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    if ties is not None:
        whole, within = crowds(rows, ties, block)
        met = met.join(within, "cell", "left_anti").unionByName(whole)
    own: Column = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    pairs = met.select("cell", "key", "root", "blocks", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    # a block meets itself wherever it meets another
    pairs = pairs.filter("blocks = 1 OR own != other")
    spots = pairs.select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("spot"), "key", "root")
    # cells that hold the same points are looked at once
    same = spots.groupBy("spot").agg(F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("h"), F.count("*").alias("m"))
    one = spots.join(same.groupBy("h", "m").agg(F.min("spot").alias("spot")), "spot", "left_semi")
    return one.join(points, "key")
