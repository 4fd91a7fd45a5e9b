"""HyperMinHash near duplicates: compressed registers in bands, corrected estimates, exact checks.

A text's distinct shingles fall into ``REGISTERS`` buckets by their hash; a bucket keeps its least second
hash, as its number of leading zeros and the 11 bits after the leading one (16 bits). Registers are cut
into ``BANDS`` of ``ROWS``; where a bucket is empty, banding borrows the register of the first filled
bucket in an order of its own. Texts that agree in a band share a cell. A pair of similarity 0.8 shares none
with a chance of (1 - 0.8^6)^64, about 4 in a billion, and less the more alike it is.

Texts of equal sets are one point. Each point is first checked against the point it meets in the most cells
among those that come first in one; only cells in which the links leave several groups are looked at again:
there points of different groups are compared by their registers, first for a spanning forest of the
closest, then, between groups still apart, for all that may be similar. Near copies that meet in many cells
meet as one crowd instead, if that is less work. A pair is only checked if its 1,024-bit parity sketches differ in
no more bits than the similarity allows, which loses none, and if its
estimate, corrected for registers that agree by chance, is within five standard errors of the threshold.
Checks are exact, on the full sets: the texts of a hub's partners pass by the hub's own text one by one.
Crowded cells and crowds are cut into blocks that meet two by two, crowded hubs into parts; none needs to fit in a task.

Fewer words than a shingle has: the whole sequence is the only one. Texts without words (null, empty or
blank) have no set and are linked with nothing. A null id never names a group unless all ids of it are
null, and isn't kept. Repeated rows are kept: all rows of a group's smallest id count as kept. Long texts are read whole.
Only the id and text columns are read, so that names of other columns cannot clash.
Equal hashes of different shingles or sets (64 bits) are not told apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import stage, text_slices, with_row_key
from kinfold.llm.components import components, extended
from kinfold.llm.exact import bodies, hash_set, mixed_spots, verified
from kinfold.llm.fingerprints import ODD, mixed, whole_runs

BANDS, ROWS = 64, 6
REGISTERS = BANDS * ROWS
MANTISSA, MOST_ZEROS, EMPTY = 11, 30, 0xFFFF
BLOCK = 1024


def registers(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set of hashes; ``EMPTY`` where no hash falls."""
    out = np.full(REGISTERS, EMPTY, np.uint16)
    if len(hashes):
        bucket = (((hashes & np.uint64(0xFFFFFFFF)) * np.uint64(REGISTERS)) >> np.uint64(32)).astype(np.int64)
        rest = mixed(hashes, 1) >> np.uint64(11)  # 53 bits: exact as a double
        order = np.argsort(bucket, kind="stable")
        used, starts = np.unique(bucket[order], return_index=True)
        fraction, exponent = np.frexp(np.maximum(np.minimum.reduceat(rest[order], starts), np.uint64(1)).astype(float))
        zeros = np.minimum(53 - exponent, MOST_ZEROS)
        out[used] = (zeros << MANTISSA) | ((fraction - 0.5) * 2 * (1 << MANTISSA)).astype(np.int64)
    return out


@cache
def lenders() -> np.ndarray:
    """For each register, the ranks of all registers in the order in which it borrows."""
    i = np.arange(REGISTERS, dtype=np.uint64)
    return np.argsort(np.argsort(mixed(i[:, None] * np.uint64(REGISTERS) + i, 2), axis=1), axis=1).astype(np.uint16)


def cells_of(own: np.ndarray) -> np.ndarray:
    """The cell of each band of one set's registers."""
    filled = own != EMPTY
    full = own
    if not filled.all():
        there, lacking = np.flatnonzero(filled), np.flatnonzero(~filled)
        full = own.copy()
        full[lacking] = own[there[np.argmin(lenders()[np.ix_(lacking, there)], axis=1)]]
    cell = np.arange(BANDS, dtype=np.uint64)
    for column in full.reshape(BANDS, ROWS).T:
        cell = mixed(cell ^ (column.astype(np.uint64) << np.uint64(40)), 3)
    return cell.view(np.int64)


def packed(own: np.ndarray) -> bytes:
    """A bit for each filled register, then those registers."""
    filled = own != EMPTY
    return np.packbits(filled).tobytes() + own[filled].astype("<u2").tobytes()


def unpacked(values: list[bytes]) -> np.ndarray:
    out = np.full((len(values), REGISTERS), EMPTY, np.uint16)
    for row, value in enumerate(values):
        filled = np.unpackbits(np.frombuffer(value, np.uint8, REGISTERS // 8)).astype(bool)
        out[row, filled] = np.frombuffer(value, "<u2", offset=REGISTERS // 8)
    return out


def chance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How often filled registers of unlike sets of ``a`` and ``b`` members agree.

    A register with z leading zeros covers values from 2^-(z+1) to 2^-z in 2048 steps; the least of k uniform
    values falls into a step of width w at x with about k w exp(-k x). Both densities are multiplied and
    summed, a step's middle standing for 16 of them.
    """
    zeros = np.arange(MOST_ZEROS)
    middles = (np.arange(128) + 0.5) / 128
    x = (2.0 ** -(zeros + 1))[:, None] * (1 + middles)
    width = (2.0 ** -(zeros + 1))[:, None] / (1 << MANTISSA)
    k, m = np.maximum(a / REGISTERS, 1e-9)[:, None, None], np.maximum(b / REGISTERS, 1e-9)[:, None, None]
    both = (k * m * np.exp(-(k + m) * x) * width**2 * 16).sum((1, 2))
    return np.minimum(0.5, both / ((1 - np.exp(-k[:, 0, 0])) * (1 - np.exp(-m[:, 0, 0]))))


def may_be_similar(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two register tables (of sets with ``a`` and ``b`` members) may reach a similarity, and estimates."""
    fits = np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9
    estimate = np.zeros(len(x))
    at = np.flatnonzero(fits)
    if len(at):
        u, v, n = x[at], y[at], (a[at] + b[at]).astype(float)
        seen = np.maximum(1, ((u != EMPTY) | (v != EMPTY)).sum(1))
        shared = ((u != EMPTY) & (v != EMPTY)).sum(1)
        agree = ((u == v) & (u != EMPTY)).sum(1).astype(float)
        _, first, back = np.unique(np.stack([np.log2(a[at]).round(1), np.log2(b[at]).round(1)]), axis=1, return_index=True, return_inverse=True)
        odds = chance(a[at][first].astype(float), b[at][first].astype(float))[back.reshape(-1)]
        estimate[at] = np.maximum(0, agree - shared * odds) / (seen - shared * odds)
        union = np.maximum(seen, n / (1 + similarity))
        error = np.sqrt(similarity * (1 - similarity) / seen * np.maximum(1 - seen / union, 0.05))
        fits[at] = estimate[at] >= similarity - 5 * error - 2 / seen
    return fits, estimate


def parities(hashes: np.ndarray) -> bytes:
    """``ODD`` bits, each flipped by every hash that falls on it: two sets differ in no fewer members than in bits."""
    flips = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % ODD, minlength=ODD)
    return np.packbits((flips & 1).astype(np.uint8)).tobytes()


def bits_of(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint64).reshape(len(values), ODD // 64)


def within(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows of two tables of parities (of sets with ``a`` and ``b`` members) don't rule out a similarity."""
    differ = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return differ <= (a + b) * (1 - similarity) / (1 + similarity) + 1e-6


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, _row`` with ``key`` (a hash of the set), ``n``, packed ``registers`` and parities ``odd``."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in text_slices(batches, 8_000_000):
            keys, sizes, packs, odd = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64), [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                found = hash_set(text, size)
                keys[row], sizes[row] = xxh64_intdigest(found.tobytes()), len(found)
                packs.append(packed(registers(found)))
                odd.append(parities(found))
            columns = [batch.column(0), batch.column(1), pa.array(keys.view(np.int64)), pa.array(sizes), pa.array(packs, pa.binary()), pa.array(odd, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_row", "key", "n", "registers", "odd"])

    return docs.select("doc_id", "_row", "text").mapInArrow(compute, "doc_id long, _row long, key long, n long, registers binary, odd binary")


def banded(points: DataFrame) -> DataFrame:
    """``cell, key`` of every band of every point."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2_000_000):
            cells = [cells_of(own) for own in unpacked(batch.column(1).to_pylist())]
            keys = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells) if cells else keys), pa.array(keys)], names=["cell", "key"])

    return points.select("key", "registers").mapInArrow(place, "cell long, key long")


def estimated(pairs: DataFrame, points: DataFrame, similarity: float) -> DataFrame:
    """The ``hub, key`` pairs that may be similar enough by their parities and registers."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2_000_000):
            sizes = (batch.column(c).to_numpy() for c in ("a", "b"))
            near = within(*(bits_of(batch.column(c).to_pylist()) for c in ("u", "v")), *sizes, similarity)
            batch = batch.filter(pa.array(near))
            x, y = (unpacked(batch.column(c).to_pylist()) for c in ("x", "y"))
            fits, _ = may_be_similar(x, y, batch.column("a").to_numpy(), batch.column("b").to_numpy(), similarity)
            yield batch.select(["hub", "key"]).filter(pa.array(fits))

    own = points.select("key", F.col("n").alias("b"), F.col("registers").alias("y"), F.col("odd").alias("v"))
    hubs = points.select(F.col("key").alias("hub"), F.col("n").alias("a"), F.col("registers").alias("x"), F.col("odd").alias("u"))
    near = pairs.join(own, "key").join(hubs, "hub").filter(F.least("a", "b") >= similarity * F.greatest("a", "b") - 1e-9)
    return near.select("hub", "key", "a", "x", "u", "b", "y", "v").mapInArrow(choose, "hub long, key long")


def across(rows: DataFrame, similarity: float, thin: bool) -> DataFrame:
    """Pairs ``hub, key`` of different groups in ``rows`` (``spot, key, root, n, registers, odd``) that may be similar.

    ``thin``: a spot leaves a spanning forest over its groups, closest pairs first.
    """

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "spot"):
            spots, keys, roots, sizes = (table.column(c).to_numpy() for c in ("spot", "key", "root", "n"))
            own, odd = unpacked(table.column("registers").to_pylist()), bits_of(table.column("odd").to_pylist())
            found: list[tuple[np.ndarray, ...]] = []
            ends = np.searchsorted(spots, spots, side="right")
            active, lag = np.arange(len(spots)), 1
            while len(active := active[active + lag < ends[active]]):
                apart = active[(roots[active] != roots[active + lag]) & (keys[active] != keys[active + lag])]
                for at in range(0, len(apart), 8192):
                    x = apart[at : at + 8192]
                    x = x[within(odd[x], odd[x + lag], sizes[x], sizes[x + lag], similarity)]
                    if not len(x):
                        continue
                    fits, estimate = may_be_similar(own[x], own[x + lag], sizes[x], sizes[x + lag], similarity)
                    if fits.any():
                        found.append((x[fits], x[fits] + lag, estimate[fits]))
                lag += 1
            a, b, e = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
            if thin and len(a):
                keep, up = [], {}

                def top(x: tuple[int, int], up=up) -> tuple[int, int]:
                    while up.get(x, x) != x:
                        up[x] = x = up.get(up[x], up[x])
                    return x

                for k in np.lexsort((keys[b], keys[a], -e)).tolist():
                    x, y = (top((int(spots[i]), int(roots[i]))) for i in (a[k], b[k]))
                    if x != y:
                        up[max(x, y)] = min(x, y)
                        keep.append(k)
                a, b = a[keep], b[keep]
            both = np.unique(np.stack([np.minimum(keys[a], keys[b]), np.maximum(keys[a], keys[b])], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["hub", "key"])

    dealt = rows.repartition("spot").sortWithinPartitions("spot", "key").select("spot", "key", "root", "n", "registers", "odd")
    return dealt.mapInArrow(pair, "hub long, key long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id, text``)."""
    rows = with_row_key(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "_row")
    prints = stage(sketched(rows, size), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")
    points = stage(prints.filter("n > 0").groupBy("key").agg(first, F.min("n").alias("n"), F.min("registers").alias("registers"), F.min("odd").alias("odd")), "points")
    placed = banded(points)
    met = placed.groupBy("cell").agg(F.min("key").alias("hub"), F.max("key").alias("other")).filter("hub != other").select("cell", "hub")
    shared = stage(placed.join(met, "cell"), "cells")
    wanted = shared.select("key").distinct().join(points.select("key", F.col("first._row").alias("_row")), "key")
    texts = stage(bodies(rows, wanted), "bodies")

    counted = shared.filter("hub != key").groupBy("key", "hub").agg(F.count("*").alias("m"))
    best = counted.groupBy("key").agg(F.max_by("hub", F.struct("m", -F.col("hub"))).alias("hub"))
    tried = stage(estimated(best, points, similarity), "pairs")
    groups = components(stage(verified(tried, texts, size, similarity), "links"))
    tried = tried.select(F.least("hub", "key").alias("hub"), F.greatest("hub", "key").alias("key"))
    for thin in (True, False):
        # the closest pairs only spare the last pass work: a quarter of the cells finds most of them
        seen = shared.filter(F.pmod("cell", F.lit(4)) == 0) if thin else shared
        near = across(mixed_spots(seen.select("cell", "key"), groups.withColumnRenamed("node", "key"), points.select("key", "n", "registers", "odd"), BLOCK), similarity, thin)
        new = stage(near.join(tried, ["hub", "key"], "left_anti"), "pairs")
        tried = tried.unionByName(new)
        groups = extended(groups, stage(verified(new, texts, size, similarity), "links"))

    named = points.select("key", "first.doc_id").join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    places = named.join(least, "root").select("key", "component_id")
    linked = prints.select("doc_id", "key", "n").join(places, "key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return linked.select("doc_id", F.col("n").alias("n_shingles"), component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
