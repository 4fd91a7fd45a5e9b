"""SimHash near duplicates: segment popcounts, a grid join under Manhattan distance, exact checks.

A fingerprint has one or more lanes of 64 bits. Its bits are cut into segments of 4; a segment's
count of set bits is a coordinate, 8 of them (32 bits) make a point. Counts of two fingerprints
differ by no more than their bits do, so the Manhattan distance of two points is a lower bound of
the Hamming distance. Two 64-bit fingerprints within 3 bits are within 1 of each other in one of
their two points: each point is put into its own grid cell and, marked as a visitor, into the cells
one step up each axis, and within a cell every owner meets the owners and visitors after it.
Distances are then computed exactly.

A cell leaves a minimum spanning forest (closest pairs first) of its linked members, not its pairs:
components are kept, and a group of near copies costs as many rows as it has members. Equal
fingerprints are one point from the start. A cell with more than ``BLOCK`` points is cut into blocks
that meet two by two, so no cell needs to fit in a task.

Fewer words than a shingle has: the whole sequence is the only shingle. No words (null, empty or
blank text): fingerprint zero, linked like any other. Null ids are kept in the result, but never
name a component unless all ids of it are null. Repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import small_batches, stage, text_slices, with_row_key
from kinfold.llm.components import components, extended
from kinfold.llm.exact import bodies, meeting, mixed_rows, tied, verified
from kinfold.llm.words import shingles, words_of

BLOCK = 4096
#: Bits of a set's sketch, texts sampled for common shingles, and how many of those are kept.
ODD, SAMPLE, COMMON = 1024, 4096, 200_000
SEGMENT, AXES = 4, 8
#: Links that a forest holds before it keeps the spanning ones.
HELD = 524_288


def majority_bits(hashes: np.ndarray) -> np.ndarray:
    """The bits (as one unsigned 64-bit integer) that are set in over half of the hashes."""
    if not len(hashes):
        return np.zeros(1, np.uint64)
    bits = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(bits), 65_536):
        counts += np.unpackbits(bits[at : at + 65_536], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")


def mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Hashes of another lane: lane 0 as they are, else an invertible 64-bit mix."""
    if lane == 0:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes + np.uint64((0x9E3779B97F4A7C15 * lane) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42, lanes: int = 1, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``content`` (a hash of the word sequence) and ``f0..``: the lanes as signed 64-bit integers.

    ``distinct``: a shingle counts once a text.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in text_slices(batches, 8_000_000):
            out, content = np.zeros((batch.num_rows, lanes), "<u8"), np.zeros(batch.num_rows, "<u8")
            for row, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text)
                found = shingles(words, size)
                content[row] = xxh64_intdigest(b" ".join(words))
                hashes = np.fromiter((xxh64_intdigest(x, seed) for x in (set(found) if distinct else found)), np.uint64)
                for lane in range(lanes):
                    out[row, lane] = majority_bits(mixed(hashes, lane))[0]
            columns = [batch.column(0), pa.array(content.view("<i8"))] + [pa.array(np.ascontiguousarray(out[:, k]).view("<i8")) for k in range(lanes)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "content"] + [f"f{k}" for k in range(lanes)])

    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(compute, ", ".join(["doc_id long", "content long"] + [f"f{k} long" for k in range(lanes)]))


def grid(points: DataFrame, lanes: int) -> DataFrame:
    """Points in their cells: ``cell``, ``visitor`` (0 or 1), ``key`` and the lanes.

    A cell's number holds which half of which lane it is for and 8 counts of 4 bits each.
    """
    small_batches(points.sparkSession, 20_000)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones = np.uint64(0x1111111111111111)
        for batch in batches:
            n = batch.num_rows
            for lane in range(lanes):
                x = batch.column(1 + lane).to_numpy(zero_copy_only=False).view(np.uint64)
                y = (x & ones) + ((x >> np.uint64(1)) & ones) + ((x >> np.uint64(2)) & ones) + ((x >> np.uint64(3)) & ones)
                for half in range(2):
                    own = ((y >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)) | np.uint64((2 * lane + half) << 32)
                    cells = [own] + [own + np.uint64(1 << (4 * axis)) for axis in range(AXES)]
                    names = ["cell", "visitor"] + batch.schema.names
                    columns = [pa.array(np.concatenate(cells).view(np.int64)), pa.array(np.repeat(np.array([0] + [1] * AXES, np.int8), n))]
                    columns += [pa.concat_arrays([c] * (AXES + 1)) for c in batch.columns]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = "cell long, visitor byte, key long, " + ", ".join(f"f{k} long" for k in range(lanes))
    return points.select("key", *[f"f{k}" for k in range(lanes)]).mapInArrow(place, kinds)


def forest(
    cells: np.ndarray, visitor: np.ndarray, keys: np.ndarray, lanes: np.ndarray, radius: int | np.ndarray, roots: np.ndarray | None = None, thin: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spanning forest of the links in sorted runs of cells (owners first): keys of both ends, and distances.

    Pairs are an owner and any later member of its run, taken lag by lag over all runs at once. A pair's
    limit is ``radius``, or the sum of both members' shares if it is an array. Members of equal ``roots``
    aren't paired. Without ``thin`` all links are returned.
    """
    n = len(cells)
    ends = np.searchsorted(cells, cells, side="right")
    active = np.flatnonzero((visitor == 0) & (np.arange(n) + 1 < ends))
    links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held, lag, label = 0, 1, np.arange(n)

    def spanning() -> None:
        nonlocal links, held, label
        a, b, d = (np.concatenate(x) for x in zip(*links, strict=True))
        order = np.argsort(d, kind="stable")
        label = np.arange(n)
        keep = []
        for dist in np.unique(d):
            at = order[d[order] == dist]
            at = at[label[a[at]] != label[b[at]]]
            for k in at.tolist():
                x, y = a[k], b[k]
                while label[x] != x:
                    label[x] = label[label[x]]
                    x = label[x]
                while label[y] != y:
                    label[y] = label[label[y]]
                    y = label[y]
                if x != y:
                    label[max(x, y)] = min(x, y)
                    keep.append(k)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
        keep = np.array(keep, np.int64)
        links, held = [(a[keep], b[keep], d[keep])], len(keep)

    while len(active):
        other = active + lag
        dist = np.bitwise_count(lanes[active] ^ lanes[other]).sum(1, dtype=np.int64)
        most = radius if np.ndim(radius) == 0 else radius[active] + radius[other]
        hit = (dist <= most) & (keys[active] != keys[other])
        if roots is not None:
            hit &= roots[active] != roots[other]
        if hit.any():
            links.append((active[hit], other[hit], dist[hit]))
            held += int(hit.sum())
            if thin and held > HELD:
                spanning()
        lag += 1
        active = active[active + lag < ends[active]]
    if not links:
        return (np.zeros(0, np.int64),) * 3
    if thin:
        spanning()
    a, b, d = (np.concatenate(x) for x in zip(*links, strict=True))
    return keys[a], keys[b], d


def links(points: DataFrame, radius: int, lanes: int = 1) -> DataFrame:
    """Links ``a, b, bits`` that span the groups of ``points`` (``key`` and lanes ``f0..``) within ``radius`` bits.

    Complete for a radius of 3 over one lane; wider radii over more lanes are found if two points
    are within 1 of each other in any of the lanes' halves.
    """
    names = [f"f{k}" for k in range(lanes)]
    placed = grid(points, lanes)
    crowded = placed.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    cut = placed.join(crowded, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("key", "visitor"), F.col("blocks")).cast("int")
    rows = cut.select("cell", "visitor", "key", *names, own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pair = F.struct(F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    dealt = rows.select(F.xxhash64("cell", pair["x"], pair["y"]).alias("spot"), "visitor", "key", *names)
    ordered = dealt.repartition("spot").sortWithinPartitions("spot", "visitor", "key")  # cells whose spots collide only meet in vain

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def found(table: pa.Table) -> pa.RecordBatch:
            keep = [table.column(c).to_numpy() for c in ("spot", "visitor", "key", *names)]
            values = np.stack([c.view(np.uint64) for c in keep[3:]], axis=1)
            a, b, d = forest(keep[0], keep[1], keep[2], values, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d.astype(np.int32))], names=["a", "b", "bits"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
            spots = table.column("spot").to_numpy()
            last = int(np.searchsorted(spots, spots[-1], side="left")) if len(spots) else 0
            if last:
                yield found(table.slice(0, last))
            rest = table.slice(last)
        if rest is not None and rest.num_rows:
            yield found(rest)

    small_batches(points.sparkSession, 20_000)
    return ordered.select("spot", "visitor", "key", *names).mapInArrow(link, "a long, b long, bits int")


def near_duplicates(docs: DataFrame, size: int = 3, seed: int = 42, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest id that links reach."""
    prints = stage(fingerprints(docs, size, seed, id_col=id_col, text_col=text_col).drop("content"), "prints")
    points = stage(prints.groupBy("f0").agg(F.min("doc_id").alias("least")).withColumn("key", F.col("f0")), "points")
    groups = components(stage(links(points, radius).select("a", "b").distinct(), "links"))  # key -> root, for linked points only
    members = groups.join(points, groups["node"] == points["key"]).select("node", "root", "least")
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = members.join(least, "root").select(F.col("node").alias("f0"), "component_id")
    own = points.select("f0", "least")
    places = own.join(named, "f0", "left").select("f0", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(places, "f0").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_table(texts: DataFrame, size: int) -> DataFrame:
    """``key`` and the distinct hashes of the shingles of ``text``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in text_slices(batches, 4_000_000):
            rows = [np.array(list({xxh64_intdigest(x) for x in shingles(words_of(t), size)}), np.uint64).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tolist() for r in rows], pa.list_(pa.int64()))], names=["key", "parts"])

    small_batches(texts.sparkSession)
    return texts.select("key", "text").mapInArrow(cut, "key long, parts array<long>")


def hashed(text: str | None, size: int) -> tuple[int, np.ndarray]:
    """A hash of the word sequence, and the distinct hashes of its shingles."""
    from xxhash import xxh64_intdigest

    words = words_of(text)
    return xxh64_intdigest(b" ".join(words)), np.fromiter(set(map(xxh64_intdigest, shingles(words, size))), np.uint64)


def sketches(texts: DataFrame, size: int) -> DataFrame:
    """``_row``, ``content`` (a hash of the word sequence), ``n`` (distinct shingles), fingerprint ``f0`` and ``odd``.

    A bit of the fingerprint is set if it is in over half of the distinct shingles' hashes. Each shingle flips one of ``ODD`` bits, so two sketches differ in no more bits than their sets do in members.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 8_000_000):
            content, sizes, odd = np.zeros((2, batch.num_rows), np.uint64), np.zeros(batch.num_rows, np.int32), []
            for row, text in enumerate(batch.column(1).to_pylist()):
                content[0, row], found = hashed(text, size)
                content[1, row], sizes[row] = majority_bits(found)[0], len(found)
                flips = np.bincount((found >> np.uint64(20)).astype(np.int64) % ODD, minlength=ODD)
                odd.append(np.packbits((flips & 1).astype(np.uint8), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, content.view(np.int64)), pa.array(sizes), pa.array(odd, pa.binary())], names=["_row", "content", "f0", "n", "odd"])

    small_batches(texts.sparkSession)
    return texts.select("_row", "_text").mapInArrow(compute, "_row long, content long, f0 long, n int, odd binary")


def common_shingles(texts: DataFrame, size: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that several of about ``SAMPLE`` texts have, and in how many of ``total`` texts they may be.

    Only the order of prefixes and the cut of crowded cells depend on it, never which pairs are found.
    """
    share = min(1.0, SAMPLE / max(1, total))
    some = texts.filter(F.pmod(F.xxhash64("_text"), F.lit(1_000_000)) < share * 1_000_000).select("_text").distinct()
    counts = shingle_table(some.select(F.lit(0).cast("long").alias("key"), F.col("_text").alias("text")), size).select(F.explode("parts").alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    rows = counts.filter("n > 1").orderBy(F.desc("n"), "x").limit(COMMON).toArrow()  # at most COMMON rows, 16 bytes each
    found, often = (rows.column(c).to_numpy() for c in ("x", "n"))
    order = np.argsort(found)
    return found[order], np.ceil(often[order] / share).astype(np.int64)


def prefixes(texts: DataFrame, size: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``spot`` and ``key``: each text in the cells of its prefix, the shingles that come first in one order for all texts.

    Of ``n`` shingles a near copy misses at most n - ceil(similarity * n), so one more than that many always
    hold a shared one that is also in the other text's prefix, whatever the order. Rare shingles come first.
    A crowded shingle's texts are dealt into blocks, and each two blocks meet in a spot.
    """
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        known, counts = shared.value
        seen: set[int] = set()
        for batch in text_slices(batches, 4_000_000):
            spots, keys = [], []
            for text in batch.column(0).to_pylist():
                content, found = hashed(text, size)
                if content in seen or not len(found):
                    continue
                if len(seen) < 1_000_000:
                    seen.add(content)
                parts = found.view(np.int64)
                often = np.zeros(len(parts), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, parts), len(known) - 1)
                    often = np.where(known[at] == parts, counts[at], 0)
                first = np.lexsort((parts, often))[: len(parts) - int(np.ceil(similarity * len(parts) - 1e-9)) + 1]
                parts, blocks = parts[first], -(-often[first] // BLOCK)
                mine = [parts[blocks <= 1]]
                for part, n in zip(parts[blocks > 1].tolist(), blocks[blocks > 1].tolist(), strict=True):
                    own = xxh64_intdigest(content.to_bytes(8, "little")) % n
                    pairs = [(part & (2**64 - 1), min(own, k), max(own, k)) for k in range(n)]
                    mine.append(np.array([xxh64_intdigest(b"%d %d %d" % x) for x in pairs], np.uint64).view(np.int64))
                spots += mine
                keys.append(np.full(sum(map(len, mine)), content, np.uint64).view(np.int64))
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(spots or none)), pa.array(np.concatenate(keys or none))], names=["spot", "key"])

    small_batches(texts.sparkSession)
    return texts.select("_text").mapInArrow(place, "spot long, key long")


def whole_runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables that never cut a run of equal values of a sorted column."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        values = table.column(column).to_numpy()
        last = int(np.searchsorted(values, values[-1], side="left")) if len(values) else 0
        if last:
            yield table.slice(0, last)
        rest = table.slice(last)
    if rest is not None and rest.num_rows:
        yield rest


def shared_spots(placed: DataFrame) -> DataFrame:
    """``spot, key, m``: the rows of ``prefixes`` in spots of two texts or more, one spot for ``m`` that hold the same texts."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "spot"):
            spots, keys = (table.column(c).to_numpy() for c in ("spot", "key"))
            new = np.append(True, (spots[1:] != spots[:-1]) | (keys[1:] != keys[:-1]))
            spots, keys = spots[new], keys[new]
            same = spots[1:] == spots[:-1]
            many = np.append(same, False) | np.append(False, same)
            spots, keys = spots[many], keys[many]
            if len(spots):
                starts = np.flatnonzero(np.append(True, spots[1:] != spots[:-1]))
                sums = np.add.reduceat(mixed(keys.view(np.uint64), 1), starts)  # texts of equal sums only meet in vain
                spots = np.repeat(sums, np.diff(np.append(starts, len(spots)))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(spots), pa.array(keys)], names=["spot", "key"])

    small_batches(placed.sparkSession, 20_000)
    return placed.repartition("spot").sortWithinPartitions("spot", "key").mapInArrow(keep, "spot long, key long").groupBy("spot", "key").agg(F.count("*").alias("m"))


def candidates(members: DataFrame, similarity: float, thin: bool) -> DataFrame:
    """Pairs ``hub, key`` of ``members`` (``spot, key, root, n, odd``) that share a spot but no root and may be similar enough.

    Sets of that similarity differ in at most (1 - s) / (1 + s) of their sizes' sum. ``thin``: a spot leaves
    a spanning forest of its pairs, closest first.
    """
    ratio = (1 - similarity) / (1 + similarity)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "spot"):
            spots, keys, roots, sizes = (table.column(c).to_numpy() for c in ("spot", "key", "root", "n"))
            odd = np.frombuffer(b"".join(table.column("odd").to_pylist()), np.uint64).reshape(len(spots), -1)
            a, b, _ = forest(spots, np.zeros(len(spots), np.int8), keys, odd, sizes * ratio + 1e-6, roots, thin)
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["hub", "key"])

    small_batches(members.sparkSession, 20_000)
    ordered = members.repartition("spot").sortWithinPartitions("spot", "key").select("spot", "key", "root", "n", "odd")
    return ordered.mapInArrow(pair, "hub long, key long").distinct()


def possible(pairs: DataFrame, points: DataFrame, similarity: float) -> DataFrame:
    """The ``hub, key`` pairs whose sizes and sketches (``n, odd`` of ``points``) allow the similarity."""
    ratio = (1 - similarity) / (1 + similarity)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("x", "y"))
            most = (batch.column("a").to_numpy() + batch.column("b").to_numpy()) * ratio + 1e-6
            yield batch.select(["hub", "key"]).filter(pa.array(np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= most))

    small_batches(pairs.sparkSession, 20_000)
    hubs = points.select(F.col("key").alias("hub"), F.col("n").alias("a"), F.col("odd").alias("x"))
    own = points.select("key", F.col("n").alias("b"), F.col("odd").alias("y"))
    near = pairs.join(own, "key").join(hubs, "hub").filter(F.least("a", "b") >= similarity * F.greatest("a", "b") - 1e-9)
    return near.select("hub", "key", "a", "x", "b", "y").mapInArrow(choose, "hub long, key long")


def best_hubs(spots: DataFrame) -> DataFrame:
    """``hub, key``: each text with the one that it meets in most cells of those that come first in a cell."""
    hubs = spots.groupBy("spot").agg(F.min("key").alias("hub"))
    counted = spots.join(hubs, "spot").filter("hub != key").groupBy("key", "hub").agg(F.sum("m").alias("m"))
    return counted.groupBy("key").agg(F.max_by("hub", F.struct("m", -F.col("hub"))).alias("hub")).select("hub", "key")


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest id stays.

    Near copies share at least ``similarity`` (Jaccard) of their distinct shingles of ``size`` words; all such
    pairs are found, up to collisions of 64-bit hashes. The closest are linked first, by the fingerprints' grid
    and by the text that each meets in most cells of its prefix. Only cells of prefixes in which these links
    leave several groups are looked at again: once for a spanning forest of the groups' closest pairs, then
    for all pairs of groups still apart. Every link is checked on the full sets. Texts with the same words in
    the same order are copies; those without words (null, empty, blank) are copies of each other. Null ids
    yield to others.
    """
    rows = with_row_key(docs.select("*"), "_row")
    keyed = rows.select(F.col("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    whole = stage(sketches(keyed, size), "sketches")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("first")
    least = [F.min(c).alias(c) for c in ("f0", "n", "odd")]
    points = stage(whole.join(keyed.select("_row", "_id"), "_row").groupBy("content").agg(first, *least).withColumnRenamed("content", "key"), "points")
    common = common_shingles(keyed, size, points.count())
    spots = stage(shared_spots(prefixes(keyed, size, similarity, common)), "spots")

    def similar(pairs: DataFrame) -> DataFrame:
        ends = pairs.select("key").unionByName(pairs.select(F.col("hub").alias("key"))).distinct()
        wanted = stage(ends.join(points.select("key", F.col("first._row").alias("_row")), "key"), "ends")
        own = keyed.join(wanted, "_row", "left_semi").select("_row", F.col("_text").alias("text"))
        return stage(verified(pairs, stage(bodies(own, wanted), "bodies"), size, similarity), "links")

    sketch = points.select("key", "n", "odd")
    close = links(points.filter("n > 0").select("key", "f0"), 3).select(F.col("a").alias("hub"), F.col("b").alias("key"))
    met = close.unionByName(best_hubs(spots)).select(F.least("hub", "key").alias("hub"), F.greatest("hub", "key").alias("key")).distinct()
    tried = stage(possible(met, sketch, similarity), "pairs")
    groups = components(similar(tried))
    cells = spots.select(F.col("spot").alias("cell"), "key")
    for thin in (True, False):
        apart = mixed_rows(cells, groups.withColumnRenamed("node", "key"))
        ties = tied(apart) if thin else ties  # both passes look at much the same cells
        near = possible(candidates(meeting(apart, ties, sketch, BLOCK), similarity, thin), sketch, similarity)
        new = stage(near.join(tried, ["hub", "key"], "left_anti"), "pairs")
        tried = tried.unionByName(new)
        more = similar(new)
        if not more.isEmpty():
            groups = extended(groups, more)
    placed = points.select("key", "first").join(groups.withColumnRenamed("node", "key"), "key", "left")
    stay = placed.groupBy(F.coalesce("root", "key").alias("group")).agg(F.min("first").alias("first")).select(F.col("first._row").alias("_row"))
    return rows.join(stay, "_row", "left_semi").drop("_row")
