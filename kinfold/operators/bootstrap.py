"""Clustered, stratified and hierarchical bootstraps over sufficient statistics.

Rows are reduced to one record per cluster first; only those records are resampled. A
draw is a hash of (seed, replicate, stratum, slot), so replicates need no shared
generator and every arm of a comparison sees the same resample.

Draws meet the records by blocks of ``BLOCK`` clusters (``drawn_sums``): where they arise, draws are packed
to two bytes each, and a block's records are added up by its draw counts as a matrix product. What is shuffled and held
doesn't depend on how many records a cluster has, and no row is ever made for a draw and a record.

A hash a draw is what SQL can follow, and costs a microsecond. Where nothing has to (``by_block``), only the resample is named
by a hash, which seeds a generator for each of its blocks: draws arise where their block's records are and none is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions.hashing import draw, joined
from kinfold.operators.metrics import confusion, scores_from_confusion
from kinfold.operators.ranking import _null_safe_join, hash_rank
from kinfold.operators.runs import lists, starts_of
from kinfold.session import durable, spread

SLOT_CHUNK = 16_384
#: Cluster records (a few names and numbers each) up to this count are sent to every task.
SENT_RECORDS = 200_000
#: Clusters whose records meet their draws at once; an offset among them fits in two bytes.
BLOCK = 16_384
#: Draws that a task packs at once.
PACKED = 2_097_152
#: Numbers in the draw counts, and in the records, that are multiplied at once.
COUNTED = 4_194_304


def percentile_interval(draws: DataFrame, keys: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """Linear percentile interval over replicates (bounded by the replicate count)."""
    a = (1.0 - level) / 2.0
    return draws.groupBy(*keys).agg(
        F.percentile(value, F.lit(a)).alias("ci_low"), F.percentile(value, F.lit(1.0 - a)).alias("ci_high"),
        F.count(value).alias("replicates"),
    )


def number_clusters(clusters: DataFrame, stratum: Sequence[str], unit: str = "cluster_id") -> DataFrame:
    """Give each cluster of a stratum an index in [0, n) in hash order, and attach n."""
    token = F.sha2(F.col(unit).cast("string"), 256)
    ranked = hash_rank(clusters, stratum, token, [unit], "__r", "n_units")
    return ranked.withColumn("index", F.col("__r") - 1).drop("__r")


def meet_draws(draws: DataFrame, records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each draw with the records that it picked.

    Draws come from a generator, which the optimizer's size estimates leave out: they are never the side
    that is sent or built. Records are staged and counted; up to ``SENT_RECORDS`` are sent to every task, so
    that draws are summed where they arise, more are merged with the draws by key.
    """
    records = durable(records)
    small = records.count() <= SENT_RECORDS
    return _null_safe_join(draws, F.broadcast(records) if small else records.hint("merge"), keys)


def _number(columns: Sequence[str]):
    """One number for a few names; a null isn't any other value."""
    return F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns]) if columns else F.lit(0).cast("long")


def pack_draws(draws: DataFrame) -> DataFrame:
    """``place, block, run, body``: draws (``place, run, index``) as offsets of two bytes in their block of clusters."""

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        place, run, index = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("place", "run", "index"))
        block, offset = index // BLOCK, (index % BLOCK).astype("<u2")
        order = np.lexsort((run, block, place))
        place, block, run, offset = place[order], block[order], run[order], offset[order]
        new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (block[1:] != block[:-1]) | (run[1:] != run[:-1])))
        ends = pa.array(np.append(new, len(run)).astype(np.int32) * 2)
        body = pa.BinaryArray.from_buffers(pa.binary(), len(new), [None, ends.buffers()[1], pa.py_buffer(offset.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(place[new]), pa.array(block[new]), pa.array(run[new]), body], names=["place", "block", "run", "body"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return draws.mapInArrow(pack, "place long, block long, run long, body binary")


def pack_slots(slots: DataFrame) -> DataFrame:
    """``place, block, run, body`` of the draws of slots ``first`` to ``last``: ``draw(n, *parts, slot)``, where ``head`` joins the parts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[tuple, list[bytes]] = {}
        sha = hashlib.sha256
        for batch in batches:
            place, run, head, first, last, n = (batch.column(c).to_pylist() for c in ("place", "run", "head", "first", "last", "n"))
            out, held = [], 0
            for i in range(batch.num_rows):
                span = first[i], last[i]
                if span not in texts:
                    if len(texts) > 16:
                        texts.clear()
                    texts[span] = [b"|%d" % k for k in range(first[i], last[i] + 1)]
                start = head[i].encode()
                digits = b"".join([sha(start + text).digest()[:4] for text in texts[span]])
                index = np.frombuffer(digits, ">u4").astype(np.int64) % n[i]
                if n[i] > BLOCK:
                    index.sort()
                block = index // BLOCK
                cuts = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(index)).tolist()
                offsets = (index % BLOCK).astype("<u2")
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    out.append((place[i], int(block[a]), run[i], offsets[a:b].tobytes()))
                held += len(index)
                if held >= PACKED or i == batch.num_rows - 1:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["place", "block", "run", "body"])
                    out, held = [], 0

    return slots.mapInArrow(pack, "place long, block long, run long, body binary")


def block_draws(name: bytes, n: int, block: int, span: int = BLOCK) -> np.ndarray:
    """Offsets of the draws of a resample of ``n`` out of ``n`` units that fall into a block of ``span`` units.

    How many fall into each block is one multinomial draw of the whole resample, the same wherever it is made; a block's own are uniform.
    """
    generator = lambda *parts: np.random.Generator(np.random.Philox(key=int.from_bytes(hashlib.sha256(b"|".join([name, *parts])).digest()[:16])))
    sizes = np.full(-(-n // span), span)
    sizes[-1] = n - span * (len(sizes) - 1)
    many = int(generator().multinomial(n, sizes / n)[block]) if len(sizes) > 1 else n
    return generator(b"%d" % block).integers(0, int(sizes[block]), many, dtype="<u2")


def seeds_of(rows: DataFrame, size: str, parts: Sequence, place: Sequence[str], run) -> DataFrame:
    """``place, block, run, body`` of every row's resample: its name and size for each block, for draws to be made there."""
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(size) - 1) / BLOCK))).alias("block")
    name = F.concat_ws("|", F.col(size).cast("long").cast("string"), joined(*parts)).cast("binary").alias("body")
    return rows.select(_number(place).alias("place"), blocks, run.cast("long").alias("run"), name)


def slots_of(rows: DataFrame, size: str, parts: Sequence, place: Sequence[str], run) -> DataFrame:
    """Slots of every row's resample, ``size`` draws of as many units each, cut so that no task's piece grows with them."""
    chunks = rows.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col(size) - 1) / SLOT_CHUNK))))
    first = F.col("__chunk") * SLOT_CHUNK
    table = chunks.select(
        _number(place).alias("place"), run.cast("long").alias("run"), joined(*parts).alias("head"), first.cast("long").alias("first"),
        (F.least(F.col(size), first + SLOT_CHUNK) - 1).cast("long").alias("last"), F.col(size).cast("long").alias("n"),
    )
    return table.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "place", "run", "first")


def drawn_sums(draws: DataFrame, records: DataFrame, place: Sequence[str], run: str, group: Sequence[str], amounts: Sequence[str]) -> DataFrame:
    """``(place, run, group, sums of amounts)`` over the records of all draws, as a join on (place, ``index``) would sum them.

    ``draws``: place, ``index`` and a whole number ``run`` that names the resample; ``records``: place, ``index``, group and
    amounts without nulls.
    """
    packed = pack_draws(draws.select(_number(place).alias("place"), F.col(run).cast("long").alias("run"), F.col("index").cast("long").alias("index")))
    return packed_sums(packed, records, place, run, group, amounts)


def packed_sums(packed: DataFrame, records: DataFrame, place: Sequence[str], run: str, group: Sequence[str], amounts: Sequence[str],
                by_block: bool = False, drawn: str | None = None) -> DataFrame:
    """``drawn_sums`` of packed draws. Names of a place or group are told apart by 64-bit hashes: there are as many as classes and cells.

    ``by_block``: ``packed`` is of ``seeds_of``; ``drawn`` names a column for how many records were drawn.
    """
    place, group, amounts = list(place), list(group), list(amounts)
    kinds = dict(records.dtypes)
    numbers = F.array(*[F.col(a).cast("double") for a in amounts])
    staged = durable(records.select(_number(place).alias("place"), _number(group).alias("group"), F.col("index").cast("long").alias("index"), numbers.alias("amounts"), *place, *group))
    names = staged.select("place", *place).distinct()
    groups = staged.select("place", "group", *group).distinct()
    empty = lambda kind: F.lit(None).cast(kind)
    spot = [F.floor(F.col("index") / BLOCK).cast("long").alias("block")]
    heads = staged.select("place", *spot, F.lit(0).alias("role"), empty("long").alias("run"), empty("binary").alias("body"), (F.col("index") % BLOCK).cast("int").alias("offset"), "group", "amounts")
    tails = packed.select("place", "block", F.lit(1).alias("role"), "run", "body", empty("int").alias("offset"), empty("long").alias("group"), empty("array<double>").alias("amounts"))
    count = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = heads.unionByName(tails).repartition(4 * count, "place", "block").sortWithinPartitions("place", "block", "role", "run")
    width, span = len(amounts) + 1, BLOCK  # the last amount counts records

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts, records, held, n = None, [], None, [], 0

        def tables(size: int, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Groups, and a line of amounts a cluster for them, a few groups at a time."""
            offset, back, values = records[2:]
            step = max(1, COUNTED // (size * width))
            for a in range(0, len(at), step):
                some, mine = at[a : a + step], (back >= a) & (back < a + step)
                table = np.zeros((size, len(some), width))
                np.add.at(table, (offset[mine], back[mine] - a), values[mine])
                yield some, table.reshape(size, -1)

        def close() -> Iterator[pa.RecordBatch]:
            """Sums over the held draws."""
            nonlocal held, n
            if held and records is not None:
                size, at = records[:2]
                runs = np.concatenate([r for r, _, _ in held])
                sizes = np.concatenate([z for _, z, _ in held])
                offsets = np.concatenate([o for _, _, o in held]).astype(np.int64)
                some, back = np.unique(runs, return_inverse=True)
                step = max(1, min(4096, COUNTED // size))
                row = np.repeat(back.reshape(-1), sizes)
                order = np.argsort(row, kind="stable") if (np.diff(back.reshape(-1)) < 0).any() else slice(None)
                row, offsets = row[order], offsets[order]
                found = offsets < size  # those of clusters with records
                row, offsets = row[found], offsets[found]
                for which_groups, table in tables(size, at):
                    for a in range(0, len(some), step):
                        b = min(len(some), a + step)
                        lo, hi = np.searchsorted(row, [a, b])
                        counts = np.bincount((row[lo:hi] - a) * size + offsets[lo:hi], minlength=(b - a) * size).reshape(b - a, -1).astype(float)
                        sums = (counts @ table).reshape(b - a, len(which_groups), width)
                        which, column = np.nonzero(sums[:, :, -1])
                        columns = [np.full(len(which), own[0]), some[a:b][which], which_groups[column]]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists(sums[which, column])], names=["place", "run", "group", "sums"])
            held, n = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = np.append(starts_of(batch, ["place", "block", "role"]), batch.num_rows)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = batch.slice(a, b - a)
                here = (part.column("place")[0].as_py(), part.column("block")[0].as_py())
                if here != own:
                    yield from close()
                    own, parts, records = here, [], None
                if part.column("role")[0].as_py() == 0:
                    values = part.column("amounts").flatten().to_numpy().reshape(b - a, -1)
                    parts.append((part.column("offset").to_numpy(), part.column("group").to_numpy(), values))
                    continue
                if parts:
                    offset, which, values = (np.concatenate(c) for c in zip(*parts, strict=True))
                    at, back = np.unique(which, return_inverse=True)
                    records, parts = (int(offset.max()) + 1, at, offset, back.reshape(-1), np.column_stack([values, np.ones(len(offset))])), []
                body, runs = part.column("body"), part.column("run").to_numpy()
                if by_block:
                    for at, text in enumerate(body.to_pylist()):
                        size, name = text.split(b"|", 1)
                        offsets = block_draws(name, int(size), own[1], span)
                        held.append((runs[at : at + 1], [len(offsets)], offsets))
                        n += len(offsets)
                        if n >= COUNTED:
                            yield from close()
                    continue
                ends = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1]
                offsets = np.frombuffer(body.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<u2")
                held.append((runs, np.diff(ends) // 2, offsets))
                n += len(offsets)
                if n >= COUNTED:
                    yield from close()
        yield from close()

    partial = dealt.mapInArrow(add, "place long, run long, group long, sums array<double>")
    sums = partial.groupBy("place", "run", "group").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"__{i}") for i in range(width)])
    back = [F.col(f"__{i}").cast("double" if kinds[a] in ("double", "float") else "long").alias(a) for i, a in enumerate(amounts)]
    back += [F.col(f"__{width - 1}").cast("long").alias(drawn)] if drawn else []
    # classes and cells: a few names each
    named = sums.join(F.broadcast(groups), ["place", "group"]).join(F.broadcast(names), "place")
    return named.select(*place, F.col("run").alias(run), *group, *back)


def resample(numbered: DataFrame, keys: Sequence[str], stratum: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Packed draws by replicate: as many per stratum as it has clusters. One row per stratum and replicate is all that is made for them."""
    place = [*keys, *stratum]
    sizes = numbered.select(*place, "n_units").distinct()
    each = spread(sizes, *place).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    parts = [F.lit(seed), F.col("replicate"), *[F.col(c) for c in place]]
    return pack_slots(slots_of(each, "n_units", parts, place, F.col("replicate")))


def clustered_rate(df: DataFrame, value: str, replicates: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """Replicates of a pooled mean with clusters resampled: ``(keys, replicate, value)``."""
    keys = list(keys)
    x = F.col(value).cast("double")
    stats = df.groupBy(*keys, "cluster_id").agg(F.sum(x).alias("__s"), F.count(x).alias("__n"))
    numbered = number_clusters(stats, keys)
    draws = resample(numbered, keys, [], replicates, seed)
    records = numbered.select(*keys, "index", F.coalesce("__s", F.lit(0.0)).alias("__s"), "__n")
    sums = packed_sums(draws, records, keys, "replicate", [], ["__s", "__n"]).withColumn("replicate", F.col("replicate").cast("int"))
    return sums.select(*keys, "replicate", F.when(F.col("__n") > 0, F.col("__s") / F.col("__n")).alias(value))


def paired_confusion(df: DataFrame, keys: Sequence[str], arms: dict[str, str], truth: str = "label") -> DataFrame:
    """Per cluster: counts by (true, predicted) for each arm, arms as columns ``n_<arm>``."""
    long = df.select(
        *keys, "cluster_id", F.col(truth).alias("true_label"),
        F.explode(F.array(*[
            F.struct(F.lit(arm).alias("arm"), F.col(column).alias("predicted_label")) for arm, column in arms.items()
        ])).alias("a"),
    )
    one = lambda arm: F.sum(F.when(F.col("a.arm") == arm, 1).otherwise(0)).alias(f"n_{arm}")
    return long.groupBy(
        *keys, "cluster_id", "true_label", F.col("a.predicted_label").alias("predicted_label")
    ).agg(*[one(arm) for arm in arms])


def paired_scores(df: DataFrame, keys: Sequence[str], arms: dict[str, str], truth: str = "label") -> DataFrame:
    """Point estimates: macro-F1 and accuracy of each arm and the difference (first minus second)."""
    counts = paired_confusion(df, keys, arms, truth)
    names = list(arms)
    merged = counts.groupBy(*keys, "true_label", "predicted_label").agg(*[F.sum(f"n_{a}").alias(f"n_{a}") for a in names])
    return _differences(scores_from_confusion(merged, keys, [f"n_{a}" for a in names]), keys, names)


def _differences(scores: DataFrame, keys: Sequence[str], names: list[str]) -> DataFrame:
    a, b = names
    columns = []
    for metric in ("macro_f1", "accuracy"):
        left, right = F.col(f"{metric}_n_{a}"), F.col(f"{metric}_n_{b}")
        columns += [left.alias(f"{metric}_{a}"), right.alias(f"{metric}_{b}"), (left - right).alias(f"{metric}_delta")]
    return scores.select(*keys, *columns)


def paired_f1(df: DataFrame, arms: dict[str, str], replicates: int, seed: int, keys: Sequence[str] = (),
              stratified: bool = True, within: Sequence[str] = (), truth: str = "label") -> DataFrame:
    """Paired cluster bootstrap of macro-F1 and accuracy.

    ``keys`` resample separately; ``within`` (such as the seed) shares one resample and is
    averaged over afterwards; ``stratified`` resamples clusters inside each true label.
    """
    keys, within, names = list(keys), list(within), list(arms)
    amounts = [f"n_{a}" for a in names]
    stats = paired_confusion(df, [*keys, *within], arms, truth)
    stratum = ["true_label"] if stratified else []
    numbered = number_clusters(stats.select(*keys, *stratum, "cluster_id").distinct(), [*keys, *stratum])
    draws = resample(numbered, keys, stratum, replicates, seed)
    indexed = _null_safe_join(stats, numbered.drop("n_units"), [*keys, *stratum, "cluster_id"]).drop("cluster_id")
    rest = [*within, *([] if stratified else ["true_label"]), "predicted_label"]
    drawn = packed_sums(draws, indexed, [*keys, *stratum], "replicate", rest, amounts).withColumn("replicate", F.col("replicate").cast("int"))
    counts = drawn.groupBy(*keys, "replicate", *within, "true_label", "predicted_label").agg(
        *[F.sum(a).alias(a) for a in amounts]
    )
    per = _differences(scores_from_confusion(counts, [*keys, "replicate", *within], amounts), [*keys, "replicate", *within], names)
    if not within:
        return per
    values = [c for c in per.columns if c not in (*keys, "replicate", *within)]
    return per.groupBy(*keys, "replicate").agg(*[F.avg(v).alias(v) for v in values])


def instance_means(df: DataFrame, keys: Sequence[str], instance: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Cluster mean of each value within each model instance; NULL stays missing."""
    return df.groupBy(*keys, "label", "cluster_id", *instance).agg(
        *[F.avg(F.col(v).cast("double")).alias(v) for v in values]
    )


def hierarchical_point(df: DataFrame, keys: Sequence[str], instance: Sequence[str], values: Sequence[str],
                       overall: bool = False) -> DataFrame:
    """Point estimate: label-macro (or overall cluster) mean within instance, then over instances."""
    means = instance_means(df, keys, instance, values)
    if not overall:
        means = means.groupBy(*keys, *instance, "label").agg(*[F.avg(v).alias(v) for v in values])
    per = means.groupBy(*keys, *instance).agg(*[F.avg(v).alias(v) for v in values])
    return per.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def hierarchical(df: DataFrame, values: Sequence[str], replicates: int, seed: int, keys: Sequence[str] = (),
                 instance: Sequence[str] = ("seed", "fold"), overall: bool = False, by_block: bool = False) -> DataFrame:
    """Label occurrences are drawn, then clusters independently inside each occurrence.

    A label drawn twice gets two independent cluster draws (the occurrence number is
    part of the hash). A cluster without observations in an instance stays missing there.
    ``overall`` gives every drawn cluster one vote instead of every occurrence. ``by_block`` draws
    clusters from a generator that the resample's hash seeds, not by a hash each.
    """
    keys = list(keys)
    stats = durable(instance_means(df, keys, instance, values))
    clusters = stats.select(*keys, "label", "cluster_id").distinct()
    numbered = number_clusters(clusters, [*keys, "label"])
    # one row per label: as many as a model has classes, the bound of every per-run label window
    labels = number_clusters(numbered.select(*keys, "label", "n_units").distinct().withColumnRenamed("n_units", "__size"),
                             keys, "label")
    occurrences = labels.select(*keys, F.col("index").alias("occurrence"), "n_units").withColumn(
        "replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    )
    pick = draw(F.col("n_units"), F.lit(seed), F.col("replicate"), *[F.col(k) for k in keys], F.col("occurrence"))
    occurrences = occurrences.select(*keys, "replicate", "occurrence", pick.alias("index"))
    drawn = meet_draws(occurrences, labels.select(*keys, "index", "label", "__size"), [*keys, "index"])
    # replicate and occurrence as one number
    run = F.col("occurrence") * replicates + F.col("replicate")
    parts = [F.lit(seed), F.col("replicate"), *[F.col(k) for k in keys], F.col("occurrence")]
    picks = (seeds_of(drawn, "__size", parts, [*keys, "label"], run) if by_block
             else pack_slots(slots_of(drawn, "__size", parts, [*keys, "label"], run)))
    indexed = _null_safe_join(stats, numbered.drop("n_units"), [*keys, "label", "cluster_id"]).drop("cluster_id")
    missing = stats.agg(*[F.max(F.col(v).isNull().cast("int")).alias(v) for v in values]).first()
    gaps = [v for v in values if missing[v]]  # others are there in every record drawn
    present = [F.col(v).isNotNull().cast("long").alias(f"__n_{v}") for v in gaps]
    records = indexed.select(*keys, "label", "index", *instance, *[F.coalesce(F.col(v), F.lit(0.0)).alias(v) for v in values], *present)
    sums = packed_sums(picks, records, [*keys, "label"], "__run", instance, [*values, *[f"__n_{v}" for v in gaps]], by_block, "__drawn")
    sampled = sums.withColumn("replicate", (F.col("__run") % replicates).cast("int"))
    sampled = sampled.withColumns({f"__n_{v}": F.col("__drawn") for v in values if v not in gaps})
    mean = lambda v, s, n: F.when(n > 0, s / n).alias(v)
    if overall:
        per = sampled.groupBy(*keys, "replicate", *instance).agg(*[mean(v, F.sum(v), F.sum(f"__n_{v}")) for v in values])
    else:
        sampled = sampled.select(*keys, "replicate", *instance, *[mean(v, F.col(v), F.col(f"__n_{v}")) for v in values])
        per = sampled.groupBy(*keys, "replicate", *instance).agg(*[F.avg(v).alias(v) for v in values])
    return per.groupBy(*keys, "replicate").agg(*[F.avg(v).alias(v) for v in values])


def summarise(draws: DataFrame, point: DataFrame, keys: Sequence[str], values: Sequence[str], level: float = 0.95) -> DataFrame:
    """Long table: metric, estimate, ci_low, ci_high, replicates."""
    keys = list(keys)
    long = draws.select(*keys, *values).unpivot(keys, list(values), "metric", "value") if keys else draws.select(
        *values).unpivot([], list(values), "metric", "value")
    estimate = point.select(*keys, *values).unpivot(keys, list(values), "metric", "estimate")
    return _null_safe_join(estimate, percentile_interval(long, [*keys, "metric"], "value", level), [*keys, "metric"])


def one_sided_p(draws: DataFrame, keys: Sequence[str], value: str, null: float = 0.0) -> DataFrame:
    """(1 + replicates at or below the null) / (replicates + 1), at most one."""
    below = F.sum((F.col(value) <= F.lit(null)).cast("long"))
    return draws.groupBy(*keys).agg(F.least((below + 1) / (F.count(value) + 1), F.lit(1.0)).alias("p_value"))


def holm(endpoints: DataFrame, p: str = "p_value", order: str = "endpoint", out: str = "holm_adjusted_p") -> DataFrame:
    """Step-down adjusted p over a handful of endpoints; NULL p-values are left out."""
    tested = endpoints.filter(F.col(p).isNotNull())
    everything = W.partitionBy(F.lit(1)).orderBy(F.col(p), F.col(order))
    m = F.count("*").over(W.partitionBy(F.lit(1)))
    step = F.least(F.lit(1.0), (m - F.row_number().over(everything) + 1) * F.col(p))
    adjusted = tested.withColumn("__step", step).withColumn(
        out, F.max("__step").over(everything.rowsBetween(W.unboundedPreceding, 0))
    ).select(order, out)
    return endpoints.join(adjusted, order, "left")
