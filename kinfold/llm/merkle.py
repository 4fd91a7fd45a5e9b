"""Merkle manifest of a table: nested-struct rollup of rank digits, proofs from one transform and explode.

Leaves of a source are ranked, and a rank's base-3 digits are grouped away one after another within
blocks of 81 ranks: a group of up to three nodes becomes one struct with their hash and the nodes as
its children. A block is thus one row with a small tree in it, all its groupings share one shuffle,
and the blocks' hashes are the leaves of the tier above, until one block a source is left. The
sources' own hashes go through the same tiers once more. Proofs come down again: a block's row meets
the path above it in a grouping, and a transform over its tree emits a path for every node below.

Hashes are lowercase hex SHA-256 of their inputs put together. A leaf hashes its fields: ``-`` for a
null, else length in UTF-8 bytes, a colon and the value. A lone node isn't hashed again, but a lone
last one in a longer row is. Null sources form the first source, null ids come first in theirs. Rows of
equal source and id are ordered by their leaf; repeated rows are kept, each with its own proof. Texts
of any length are hashed whole, and null or empty ones hash as such. An empty table gives no rows.
Columns other than the five fields aren't read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import stage, with_row_key
from kinfold.llm.ordering import ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, LEVELS = 3, 4
STEPS = "array<struct<left:string,right:string>>"


def written(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(written, values)), 256)


def joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda node: node["digest"]), "")


def roll_up(nodes: DataFrame) -> DataFrame:
    """Blocks ``key, block, digest, alone, kids`` of ``nodes`` (``key, rank, digest, load``): the tier above.

    The ranks of a key have no gaps, so the first group of a key has one child only if no other node is left
    in that level: such a child is ``alone`` and goes up as it is.
    """
    digits = [f"d{k}" for k in range(LEVELS)]
    cut = [F.floor(F.col("rank") / FAN**k).cast("long") % FAN for k in range(LEVELS)]
    dealt = nodes.select(
        "key", F.floor(F.col("rank") / FAN**LEVELS).cast("long").alias("block"), *[c.cast("int").alias(d) for c, d in zip(cut, digits, strict=True)], "digest", "load"
    ).repartition("key", "block")
    fields = ["digest", "load"]
    for level, digit in enumerate(digits):
        above = digits[level + 1 :]
        grouped = dealt.groupBy("key", "block", *above).agg(F.sort_array(F.collect_list(F.struct(digit, *fields))).alias("kids"))
        first = F.col("block") == 0
        for name in above:
            first = first & (F.col(name) == 0)
        marked = grouped.withColumn("alone", first & (F.size("kids") == 1))
        fields = ["digest", "alone", "kids"]
        dealt = marked.withColumn("digest", F.when(F.col("alone"), F.col("kids")[0]["digest"]).otherwise(F.sha2(joined(F.col("kids")), 256)))
    return dealt.select("key", "block", *fields)


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """Written tiers of blocks, lowest first, up to the one in which every key has one block."""
    found = []
    while True:
        found.append(stage(roll_up(nodes), "tier"))
        last = found[-1].agg(F.max("block")).first()[0]
        if not last:
            return found
        nodes = found[-1].select("key", F.col("block").alias("rank"), "digest", F.struct("block").alias("load"))


def emitted(kids: Column, alone: Column, level: int, above: list[Column]) -> Column:
    """Every node below with its path: digests left and right of it, level by level upwards."""

    def step(i: Column) -> Column:
        beside = F.struct(joined(F.slice(kids, F.lit(1), i)).alias("left"), joined(F.slice(kids, i + 2, F.lit(FAN))).alias("right"))
        return F.when(alone, F.array().cast(STEPS)).otherwise(F.array(beside))

    if level == 0:
        return F.transform(kids, lambda node, i: F.struct(node["digest"].alias("digest"), node["load"].alias("load"), F.concat(step(i), *above).alias("path")))
    return F.flatten(F.transform(kids, lambda node, i: emitted(node["kids"], node["alone"], level - 1, [step(i), *above])))


def come_down(found: list[DataFrame], start: DataFrame) -> DataFrame:
    """Nodes ``key, digest, load, path, carry`` under the last of ``found``; ``start``: ``key, block, path, carry`` of its blocks."""
    for tier, table in reversed(list(enumerate(found))):
        kinds, upper = dict(table.dtypes), dict(start.dtypes)
        trees = table.select("key", "block", "alone", "kids", F.lit(None).cast(STEPS).alias("path"), F.lit(None).cast(upper["carry"]).alias("carry"))
        paths = start.select("key", "block", F.lit(None).cast("boolean").alias("alone"), F.lit(None).cast(kinds["kids"]).alias("kids"), "path", "carry")
        met = trees.unionByName(paths).groupBy("key", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("alone", "kids", "path", "carry")])
        nodes = met.select("key", "carry", F.explode(emitted(F.col("kids"), F.col("alone"), LEVELS - 1, [F.col("path")])).alias("node"))
        below = nodes.select("key", F.col("node.digest").alias("digest"), F.col("node.load").alias("load"), F.col("node.path").alias("path"), "carry")
        if tier == 0:
            return below
        start = below.select("key", F.col("load.block").alias("block"), "path", "carry")
    raise ValueError("no tiers")


def folded(path: Column, start: Column) -> Column:
    """The root that a path leads to from a leaf."""
    return F.aggregate(path, start, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id, source, leaf, subroot, root, path, proof_sha256, folded_root, verified``, one row for each row of ``docs``.

    ``tampered`` is what the text is when it's checked (the text itself if not given); the other columns are of
    the original table. ``path`` lists the digests beside a leaf and its ancestors, lowest level first.
    """
    rows = with_row_key(docs.select(*FIELDS))
    own = [F.col(c) for c in FIELDS]
    seen = F.col("text") if tampered is None else tampered
    leaves = stage(rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("key"), leaf(*own).alias("digest"),
        leaf(*own[:-1], seen).alias("checked"), F.col("_row"),
    ), "leaves")
    placed = ranked(leaves, [F.asc_nulls_first("key"), F.asc_nulls_first("doc_id"), F.asc("digest"), F.asc("_row")], "key")
    found = tiers(placed.select("key", "rank", "digest", F.struct("doc_id", "checked").alias("load")))
    subroots = ranked(found[-1].select("key", "digest"), [F.asc_nulls_first("key")])
    top = tiers(subroots.select(F.lit(0).alias("key"), "rank", "digest", F.struct(F.col("key").alias("source")).alias("load")))
    head = top[-1].first()  # the single block that is left
    root = F.lit(head["digest"] if head else None).cast("string")
    none = F.array().cast(STEPS)
    sources = come_down(top, top[-1].select("key", "block", none.alias("path"), F.lit(None).cast("string").alias("carry")))
    starts = stage(sources.select(F.col("load.source").alias("key"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("carry")), "starts")
    below = come_down(found, starts)
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    out = below.select(
        F.col("load.doc_id").alias("doc_id"), F.col("key").alias("source"), F.col("digest").alias("leaf"), F.col("carry").alias("subroot"), root.alias("root"), "path",
        F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("path"), F.col("load.checked")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
