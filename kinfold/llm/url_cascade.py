"""URL rules by a cascade of Bloom filters, in DataFrame functions only.

A rule is a host and a path; it fits its host and all subdomains if the url's path starts
with the rule's. The keys that a url can match are its host's endings with as many labels
as some rule has, each with the beginnings of its path as long as some rule's path is.
Level 0 holds the listed keys, level 1 the corpus's other keys that level 0 lets through,
level 2 the listed ones that level 1 lets through, and so on until a level lets nothing
through. Over the keys of this corpus membership is exact, and judging a url needs no join.

Filters are literals in the plan: their size follows the rule list (``BITS`` bits a key),
never the corpus; beyond ``MAX_KEYS`` listed keys the build is refused.

Null urls and urls without ``://`` have an empty host and path and fit no rule. Of rules
that fit, the longest (host and path together) wins; a key listed as allow and block
blocks. A url that fits no rule gets the cascade's own verdict: not listed, so allow.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import stage

BITS, HASHES, MAX_KEYS, MAX_LEVELS = 12, 6, 200_000, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    words: list[int]
    seed: int

    def holds(self, key: Column) -> Column:
        size, words = len(self.words) * 64, F.lit(self.words)

        def bit(at: Column) -> Column:
            return F.call_function("shiftright", F.get(words, (at / 64).cast("int")), (at % 64).cast("int")).bitwiseAND(1) == 1

        return F.forall(positions(key, size, self.seed), bit)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: the optimizer doesn't copy it to every place of use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def positions(key: Column, bits: int, seed: int) -> Column:
    """Double hashing: the bits of a key in a filter of ``bits`` bits."""
    pair = F.struct(F.pmod(F.xxhash64(key, F.lit(2 * seed)), F.lit(bits)).alias("one"), F.pmod(F.xxhash64(key, F.lit(2 * seed + 1)), F.lit(bits)).alias("two"))
    return let(pair, lambda h: F.array(*[F.pmod(h["one"] + i * h["two"], F.lit(bits)) for i in range(HASHES)]))


def fit_level(keys: DataFrame, seed: int) -> Level | None:
    """A filter over the column ``key``; None if there is none."""
    count = keys.count()
    if not count:
        return None
    if count > MAX_KEYS * (1 if seed == 0 else 4):
        raise ValueError(f"{count} keys in level {seed}: the filters go into the plan, at most {MAX_KEYS} listed keys")
    size = max(1, -(-count * BITS // 64))
    at = keys.select(F.explode(positions(F.col("key"), size * 64, seed)).alias("at"))
    found = at.groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
    words = [0] * size
    for row in found.collect():  # one row a word of the filter
        words[row["word"]] = row["bits"]
    return Level(words, seed)


def listed(levels: list[Level], key: Column) -> Column:
    """Whether a key of the corpus is listed: the parity of the first level that doesn't hold it."""
    answer = F.lit(len(levels) % 2 == 1)
    for depth in reversed(range(len(levels))):
        answer = F.when(levels[depth].holds(key), answer).otherwise(F.lit(depth % 2 == 1))
    return answer


def fit_cascade(keys: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels that tell the listed ``key`` apart from every other ``key`` of ``universe``."""
    first = fit_level(keys.distinct(), 0)
    if first is None:
        return []
    marked = keys.select("key", F.lit(1).alias("own")).unionByName(
        universe.filter(F.col("key").isNotNull() & first.holds(F.col("key"))).select("key", F.lit(0).alias("own")))
    left = stage(marked.groupBy("key").agg(F.max("own").alias("own")), "cascade")  # listed keys and false positives only
    levels = [first]
    while len(levels) < MAX_LEVELS:
        left = left.filter(levels[-1].holds(F.col("key")))
        level = fit_level(left.filter(F.col("own") == (0 if len(levels) % 2 else 1)), len(levels))
        if level is None:
            return levels
        levels.append(level)
    raise ValueError("the cascade doesn't end")


def url_parts(url: Column) -> Column:
    """Host (A-Z lower-cased) and path of a url; both empty if null or without ``://``."""

    def parts(text: Column) -> Column:
        host = F.translate(F.regexp_extract(text, "://([^/?#]*)", 1), UPPER, LOWER)
        return F.struct(host.alias("host"), F.regexp_extract(text, "://[^/?#]*([^?#]*)", 1).alias("path"))

    return let(F.coalesce(url, F.lit("")), parts)


def candidates(parts: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The keys by which some rule could fit."""
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})

    def ends(p: Column) -> Column:
        found = F.array(*[F.when(p["labels"] >= k, F.substring_index(p["host"], ".", -k)) for k in labels])
        starts = F.array(*[F.when(F.length(p["path"]) >= n, F.substring(p["path"], 1, n)) for n in lengths])
        pairs = F.transform(found, lambda host: F.transform(starts, lambda path: F.concat(host, path)))
        return F.filter(F.flatten(pairs), lambda key: key.isNotNull())

    dots = F.length(parts["host"]) - F.length(F.replace(parts["host"], F.lit("."), F.lit("")))
    return let(F.struct(parts["host"].alias("host"), parts["path"].alias("path"), F.when(parts["host"] == "", 0).otherwise(dots + 1).alias("labels")), ends)


def longest(keys: Column, levels: list[Level]) -> Column:
    """The longest listed key with its length ``n``, or null."""
    return F.array_max(F.transform(F.filter(keys, lambda k: listed(levels, k)), lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", fallback: str = "allow") -> DataFrame:
    """Every row with ``host``, ``path``, ``rule`` and ``verdict`` in place of columns so named.

    ``rules``: (allow or block, host, path). No rules: every url gets ``fallback``.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    if not rules:
        cascades = {"allow": [], "block": []}
    else:
        spark = pages.sparkSession
        own = {v: spark.createDataFrame([(h + p,) for w, h, p in rules if w == v], "key string") for v in ("allow", "block")}
        universe = pages.select(F.explode(let(url_parts(F.col(url)), lambda p: candidates(p, rules))).alias("key"))
        cascades = {v: fit_cascade(keys, universe) for v, keys in own.items()}

    def verdict(parts: Column) -> Column:
        keys = candidates(parts, rules) if rules else F.array().cast("array<string>")
        best = let(keys, lambda k: F.struct(longest(k, cascades["allow"]).alias("allow"), longest(k, cascades["block"]).alias("block")))
        return let(best, lambda b: F.struct(parts["host"].alias("host"), parts["path"].alias("path"), *decide(b, fallback)))

    return pages.withColumn("_judged", let(url_parts(F.col(url)), verdict)).select(*kept, "_judged.*")


def decide(best: Column, fallback: str) -> list[Column]:
    blocked = best["block"].isNotNull() & (best["allow"].isNull() | (best["block"]["n"] >= best["allow"]["n"]))
    return [
        F.when(blocked, best["block"]["key"]).otherwise(best["allow"]["key"]).alias("rule"),
        F.when(blocked, F.lit("block")).when(best["allow"].isNotNull(), F.lit("allow")).otherwise(F.lit(fallback)).alias("verdict"),
    ]
