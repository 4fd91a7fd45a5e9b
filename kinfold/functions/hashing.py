"""Hash-derived keys: the only source of randomness in the library.

A draw is a function of its key parts, so it does not depend on row order,
partitioning or retries, and the same number can be computed in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "\x1f"


def _part(value) -> Column:
    column = value if isinstance(value, Column) else F.lit(value)
    return F.coalesce(column.cast("string"), F.lit(""))


def joined(*parts, sep: str = "|") -> Column:
    """Parts as text, NULL read as empty, joined by ``sep``."""
    return F.concat_ws(sep, *[_part(p) for p in parts])


def hash_key(*parts, sep: str = "|") -> Column:
    """SHA-256 hex of the joined parts: the order key for every hashed ranking."""
    return F.sha2(joined(*parts, sep=sep), 256)


def stable_token(*parts) -> Column:
    return hash_key(*parts, sep=UNIT)


def stable_id(*parts, prefix: str = "") -> Column:
    """``prefix`` followed by the first 20 hex digits of the token."""
    return F.concat(F.lit(prefix), F.substring(stable_token(*parts), 1, 20))


def leading_uint(hexed: Column) -> Column:
    """The first eight hex digits as a number in [0, 2^32)."""
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("bigint")


def stable_seed(*parts) -> Column:
    return leading_uint(stable_token(*parts)).bitwiseAND(F.lit(0x7FFFFFFF))


def draw(n: Column, *parts) -> Column:
    """A uniform index in [0, n) determined by ``parts``."""
    return F.pmod(leading_uint(hash_key(*parts)), n)


def row_fingerprint(columns: list[str]) -> Column:
    """Digest of one record with its fields in name order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def table_fingerprint(df: DataFrame, out: str = "fingerprint") -> DataFrame:
    """Order-free digest of a whole table.

    Row digests are folded to 256 bounded groups first (sums of 60-bit slices are
    order free), so no task ever holds the full list of row digests.
    """
    digests = df.select(row_fingerprint(df.columns).alias("d"))
    piece = lambda i: F.conv(F.substring("d", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")
    groups = digests.groupBy(F.substring("d", 61, 2).alias("g")).agg(
        F.count("*").alias("n"), *[F.sum(piece(i)).alias(f"s{i}") for i in range(5)]
    )
    text = F.concat_ws(":", "g", "n", *[f"s{i}" for i in range(5)])
    return groups.agg(
        F.sum("n").alias("n_rows"),
        F.sha2(F.concat_ws(";", F.array_sort(F.collect_list(text))), 256).alias(out),
    )
