"""Table schemas and the required-column gate shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


PEAKS = _fields(("row_id", T.StringType()), ("mass", T.DoubleType()), ("intensity", T.DoubleType()))

SPLITS = _fields(
    ("row_id", T.StringType()), ("cluster_id", T.StringType()), ("label", T.StringType()),
    ("parent", T.StringType()), ("seed", T.IntegerType()), ("design", T.StringType()),
    ("fold", T.IntegerType()), ("role", T.StringType()),
)

LEDGER = _fields(("path", T.StringType()), ("bytes", T.LongType()), ("sha256", T.StringType()))


class MissingColumns(KeyError):
    """Raised when an operator's input lacks a column it needs."""


class Violations(AssertionError):
    """Raised when an audit table that must be empty has rows."""


def require_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise MissingColumns(f"{what} lacks columns: {missing}")


def assert_empty(violations: DataFrame, what: str) -> None:
    """Raise with a few example rows when an audit found something; reads at most five rows."""
    found = violations.limit(5).collect()
    if found:
        raise Violations(f"{what}: {[row.asDict() for row in found]}")


def same_keys(left: str, right: str, keys: Iterable[str]):
    """Null-safe equality over key columns of two aliased frames (still an equi-join)."""
    from pyspark.sql import functions as F

    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return condition
