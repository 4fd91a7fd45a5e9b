"""Label text: normalisation, identity strings, name classes and path pieces."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: label name patterns
SP_PATTERN = r"^[A-Z][A-Za-z-]+ sp\.$"
BINOMIAL_PATTERN = r"^[A-Z][A-Za-z-]+ [a-z][A-Za-z-]+$"


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.StringType())
def _nfkc_casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


def _squeeze(column: Column) -> Column:
    # fixed values: the characters Unicode counts as whitespace
    blanks = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    return F.trim(F.regexp_replace(column, blanks, " "))


def normalize_ascii(column: Column) -> Column:
    """Separators to blanks, whitespace collapsed; NULL becomes the empty string."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    return _squeeze(F.regexp_replace(text, r"[_/\\]+", " "))


def normalize_label(column: Column) -> Column:
    """Compatibility-normalise (NFKC), then unify separators and blanks.

    The normal form has no built-in in Spark; ASCII text is its own normal form, so
    a table known to be ASCII should call :func:`normalize_ascii` and skip Python.
    """
    return normalize_ascii(_nfkc(F.coalesce(column.cast("string"), F.lit(""))))


def fold_identity(column: Column) -> Column:
    """Case-folded comparison form used by published peak lists."""
    folded = _nfkc_casefold(F.coalesce(column.cast("string"), F.lit("")))
    return _squeeze(F.regexp_replace(folded, r"\|", " "))


def fold_case(column: Column) -> Column:
    """Compatibility-normalised and case-folded."""
    return _nfkc_casefold(column.cast("string"))


def fold_label(column: Column) -> Column:
    """Comparison form of labels and paths: compatibility-normalised, case-folded, separators as blanks."""
    return normalize_ascii(_nfkc_casefold(F.coalesce(column.cast("string"), F.lit(""))))


def first_token(column: Column) -> Column:
    trimmed = F.trim(column)
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"\s+")[0])


def identity_string(*parts: Column) -> Column:
    """``a|b|c`` from already normalised parts, empty text for a missing one."""
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])


def clean_identity(column: Column) -> Column:
    trimmed = F.trim(column.cast("string"))
    return F.when(F.length(trimmed) > 0, trimmed)


def is_explicit_binomial(column: Column) -> Column:
    """Exactly two words, the second of which is not ``sp.``."""
    words = F.split(F.trim(column), r"\s+")
    return (F.size(words) == 2) & (F.lower(F.get(words, F.lit(1))) != "sp.")


def label_type(column: Column) -> Column:
    text = F.trim(column)
    return (
        F.when(text.rlike(SP_PATTERN), "sp_unspecified")
        .when(text.rlike(BINOMIAL_PATTERN), "explicit_binomial")
        .otherwise("other")
    )


def forward_slashes(column: Column) -> Column:
    return F.translate(column, "\\", "/")


def source_key(directory: Column) -> Column:
    return F.concat(forward_slashes(directory), F.lit("/fid"))


def path_part(column: Column, index: int) -> Column:
    return F.get(F.split(forward_slashes(column), "/"), F.lit(index))


def group_path(directory: Column, measurement: Column) -> Column:
    """Cut the path at the measurement folder; without one, drop the last four parts."""
    parts = F.split(forward_slashes(directory), "/")
    at = F.array_position(parts, F.coalesce(measurement, F.lit(""))).cast("int")
    kept = (
        F.when(at > 0, F.slice(parts, F.lit(1), at - 1))
        .when(F.size(parts) > 4, F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 4, F.lit(0))))
        .otherwise(parts)
    )
    return F.array_join(kept, "/")


def acquisition_field(text: Column, name: str) -> Column:
    """Value of a ``##$NAME=`` line, angle brackets removed."""
    line = F.regexp_extract(text, rf"(?m)^##\${name}=\s*([^\r\n]*)", 1)
    inner = F.regexp_extract(line, r"^<([^>]*)>", 1)
    present = text.rlike(rf"(?m)^##\${name}=")
    return F.when(present, F.trim(F.when(line.startswith("<"), inner).otherwise(line)))


def tag_map(text: Column) -> Column:
    """``#KEY=value#KEY2=value2`` as a map; a repeated key keeps its last value."""
    pattern = F.lit(r"#([A-Za-z0-9_]+)=([^#]*)")
    keys = F.regexp_extract_all(text, pattern, F.lit(1))
    values = F.transform(F.regexp_extract_all(text, pattern, F.lit(2)), lambda v: F.trim(v))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(
        pairs,
        lambda p, i: ~F.array_contains(
            F.when(i + 1 >= F.size(keys), F.array().cast("array<string>")).otherwise(
                F.slice(keys, i + 2, F.size(keys))
            ),
            p["k"],
        ),
    )
    return F.map_from_entries(last)


def taxonomy_number(uie: Column, uid: Column) -> Column:
    """The extended id if it is not blank, else the plain id; NULL when not a number."""
    chosen = F.when(uie.isNull() | (uie != ""), uie).otherwise(uid)
    return chosen.try_cast("double").try_cast("bigint")


def file_category(path: Column) -> Column:
    """Category of an inventory file by its name."""
    name = F.lower(path)
    return (
        F.when(name.endswith(".xlsx") & name.contains("taxonomy"), "taxonomy")
        .when(name.endswith("metadata.pdf"), "metadata")
        .when(name.endswith(".pkf"), "pkf")
        .when(name.endswith(".zip"), "raw")
        .when(name.endswith(".btmsp"), "btmsp")
        .otherwise("other")
    )
