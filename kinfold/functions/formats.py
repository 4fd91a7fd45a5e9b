"""Report formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def level_token(experiment: Column, level: Column) -> Column:
    """``p-0p25`` for a prevalence, ``r-2`` for an intensity."""
    prevalence = F.concat(F.lit("p-"), F.replace(F.format_string("%.2f", level.cast("double")), F.lit("."), F.lit("p")))
    return F.when(experiment == "prevalence", prevalence).otherwise(F.concat(F.lit("r-"), level.cast("int").cast("string")))


def reason_list(*rules: tuple[Column, str]) -> Column:
    """``a;b;c`` of the reasons that hold, in the order given."""
    return F.concat_ws(";", *[F.when(rule, F.lit(text)) for rule, text in rules])


def fixed(value: Column, digits: int = 3) -> Column:
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.format_string(f"%.{digits}f", value.cast("double"))).otherwise("not estimable")


def interval_text(estimate: Column, low: Column, high: Column, digits: int = 3) -> Column:
    return F.concat(
        fixed(estimate, digits), F.lit(" (95% CI, "), fixed(low, digits), F.lit(" to "), fixed(high, digits), F.lit(")")
    )


def round_numeric(df: DataFrame, digits: int = 4) -> DataFrame:
    real = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in real else F.col(c) for c in df.columns])


def flatten_structs(df: DataFrame, sep: str = "__") -> DataFrame:
    """Nested records to ``outer__inner`` columns."""
    out = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StructType):
            out += [F.col(field.name)[n].alias(f"{field.name}{sep}{n}") for n in field.dataType.names]
        else:
            out.append(F.col(field.name))
    return df.select(*out)
