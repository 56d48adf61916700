"""Column functions with the null and zero rules that panel features need."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN stands for a missing value in imported data; every statistic here skips nulls only."""
    kinds = dict(df.dtypes)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def finite(x: Column) -> Column:
    """Null for NaN and both infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(top: Column, below: Column) -> Column:
    """Null where the denominator is zero."""
    return top / F.nullif(below, F.lit(0.0))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Null stays null; least and greatest would skip it."""
    y = x
    if low is not None:
        y = F.greatest(y, F.lit(low))
    if high is not None:
        y = F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def series_key(*columns: str) -> Column:
    """Null if a part is null, where concat_ws would leave it out."""
    parts = [F.col(c).cast("string") for c in columns]
    return F.concat(*[p for i, c in enumerate(parts) for p in ([F.lit("_"), c] if i else [c])])


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    angle = x * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def direction(degrees: Column) -> tuple[Column, Column]:
    return F.sin(F.radians(degrees)), F.cos(F.radians(degrees))


def hash_uniform(seed: int, *columns: Column | str) -> Column:
    """A number in [0, 1) that depends on the row's values only."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def first_part(x: Column, separator: str = "+") -> Column:
    """The first component of a compound label."""
    return F.trim(F.substring_index(x, separator, 1))


def coded(x: Column, codes: dict[str, int], otherwise: int = 0) -> Column:
    out = None
    for name, code in codes.items():
        out = F.when(x == name, code) if out is None else out.when(x == name, code)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def one_hot(x: Column, values: list[str], prefix: str) -> dict[str, Column]:
    return {f"{prefix}{v}": F.coalesce((x == v).cast("int"), F.lit(0)) for v in values}


def wall_clock(text: Column) -> Column:
    """A time stamp's wall clock; an offset in the text is dropped, not applied."""
    return F.expr(f"try_cast(regexp_replace({text._jc.toString()}, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$', '') AS TIMESTAMP_NTZ)")
