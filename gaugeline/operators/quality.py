"""Checks of tables: columns, nulls, domains, cardinalities, order; and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def require(df: DataFrame, columns: list[str], name: str = "table", filled: bool = False) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    if filled and df.isEmpty():
        raise ValueError(f"{name}: no rows")


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, nulls: one pass over all columns."""
    columns = columns or df.columns
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])).alias("x")).select("x.*")


def violations(df: DataFrame, rules: dict[str, Column], key: list[str]) -> DataFrame:
    """rule and key of each row for which a rule isn't true."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return df.select(*key, F.explode(broken).alias("rule"))


def group_sizes(df: DataFrame, keys: list[str], expected: int, at: str, first, last) -> DataFrame:
    """Groups that have another number of rows, or other ends, than expected."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    return g.filter((F.col("n") != expected) | (F.col("first") != first) | (F.col("last") != last))


def frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n."""
    return reduce(DataFrame.unionAll, [df.groupBy(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")) for c in columns])


def summary(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """count, mean, std, min, exact quartiles and max of numbers, a row per column (and key)."""
    one = lambda c: df.groupBy(*keys, F.lit(c).alias("column")).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), *[F.percentile(c, q / 100).alias(f"q{q}") for q in (25, 50, 75)], F.max(c).cast("double").alias("max"))
    return reduce(DataFrame.unionAll, [one(c) for c in columns])


def time_order(df: DataFrame, keys: list[str], order: list[str], time: str) -> DataFrame:
    """Per key: rows, rows without a time, and steps back in time in the given order."""
    before = F.lag(time, 1).over(W.partitionBy(*keys).orderBy(*order))
    x = df.select(*keys, F.col(time), (F.col(time) < before).alias("_back"))
    return x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(time).isNull()).alias("unparsed"), F.count_if(F.col("_back")).alias("steps_back"))


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are repeated, or only in one of two tables, and why."""
    n = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    x = n(a, "n_left").join(n(b, "n_right"), keys, "full")
    why = F.when(F.col("n_left").isNull(), "only_right").when(F.col("n_right").isNull(), "only_left").when(F.col("n_left") > 1, "left_repeated").when(F.col("n_right") > 1, "right_repeated")
    return x.withColumn("problem", why).filter("problem IS NOT NULL").select(*keys, "problem")
