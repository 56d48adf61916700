"""Statistics that are fitted on one table and applied to another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from . import order

FLOOR = 1e-10


def robust(df: DataFrame, columns: list[str], keys: list[str] = (), floor: float = FLOOR) -> DataFrame:
    """Per key and column: mean, std, median, mad, q25, q75; spreads have a floor.

    Two passes of grouped aggregation, as the distances need the medians.  Without keys, quantiles are
    looked for in the order of all rows (``order.percentiles``), as one buffer can't hold a table's values.
    """
    if not keys:
        return _robust_of_all(df, columns, floor)
    first = [e for c in columns for e in (F.avg(c).alias(f"{c}_mean"), F.greatest(F.stddev_samp(c), F.lit(floor)).alias(f"{c}_std"), F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"{c}_q"))]
    q = df.groupBy(*keys).agg(*first)
    q = q.select(*keys, *[e for c in columns for e in (F.col(f"{c}_mean"), F.col(f"{c}_std"), F.get(f"{c}_q", F.lit(0)).alias(f"{c}_q25"), F.get(f"{c}_q", F.lit(1)).alias(f"{c}_median"), F.get(f"{c}_q", F.lit(2)).alias(f"{c}_q75"))])
    mads = df.join(q, list(keys)).groupBy(*keys).agg(*[F.greatest(F.percentile(F.abs(F.col(c) - F.col(f"{c}_median")), 0.5), F.lit(floor)).alias(f"{c}_mad") for c in columns])
    return q.join(mads, list(keys))


def _robust_of_all(df: DataFrame, columns: list[str], floor: float) -> DataFrame:
    """One row; all tables joined here are one row."""
    out = df.agg(*[e for c in columns for e in (F.avg(c).alias(f"{c}_mean"), F.greatest(F.stddev_samp(c), F.lit(floor)).alias(f"{c}_std"))])
    for c in columns:
        q = order.percentiles(df, c, {f"{c}_q25": 0.25, f"{c}_median": 0.5, f"{c}_q75": 0.75})
        off = df.select(c).crossJoin(F.broadcast(q.select(f"{c}_median"))).select(F.abs(F.col(c) - F.col(f"{c}_median")).alias("_off"))
        mad = order.percentiles(off, "_off", {"_mad": 0.5}).select(F.greatest("_mad", F.lit(floor)).alias(f"{c}_mad"))
        out = out.crossJoin(F.broadcast(q)).crossJoin(F.broadcast(mad))
    return out


def robust_scores(df: DataFrame, fitted: DataFrame, c: str, keys: list[str] = ()) -> DataFrame:
    """z scores, their robust form (raw MAD), and whether a value is outside 1.5 quartile ranges."""
    x = df.join(fitted, list(keys), "left") if keys else df.crossJoin(F.broadcast(fitted))
    iqr = F.col(f"{c}_q75") - F.col(f"{c}_q25")
    out = (F.col(c) < F.col(f"{c}_q25") - 1.5 * iqr) | (F.col(c) > F.col(f"{c}_q75") + 1.5 * iqr)
    x = x.withColumns({f"{c}_zscore": (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std"), f"{c}_robust_zscore": (F.col(c) - F.col(f"{c}_median")) / F.col(f"{c}_mad"), f"{c}_iqr_flag": F.coalesce(out.cast("int"), F.lit(0))})
    return x.drop(*[f"{c}_{n}" for n in ("mean", "std", "median", "mad", "q25", "q75")])


def group_scale(train: DataFrame, c: str, keys: list[str], floor: float = 1e-6) -> DataFrame:
    """Median and MAD of each series."""
    return robust(train, [c], keys, floor).select(*keys, F.col(f"{c}_median").alias("centre"), F.col(f"{c}_mad").alias("spread"))


def offsets(train: DataFrame, df: DataFrame, c: str, key: str) -> DataFrame:
    """Value less its group's mean in training; groups not met there get the overall mean."""
    means = train.groupBy(key).agg(F.avg(c).alias("_mean"))
    overall = train.agg(F.avg(c).alias("_all"))
    return df.join(means, key, "left").crossJoin(F.broadcast(overall)).withColumn(f"{c}_dev_{key}_mean", F.col(c) - F.coalesce("_mean", "_all")).drop("_mean", "_all")


def climatology(train: DataFrame, c: str, grains: list[list[str]]) -> list[DataFrame]:
    """Means at each grain, finest first; the last may be empty for the overall mean."""
    return [train.groupBy(*g).agg(F.avg(c).alias(f"_clim{i}")) for i, g in enumerate(grains)]


def fallback(df: DataFrame, fitted: list[DataFrame], grains: list[list[str]], name: str, default: float | None = None) -> DataFrame:
    """The mean of the finest grain that has one."""
    for i, (table, g) in enumerate(zip(fitted, grains)):
        df = df.join(table, g, "left") if g else df.crossJoin(F.broadcast(table))
    found = [F.col(f"_clim{i}") for i in range(len(grains))] + ([F.lit(default)] if default is not None else [])
    return df.withColumn(name, F.coalesce(*found)).drop(*[f"_clim{i}" for i in range(len(grains))])


def imputation(train: DataFrame, numbers: list[str], categories: list[str], how: str = "median") -> dict:
    """Fitted replacements: median or mean, and the smallest most frequent category or "missing"."""
    if how == "median":
        row = {c: order.percentiles(train, c, {c: 0.5}).first()[c] for c in numbers}
    else:
        row = train.agg(*[F.avg(c).alias(c) for c in numbers]).first().asDict() if numbers else {}
    for c in categories:
        most = train.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), c).first()
        row[c] = most and most[c]
    return {c: row[c] if row[c] is not None else ("missing" if c in categories else 0.0) for c in [*numbers, *categories]}


def imputed(df: DataFrame, values: dict, flags: list[str] = ()) -> DataFrame:
    """Nulls replaced; ``flags`` get a 0/1 column that tells where, whatever this table's own nulls."""
    x = df.withColumns({f"{c}_isnull": F.col(c).isNull().cast("int") for c in flags}) if flags else df
    return x.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in values.items()})


def flagged_columns(train: DataFrame, columns: list[str]) -> list[str]:
    """The columns with a null in training."""
    row = train.agg(*[F.max(F.col(c).isNull().cast("int")).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def category_statistics(train: DataFrame, df: DataFrame, categories: list[str], numbers: list[str], least: int = 2, most: int = 100) -> DataFrame:
    """Training mean and std of numbers by category, for categories of a moderate number of values."""
    row = train.agg(*[F.count_distinct(c).alias(c) for c in categories]).first()
    for c in [c for c in categories if least <= row[c] <= most]:
        table = train.groupBy(c).agg(*[e for n in numbers for e in (F.avg(n).alias(f"{c}_{n}_mean"), F.stddev_samp(n).alias(f"{c}_{n}_std"))])
        df = df.join(F.broadcast(table), c, "left")  # at most `most` rows
    return df


def standardized(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Less the mean, over the population's standard deviation; a constant column is only centred."""
    fitted = train.agg(*[e for c in columns for e in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    x = df.crossJoin(F.broadcast(fitted))
    return x.withColumns({f"{c}_scaled": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def interactions(columns: list[str]) -> dict[str, Column]:
    """Products and quotients of pairs."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return {f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs} | {f"{a}_div_{b}": F.try_divide(F.col(a), F.col(b) + 1e-5) for a, b in pairs}


def balanced_weights(df: DataFrame, label: str, low: Column | None = None, factor: float = 0.35) -> DataFrame:
    """n / (classes * n of the class), times ``factor`` where ``low`` holds."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    x = df.join(F.broadcast(counts.crossJoin(F.broadcast(total))), label)  # a row per class
    weight = F.col("_all") / (F.col("_k") * F.col("_n"))
    return x.withColumn("weight", weight if low is None else F.when(low, weight * factor).otherwise(weight)).drop("_n", "_all", "_k")


def normalized(df: DataFrame, weight: str = "weight") -> DataFrame:
    """Weights with a mean of 1."""
    mean = df.agg(F.avg(weight).alias("_mean"))
    return df.crossJoin(F.broadcast(mean)).withColumn(weight, ratio(F.col(weight), F.col("_mean"))).drop("_mean")


def group_spread(df: DataFrame, c: str, keys: list[str]) -> DataFrame:
    """Median, range and count over a group, beside each of its rows, and the deviation."""
    g = df.groupBy(*keys).agg(F.percentile(c, 0.5).alias(f"{c}_layer_median"), (F.max(c) - F.min(c)).alias(f"{c}_layer_spread"), F.count(c).alias(f"{c}_layer_count"))
    return df.join(g, keys).withColumn(f"{c}_dev_layers", F.col(c) - F.col(f"{c}_layer_median"))
