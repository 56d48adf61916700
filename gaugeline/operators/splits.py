"""Temporal splits, masks, folds and row weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_uniform
from . import order
from .grid import purged, separated, strided
from .windows import Series


def by_row_count(df: DataFrame, by: list[str], test: float = 0.2, slices: int = order.MOST) -> DataFrame:
    """Adds ``part``: the last share of rows in an order without ties is "valid".

    The cut is at row int(n * (1 - test)); only that row's key is looked for, and no rows are ranked.
    """
    n = df.count()
    cut = int(n * (1 - test))
    if n == 0:
        return df.withColumn("part", F.lit("train"))
    if cut == 0:
        return df.withColumn("part", F.lit("valid"))
    kinds = dict(df.dtypes)
    last = F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(by, order.nth(df, by, cut, max(1, n // slices)))])
    return df.withColumn("part", F.when(F.struct(*by) <= last, "train").otherwise("valid"))


def nth_time(df: DataFrame, time: str, test: float = 0.2) -> DataFrame:
    """The distinct time at which the last share of times begins, as one row ``cut``."""
    times = df.select(time).distinct().withColumn("_one", F.lit(1).cast("long"))
    n = times.agg(F.count(F.lit(1)).alias("_n"))
    return order.ahead(times, time, {"_at": "_one"}).crossJoin(F.broadcast(n)).filter(F.col("_at") == F.floor(F.col("_n") * (1 - test))).select(F.col(time).alias("cut"))


def by_distinct_time(df: DataFrame, time: str, test: float = 0.2) -> DataFrame:
    return df.crossJoin(F.broadcast(nth_time(df, time, test))).withColumn("part", F.when(F.col(time) < F.col("cut"), "train").otherwise("valid")).drop("cut")


def masked(df: DataFrame, where: Column, columns: list[str], truth: str | None = None) -> DataFrame:
    """Columns made null where the condition holds (not where it is null); the truth is set aside."""
    hide = F.coalesce(where, F.lit(False))
    x = df.withColumn("is_masked", hide)
    if truth:
        x = x.withColumn("truth", F.when(F.col("is_masked"), F.col(truth)))
    return x.withColumns({c: F.when(~F.col("is_masked"), F.col(c)) for c in columns})


def random_mask(rate: float, seed: int, *keys: str) -> Column:
    return hash_uniform(seed, *keys) < rate


def simulated(df: DataFrame, station, first: str, last: str, layers: list[int], hidden: tuple[str, ...] = ("temp", "psal"), truth: str = "temp", time: str = "time", key: str = "station", layer: str = "layer", test: float = 0.2) -> DataFrame:
    """Adds ``part``, ``is_masked`` and ``truth``: a period of one station, its layers hidden, is "valid".

    A station that never occurs means all of them; a period without rows means the latest share of
    distinct times, of all stations.
    """
    kind = dict(df.dtypes)[time]
    where = F.col(time).between(F.lit(first).cast(kind), F.lit(last).cast(kind))
    if not df.filter(F.col(key) == station).isEmpty():
        where = where & (F.col(key) == station)
    if df.filter(where).isEmpty():
        x = by_distinct_time(df, time, test)
    else:
        x = df.withColumn("part", F.when(where, "valid").otherwise("train"))
    return masked(x, (F.col("part") == "valid") & F.col(layer).isin(layers), [c for c in hidden if c in df.columns], truth)


def season_slices(df: DataFrame, time: str, windows: list[tuple[str, str, str]], least: int, evaluable: Column) -> DataFrame:
    """Rows of closed, named windows that have more than ``least`` rows to be evaluated."""
    spark = df.sparkSession
    table = spark.createDataFrame(windows, "window string, _a string, _b string")  # a literal list
    x = df.join(F.broadcast(table), F.col(time).between(F.col("_a").cast("timestamp_ntz"), F.col("_b").cast("timestamp_ntz"))).drop("_a", "_b")
    enough = x.groupBy("window").agg(F.count_if(evaluable).alias("_n")).filter(F.col("_n") > least).select("window")
    return x.join(F.broadcast(enough), "window", "left_semi")


def dropout(df: DataFrame, time: str, layer: str, boundary: int, rate: float, seed: int) -> DataFrame:
    """Without the boundary layer's rows at a share of times, chosen by a hash of the time."""
    return df.filter(~F.coalesce((F.col(layer) == boundary) & (hash_uniform(seed, time) < rate), F.lit(False)))


def rich_weights(df: DataFrame, time: str, layer: str, deep: list[int], least: int = 3, weight: float = 4.0) -> DataFrame:
    """Rows of times with at least ``least`` deep layers weigh more; weights have a mean of 1."""
    rich = df.filter(F.col(layer).isin(deep)).groupBy(time).agg(F.count_distinct(layer).alias("_n")).filter(F.col("_n") >= least).select(F.col(time).alias("_t"))
    x = df.join(rich, F.col(time) == F.col("_t"), "left").withColumn("weight", F.when(F.col("_t").isNotNull(), weight).otherwise(1.0)).drop("_t")
    mean = x.agg(F.avg("weight").alias("_m"))
    return x.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("weight") / F.col("_m")).drop("_m")


def coverage_weights(cases: DataFrame, keys: list[str], c: str, weight: float = 0.25) -> DataFrame:
    """Cases with at most half of ``c`` observed weigh less; weights have a mean of 1."""
    g = cases.groupBy(*keys).agg(F.avg(F.col(c).isNotNull().cast("double")).alias("_share")).withColumn("weight", F.when(F.col("_share") > 0.5, 1.0).otherwise(weight))
    mean = g.agg(F.avg("weight").alias("_m"))
    return g.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("weight") / F.col("_m")).drop("_m", "_share")


def forward_split(cases: DataFrame, cut: int, end: int, key: str = "station", at: str = "minute", sparse: int = 4680, stride: int = 2, before: int = 2880, after: int = 1440, buffer: int = 360) -> DataFrame:
    """Sparse validation cases of [cut, end) and dense training cases before, purged of overlaps."""
    valid = separated(cases.filter(F.col(at).between(cut, end - 1)), [key], at, sparse)
    train = strided(cases.filter(F.col(at) < cut), Series((key,), (at,)), stride)
    return purged(train, valid, key, at, before, after, buffer).withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("valid")))


def rolling_folds(cases: DataFrame, cuts: list[tuple[int, int]], **options) -> DataFrame:
    """``forward_split`` for each (cut, end), numbered from 1."""
    out = None
    for i, (cut, end) in enumerate(cuts, 1):
        fold = forward_split(cases, cut, end, **options).withColumn("fold", F.lit(i))
        out = fold if out is None else out.unionByName(fold)
    return out
