"""Irregular series on a regular time grid, cases cut from it, and their features.

Time is a whole number of minutes (``minute``); the grid has a row per station and step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import direction, ratio
from .windows import Series

STEP, LOOK_BACK = 10, 2880
LEADS = (3, 6, 9, 12, 18, 24)


def minute(ts: str | Column) -> Column:
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp")) / 60).cast("long")


def regular(stations: DataFrame, first: int, last: int, step: int = STEP) -> DataFrame:
    """Every station's grid, both ends included."""
    return stations.withColumn("minute", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"), F.lit(step).cast("long"))))


def aligned(grid: DataFrame, *series: DataFrame, keys=("station", "minute")) -> DataFrame:
    """Left joins onto the grid.  A series with two rows at a time gives two, so it is made unique first."""
    for s in series:
        grid = grid.join(s, list(keys), "left")
    return grid


def unique_times(df: DataFrame, values: list[str], order: list[str], keys=("station", "minute")) -> DataFrame:
    """Of rows at one time the first by ``order``."""
    first = F.min(F.struct(*order, *[F.col(v).alias(f"_{v}") for v in values]))
    return df.groupBy(*keys).agg(first.alias("_f")).select(*keys, *[F.col(f"_f._{v}").alias(v) for v in values])


def latest(s: Series, c: str, rows: int = 289, time: str = "minute") -> dict[str, Column]:
    """The last value of a trailing window, and its age."""
    frame = s.until(rows)
    at = F.last(F.when(F.col(c).isNotNull(), F.col(time)), True).over(frame)
    return {f"latest_{c}": F.last(c, True).over(frame), f"latest_{c}_age": F.col(time) - at}


def lead_targets(s: Series, c: str, leads=LEADS, step: int = STEP) -> dict[str, Column]:
    return {f"target_{h}h": F.lead(c, h * 60 // step).over(s.window) for h in leads}


def eligible(df: DataFrame, s: Series, c: str, leads=LEADS, before: int = 288, step: int = STEP, threshold: float = 1.5) -> DataFrame:
    """Grid rows with a full context whose latest value reaches the threshold, and every target known."""
    x = df.withColumns({"_n": s.row(), "_latest": F.last(c, True).over(s.until(before + 1)), **lead_targets(s, c, leads, step)})
    whole = (F.col("_n") > before) & (F.col("_latest") >= threshold)
    for h in leads:
        whole = whole & F.col(f"target_{h}h").isNotNull()
    return x.filter(whole).drop("_n", "_latest")


def separated(df: DataFrame, keys: list[str], at: str, least: int) -> DataFrame:
    """Rows kept greedily: each at least ``least`` after the last kept one.

    Which rows stay depends on all before them.  Positions further apart than ``least`` start anew
    whatever came before, so a key is cut there first, and each piece folded by itself.
    """
    order = W.partitionBy(*keys).orderBy(at)
    x = df.select(*keys, at).distinct().withColumn("_new", F.coalesce((F.col(at) - F.lag(at, 1).over(order) >= least).cast("int"), F.lit(1)))
    x = x.withColumn("_piece", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    folded = x.groupBy(*keys, "_piece").agg(F.array_sort(F.collect_list(at)).alias("_all"))
    start = F.struct(F.array().cast("array<bigint>").alias("kept"), F.lit(None).cast("bigint").alias("last"))
    step = lambda acc, v: F.when(acc["last"].isNull() | (v - acc["last"] >= least), F.struct(F.concat(acc["kept"], F.array(v)).alias("kept"), v.alias("last"))).otherwise(acc)
    kept = folded.select(*keys, F.explode(F.aggregate(F.transform("_all", lambda v: v.cast("bigint")), start, step)["kept"]).alias(at))
    return df.join(kept.withColumn(at, F.col(at).cast(dict(df.dtypes)[at])), [*keys, at], "left_semi")


def strided(df: DataFrame, s: Series, stride: int) -> DataFrame:
    """Every ``stride``-th row of a series, from the first."""
    return df.withColumn("_n", s.row()).filter((F.col("_n") - 1) % stride == 0).drop("_n")


def purged(train: DataFrame, valid: DataFrame, key: str = "station", at: str = "minute", before: int = 2880, after: int = 1440, buffer: int = 360) -> DataFrame:
    """Training rows whose closed interval meets none of validation, widened after by ``buffer``.

    Intervals meet only in the same or neighbouring buckets of the widest reach, so the join is an
    equi-join on (key, bucket), not a comparison of all pairs.
    """
    reach = 2 * (before + after) + buffer
    bucket = lambda c: F.floor(c / reach).cast("long")
    v = valid.select(F.col(key).alias("_k"), F.col(at).alias("_v")).distinct().withColumn("_b", F.explode(F.array(*[bucket(F.col("_v")) + i for i in (-1, 0, 1)])))
    hit = (F.col(key) == F.col("_k")) & (bucket(F.col(at)) == F.col("_b")) & (F.col(at) - before <= F.col("_v") + after + buffer) & (F.col(at) + after >= F.col("_v") - before)
    return train.join(v, hit, "left_anti")


def contexts(anchors: DataFrame, grid: DataFrame, look_back: int = LOOK_BACK, key: str = "station", at: str = "minute") -> DataFrame:
    """Every grid row of the ``look_back`` minutes that end at an anchor, with its (non-positive) step.

    A range join as an equi-join: an anchor goes to each bucket its context touches.
    """
    bucket = lambda c: F.floor(c / (look_back + 1)).cast("long")
    a = anchors.select(F.col(key), F.col(at).alias("_ref"), *[c for c in anchors.columns if c not in (key, at)])
    a = a.withColumn("_b", F.explode(F.array_distinct(F.array(bucket(F.col("_ref") - look_back), bucket(F.col("_ref"))))))
    g = grid.withColumn("_b", bucket(F.col(at)))
    x = a.join(g, [key, "_b"]).filter(F.col(at).between(F.col("_ref") - look_back, F.col("_ref")))
    return x.withColumn("step_minute", (F.col(at) - F.col("_ref")).cast("int")).drop("_b", at).withColumnRenamed("_ref", "ref_minute")


def range_features(cases: DataFrame, keys: list[str], value: str = "hs", wind: str | None = "wspd", gust: str | None = "gust", height: str | None = "caph", hours=(1, 3, 6, 12, 24, 48), step: str = "step_minute", default: float = 1.5, high=(1.5, 2.0)) -> DataFrame:
    """Features of closed time ranges that end at step 0: one aggregation with a row per case out.

    Ranges without a value fall back to the latest value and zeros; wind statistics stay null.
    """
    y, t = F.col(value), F.col(step)
    inside = lambda h: t.between(-60 * h, 0)
    known = y.isNotNull()
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(t.alias("t"), F.col(c).alias("v"))))
    first = lambda c, h: F.min(F.when(F.col(c).isNotNull() & inside(h), F.struct(t.alias("t"), F.col(c).alias("v"))))["v"]
    e: dict[str, Column] = {"_last": last(value), "_n": F.count(F.lit(1)), "_at0": F.max(F.when((t == 0) & known, 1).otherwise(0))}
    for h in hours:
        v = F.when(inside(h), y)
        e |= {f"_n{h}": F.count(v), f"_mean{h}": F.avg(v), f"_std{h}": F.stddev_samp(v), f"_min{h}": F.min(v), f"_max{h}": F.max(v), f"_first{h}": first(value, h), f"_slope{h}": F.regr_slope(v, F.when(inside(h) & known, t / 60.0))}
        if wind:
            x = F.when(inside(h), F.col(wind))
            e |= {f"{wind}_mean_{h}h": F.avg(x), f"{wind}_max_{h}h": F.max(x), f"_wstd{h}": F.stddev_samp(x), f"_wn{h}": F.count(x)}
        if gust:
            e[f"{gust}_max_{h}h"] = F.max(F.when(inside(h), F.col(gust)))
        if height:
            e |= {f"_hl{h}": F.max(F.when(F.col(height).isNotNull() & inside(h), F.struct(t.alias("t"), F.col(height).alias("v"))))["v"], f"_hf{h}": first(height, h), f"_hn{h}": F.count(F.when(inside(h), F.col(height)))}
    if wind:
        e["_lastw"] = last(wind)["v"]
    for limit in high:
        e[f"high_count_{str(limit).replace('.', '_')}"] = F.count(F.when(y >= limit, 1))
    g = cases.groupBy(*keys).agg(*[c.alias(n) for n, c in e.items()])
    latest_ = F.coalesce(F.col("_last.v"), F.lit(default))
    out: dict[str, Column] = {f"latest_{value}": latest_, f"latest_{value}_step": F.coalesce(F.col("_last.t"), F.lit(-9999)), f"latest_{value}_age": F.coalesce(-F.col("_last.t"), F.lit(9999)), f"{value}_at_0": F.col("_at0"), f"{value}_energy": latest_ * latest_}
    for h in hours:
        some, two = F.col(f"_n{h}") > 0, F.col(f"_n{h}") > 1
        out |= {
            f"{value}_mean_{h}h": F.when(some, F.col(f"_mean{h}")).otherwise(latest_), f"{value}_std_{h}h": F.when(two, F.col(f"_std{h}")).otherwise(0.0), f"{value}_min_{h}h": F.when(some, F.col(f"_min{h}")).otherwise(latest_),
            f"{value}_max_{h}h": F.when(some, F.col(f"_max{h}")).otherwise(latest_), f"{value}_range_{h}h": F.when(some, F.col(f"_max{h}") - F.col(f"_min{h}")).otherwise(0.0),
            f"{value}_diff_{h}h": F.when(some, latest_ - F.col(f"_first{h}")).otherwise(0.0), f"{value}_slope_{h}h": F.when(two, F.col(f"_slope{h}")).otherwise(0.0),
        }
        if wind:
            out |= {f"{wind}_mean_{h}h": F.col(f"{wind}_mean_{h}h"), f"{wind}_max_{h}h": F.col(f"{wind}_max_{h}h"), f"{wind}_std_{h}h": F.when(F.col(f"_wn{h}") > 1, F.col(f"_wstd{h}")).when(F.col(f"_wn{h}") == 1, 0.0)}
        if gust:
            out[f"{gust}_max_{h}h"] = F.col(f"{gust}_max_{h}h")
        if height:
            out[f"{height}_diff_{h}h"] = F.when(F.col(f"_hn{h}") > 1, F.col(f"_hl{h}") - F.col(f"_hf{h}")).otherwise(0.0)
    eps = 1e-6
    if wind:
        out |= {f"latest_{wind}": F.col("_lastw"), "wind_forcing_ratio": F.col("_lastw") * F.col("_lastw") / (latest_ + eps)}
    if gust and 3 in hours:
        out["gust_forcing_ratio"] = F.col(f"{gust}_max_3h") * F.col(f"{gust}_max_3h") / (latest_ + eps)
    if 24 in hours:
        out[f"{value}_over_mean_24h"] = latest_ / (out[f"{value}_mean_24h"] + eps)
        out["obs_count_24h"] = F.col("_n24").cast("double")
    if 48 in hours:
        out[f"{value}_over_max_48h"] = latest_ / (out[f"{value}_max_48h"] + eps)
        out |= {"obs_count_48h": F.col("_n48").cast("double"), "missing_ratio_48h": 1.0 - ratio(F.col("_n48").cast("double"), F.col("_n").cast("double"))}
    if 6 in hours:
        out["obs_count_6h"] = F.col("_n6").cast("double")
    counts = {f"high_count_{str(x).replace('.', '_')}": F.col(f"high_count_{str(x).replace('.', '_')}").cast("double") for x in high}
    return g.select(*keys, *[c.alias(n) for n, c in {**out, **counts}.items()])


def direction_difference(a: Column, b: Column) -> tuple[Column, Column]:
    """Sine and cosine of the angle between two directions in degrees."""
    return direction(a - b)


def case_leads(cases: DataFrame, leads=LEADS) -> DataFrame:
    """A row per case and lead."""
    return cases.withColumn("lead_h", F.explode(F.array(*[F.lit(h) for h in leads])))


def persistence(latest_value: Column, default: float = 1.5) -> Column:
    return F.coalesce(latest_value, F.lit(default))


def case_id(station: Column, at: Column) -> Column:
    """H_STATION_yyyyMMddHHmm, with underscores for hyphens; ``at`` is in minutes."""
    return F.concat(F.lit("H_"), F.replace(station.cast("string"), F.lit("-"), F.lit("_")), F.lit("_"), F.date_format(F.timestamp_seconds(at * 60), "yyyyMMddHHmm"))


def check_persistence(cases: DataFrame, official: DataFrame, key: str = "case_id", value: str = "persistence", given: str = "hs_pred") -> dict:
    """Rows and the largest difference; raises if an official row differs from its case's persistence or has none."""
    x = official.select(key, F.col(given).cast("double").alias("_o")).join(cases.select(key, F.col(value).cast("double").alias("_c")), key, "left")
    off = F.abs(F.col("_o") - F.col("_c"))
    row = x.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(~F.col("_o").eqNullSafe(F.col("_c"))).alias("mismatch_rows"), F.coalesce(F.max(off), F.lit(0.0)).alias("max_absolute_difference")).first().asDict()
    if row["mismatch_rows"]:
        raise RuntimeError(f"{row['mismatch_rows']} of {row['total_rows']} rows aren't persistence (largest difference {row['max_absolute_difference']})")
    return row
