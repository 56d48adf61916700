"""Row-window statistics of many series at once.

A series is the rows of a key in the order of its columns.  All statistics are causal unless said
otherwise: a frame ends before the current row (``-w .. -1``), which is the same as a window of ``w``
over the values lagged by one.  Series never see each other's rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clip, ratio

STATISTICS = ("mean", "std", "var", "min", "max", "range", "median", "q25", "q75")


@dataclass(frozen=True)
class Series:
    """keys: what a series is; order: columns that order its rows without ties."""

    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def window(self):
        return W.partitionBy(*self.keys).orderBy(*self.order)

    def before(self, w: int):
        return self.window.rowsBetween(-w, -1)

    def until(self, w: int):
        return self.window.rowsBetween(1 - w, 0)

    def around(self, w: int):
        return self.window.rowsBetween(-(w // 2), w - w // 2 - 1)

    def row(self) -> Column:
        return F.row_number().over(self.window)


def enough(value: Column, x: Column, frame, least: int) -> Column:
    """``value`` where the frame has at least ``least`` values."""
    return value if least <= 1 else F.when(F.count(x).over(frame) >= least, value)


def lags(s: Series, c: str, offsets=(1, 2, 3, 6, 12)) -> dict[str, Column]:
    return {f"{c}_lag{k}": F.lag(c, k).over(s.window) for k in offsets}


def differences(s: Series, c: str) -> dict[str, Column]:
    """Differences of lagged values, so the current value is in none."""
    at = lambda k: F.lag(c, k).over(s.window)
    d1 = at(1) - at(2)
    return {f"{c}_diff1": d1, f"{c}_diff2": at(1) - at(3), f"{c}_diff6": at(1) - at(7), f"{c}_gradient": d1, f"{c}_abs_gradient": F.abs(d1), f"{c}_second_deriv": d1 - (at(2) - at(3))}


def statistic(x: Column, frame, name: str) -> Column:
    if name == "range":
        return F.max(x).over(frame) - F.min(x).over(frame)
    if name in ("median", "q25", "q75"):
        return F.percentile(x, {"median": 0.5, "q25": 0.25, "q75": 0.75}[name]).over(frame)
    return {"mean": F.avg, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}[name](x).over(frame)


def rolling(s: Series, c: str, windows, statistics=STATISTICS, least: int = 1) -> dict[str, Column]:
    return {f"{c}_roll_{n}_{w}": enough(statistic(F.col(c), s.before(w), n), F.col(c), s.before(w), least) for w in windows for n in statistics}


def rolling_mad(df: DataFrame, s: Series, c: str, w: int) -> DataFrame:
    """The median, over a window, of distances of each lagged value from its own rolling median."""
    off = df.withColumn("_off", F.abs(F.lag(c, 1).over(s.window) - F.percentile(F.col(c), 0.5).over(s.before(w))))
    return off.withColumn(f"{c}_roll_mad_{w}", F.percentile(F.col("_off"), 0.5).over(s.until(w))).drop("_off")


def slope(s: Series, c: str, w: int) -> Column:
    """Least-squares slope per row over a window that must be full."""
    frame = s.before(w)
    return F.when(F.count(c).over(frame) == w, F.regr_slope(F.col(c), F.col("_row")).over(frame))


def with_slopes(df: DataFrame, s: Series, c: str, windows) -> DataFrame:
    return df.withColumn("_row", s.row().cast("double")).withColumns({f"{c}_slope_{w}": slope(s, c, w) for w in windows}).drop("_row")


def residuals(s: Series, c: str, windows) -> dict[str, Column]:
    """Lagged value less the rolling mean, and current value less it."""
    out = {}
    for w in windows:
        mean = F.avg(c).over(s.before(w))
        out |= {f"{c}_resid_rollmean_{w}": F.lag(c, 1).over(s.window) - mean, f"{c}_dev_rollmean_{w}": F.col(c) - mean, f"{c}_cv_{w}": ratio(F.stddev_samp(c).over(s.before(w)), F.abs(mean))}
    return out


def unique_count(s: Series, c: str, w: int) -> Column:
    """Distinct values of a frame; COUNT(DISTINCT) can't be framed."""
    return F.size(F.collect_set(c).over(s.before(w))).cast("long")


def run_length(df: DataFrame, s: Series, c: str, name: str | None = None) -> DataFrame:
    """How many equal values in a row end here; a null is always a run of its own."""
    before = F.lag(c, 1).over(s.window)
    df = df.withColumn("_new", (F.col(c).isNull() | before.isNull() | (F.col(c) != before)).cast("int"))
    df = df.withColumn("_run", F.sum("_new").over(s.window.rowsBetween(W.unboundedPreceding, 0)))
    rows = W.partitionBy(*s.keys, "_run").orderBy(*s.order)
    return df.withColumn(name or f"{c}_runlength", F.row_number().over(rows).cast("long")).drop("_new", "_run")


def missing_run(df: DataFrame, s: Series, c: str, name: str = "missing_run") -> DataFrame:
    """How many rows without a value end here; 0 where there is one."""
    df = df.withColumn("_seen", F.count(c).over(s.window.rowsBetween(W.unboundedPreceding, 0)))
    rows = W.partitionBy(*s.keys, "_seen").orderBy(*s.order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.col(c).isNull().cast("long")).over(rows)).drop("_seen")


def volatility_ratio(df: DataFrame, s: Series, c: str, short: int = 18, long: int = 1008, least_short: int = 6, least_long: int = 48) -> DataFrame:
    """The recent median step over the series' usual one."""
    df = df.withColumn("_step", F.abs(F.col(c) - F.lag(c, 1).over(s.window)))
    median = lambda w, least: enough(F.percentile(F.col("_step"), 0.5).over(s.until(w)), F.col("_step"), s.until(w), least)
    return df.withColumn("vol_ratio", median(short, least_short) / (median(long, least_long) + 1e-6)).drop("_step")


def baseline_residual(s: Series, c: str, w: int = 1008, least: int = 48) -> Column:
    """Value less the median of a long window that ends here."""
    return F.col(c) - enough(F.percentile(F.col(c), 0.5).over(s.until(w)), F.col(c), s.until(w), least)


def centred_fit(df: DataFrame, s: Series, c: str, w: int) -> DataFrame:
    """Over a centred window: how far the fitted line travels, R squared, and the spread.

    The moments of the row number are over all rows of the frame, the covariance is a population
    one and the variance of the values a sample one; R squared is clipped to [0, 1].
    """
    frame, least = s.around(w), max(8, w // 3)
    df = df.withColumn("_x", (s.row() - 1).cast("double"))
    x, y = F.col("_x"), F.col(c)
    guard = lambda e: F.when(F.count(y).over(frame) >= least, e)
    all_x = lambda e: F.when(F.count(x).over(frame) >= least, e)
    mean_x, mean_y = F.avg(x).over(frame), F.avg(y).over(frame)
    df = df.withColumns({"_cov": guard(F.avg(x * y).over(frame) - mean_x * mean_y), "_vx": all_x(F.avg(x * x).over(frame) - mean_x * mean_x), "_vy": guard(F.var_samp(y).over(frame))})
    cov, vx, vy = F.col("_cov"), F.col("_vx"), F.col("_vy")
    return df.withColumns({f"{c}_ctr_span_{w}": F.abs(ratio(cov, vx) * w), f"{c}_ctr_r2_{w}": clip(ratio(cov * cov, vx * vy), 0.0, 1.0), f"{c}_ctr_flat_{w}": F.sqrt(vy)}).drop("_x", "_cov", "_vx", "_vy")


def ema(df: DataFrame, s: Series, c: str, spans) -> DataFrame:
    """Exponentially weighted means of the lagged values, with weights that decay over gaps, too.

    A recurrence over rows has no window form that stays stable on long series, so it is one grouped
    function for all spans; a group is one series.
    """
    keep = df.columns
    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + "".join(f", `{c}_ema_{w}` double, `{c}_ema_diff_{w}` double" for w in spans)

    def smooth(frame):
        frame = frame.sort_values(list(s.order), kind="stable")
        x = frame[c].astype(float).shift(1)
        for w in spans:
            out = x.ewm(span=w, adjust=True, ignore_na=False).mean()
            frame[f"{c}_ema_{w}"], frame[f"{c}_ema_diff_{w}"] = out, x - out
        return frame

    out = df.select(*keep).groupBy(*s.keys).applyInPandas(smooth, fields)
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for w in spans for n in (f"{c}_ema_{w}", f"{c}_ema_diff_{w}")})


def percent_rank(x: str, keys: tuple[str, ...] = ()) -> Column:
    """The average rank of ties over the number of values of a group, unlike PERCENT_RANK.

    Without keys all rows are one group, in one task; for large tables there is ``order.shares``.
    """
    every = W.partitionBy(*keys)
    peers = F.count(F.lit(1)).over(W.partitionBy(*keys, x))
    return (F.rank().over(every.orderBy(x)) + (peers - 1) / 2.0) / F.count(x).over(every)


def sequences(df: DataFrame, s: Series, columns: list[str], length: int, stride: int) -> DataFrame:
    """Every ``stride``-th full run of ``length`` rows without a null, as an array per column."""
    frame = s.until(length)
    full = df.withColumns({f"{c}_seq": F.collect_list(c).over(frame) for c in columns}).withColumn("_n", s.row())
    whole = F.col("_n") >= length
    for c in columns:
        whole = whole & (F.size(f"{c}_seq") == length)
    return full.filter(whole & ((F.col("_n") - length) % stride == 0)).drop("_n")


def channels(df: DataFrame, s: Series, value: str, deviation: str, length: int = 128, stride: int = 4) -> DataFrame:
    """The three channels of a sequence scorer: value and deviation less their medians, and steps, the first being 0."""
    x = sequences(df, s, [value, deviation], length, stride)
    v = F.col(f"{value}_seq")
    steps = F.transform(v, lambda e, i: F.abs(e - F.get(v, F.greatest(i - 1, F.lit(0)))))
    return x.withColumns({f"{value}_centred": centred(v), f"{deviation}_centred": centred(F.col(f"{deviation}_seq")), f"{value}_steps": steps}).drop(f"{value}_seq", f"{deviation}_seq")


def centred(array: Column) -> Column:
    """An array less its median."""
    n = F.size(array)
    ordered = F.array_sort(array)
    median = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2.0
    return F.transform(array, lambda v: v - median)


def across_series(df: DataFrame, s: Series, c: str, w: int, statistics=("mean",)) -> DataFrame:
    """Rolling statistics of lagged values that run on from one series into the next.

    For results that were made with ungrouped windows over grouped lags; everything else here keeps
    series apart.  Rows get their place in the order of all series from counts per series.  A series is
    given the ``w`` rows before it, whichever series they are of, by a join on blocks of ``w`` places, and is then
    a partition like any other.
    """
    keys = list(s.keys)
    x = df.withColumns({"_lag": F.lag(c, 1).over(s.window), "_row": s.row()})
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    place = W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)  # a row per series
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(place), F.lit(0))).drop("_n")
    x = x.join(starts, keys).withColumn("_at", F.col("_start") + F.col("_row"))
    block = lambda at: F.floor(at / w).cast("long")
    need = starts.select(F.struct(*keys).alias("_series"), F.col("_start").alias("_first")).withColumn("_b", F.explode(F.array_distinct(F.array(block(F.col("_first") - w + 1), block(F.col("_first"))))))
    halo = x.select(F.col("_at"), F.col("_lag"), block(F.col("_at")).alias("_b")).join(need, "_b").filter((F.col("_at") <= F.col("_first")) & (F.col("_at") > F.col("_first") - w)).select("_series", "_at", "_lag")
    own = x.select(F.struct(*keys).alias("_series"), "_at", "_lag", F.struct(*df.columns).alias("_all"))
    both = own.unionByName(halo, allowMissingColumns=True)
    frame = W.partitionBy("_series").orderBy("_at").rowsBetween(1 - w, 0)
    out = both.withColumns({f"{c}_roll_{n}_{w}": statistic(F.col("_lag"), frame, n) for n in statistics})
    return out.filter("_all IS NOT NULL").select("_all.*", *[f"{c}_roll_{n}_{w}" for n in statistics])
