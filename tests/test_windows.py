"""Window operators against pandas, on frames with nulls, ties, single rows and seams between series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import windows as win
from gaugeline.operators.windows import Series

S = Series(("s",), ("t", "i"))


@pytest.fixture(scope="module")
def frame():
    r = np.random.default_rng(4)
    rows = []
    for s, n in (("a", 60), ("b", 45), ("one", 1), ("flat", 30), ("hole", 30)):
        x = r.normal(10, 3, n).round(2)
        if s == "flat":
            x[:] = 5.0
        if s in ("a", "b"):
            x[r.random(n) < 0.2] = np.nan
        if s == "hole":
            x[:8] = np.nan
            x[12:16] = np.nan
            x[16:20] = 7.0
        rows += [(s, k // 2, k, v) for k, v in enumerate(x)]
    return pd.DataFrame(rows, columns=["s", "t", "i", "x"])


@pytest.fixture(scope="module")
def df(spark, frame):
    rows = [(s, int(t), int(i), None if v != v else float(v)) for s, t, i, v in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, "s string, t int, i int, x double").repartition(7).cache()


def result(df, column):
    return df.select("s", "t", "i", column).toPandas().sort_values(["s", "t", "i"])[column].to_numpy(dtype=float)


def expected(frame, f):
    x = frame.sort_values(["s", "t", "i"])
    return x.groupby("s", group_keys=False)["x"].apply(f).to_numpy(dtype=float)


def same(a, b):
    np.testing.assert_allclose(a, b, rtol=1e-8, atol=1e-8)


@pytest.mark.parametrize("name,f", [("mean", "mean"), ("std", "std"), ("var", "var"), ("min", "min"), ("max", "max"), ("median", "median")])
def test_rolling_statistics(df, frame, name, f):
    got = result(df.withColumns(win.rolling(S, "x", (5,), (name,))), f"x_roll_{name}_5")
    same(got, expected(frame, lambda v: getattr(v.shift(1).rolling(5, min_periods=1), f)()))


def test_rolling_quantiles_and_range(df, frame):
    x = df.withColumns(win.rolling(S, "x", (6,), ("q25", "q75", "range")))
    lagged = lambda v: v.shift(1).rolling(6, min_periods=1)
    same(result(x, "x_roll_q25_6"), expected(frame, lambda v: lagged(v).quantile(0.25)))
    same(result(x, "x_roll_q75_6"), expected(frame, lambda v: lagged(v).quantile(0.75)))
    same(result(x, "x_roll_range_6"), expected(frame, lambda v: lagged(v).max() - lagged(v).min()))


def test_mad_uses_each_rows_own_median(df, frame):
    def mad(v):
        lag = v.shift(1)
        return (lag - lag.rolling(6, min_periods=1).median()).abs().rolling(6, min_periods=1).median()

    same(result(win.rolling_mad(df, S, "x", 6), "x_roll_mad_6"), expected(frame, mad))


def test_ema_decays_through_gaps(df, frame):
    f = lambda v: v.shift(1).ewm(span=8, adjust=True, ignore_na=False).mean()
    same(result(win.ema(df, S, "x", (8,)), "x_ema_8"), expected(frame, f))


def test_slope_needs_a_full_window(df, frame):
    fit = lambda w: np.polyfit(np.arange(4), w, 1)[0]
    same(result(win.with_slopes(df, S, "x", (4,)), "x_slope_4"), expected(frame, lambda v: v.shift(1).rolling(4).apply(fit, raw=True)))


def test_differences(df, frame):
    x = df.withColumns(win.differences(S, "x") | win.lags(S, "x", (1, 3)))
    same(result(x, "x_diff6"), expected(frame, lambda v: v.shift(1) - v.shift(7)))
    same(result(x, "x_second_deriv"), expected(frame, lambda v: v.shift(1) - 2 * v.shift(2) + v.shift(3)))
    same(result(x, "x_lag3"), expected(frame, lambda v: v.shift(3)))


def test_run_length_and_missing_run(spark):
    rows = [("a", k, v) for k, v in enumerate([1.0, 1.0, None, None, 2.0, 2.0, 2.0, 1.0])] + [("b", 0, 1.0), ("c", 0, None), ("c", 1, None), ("c", 2, 3.0)]
    df = spark.createDataFrame(rows, "s string, t int, x double")
    s = Series(("s",), ("t",))
    x = win.missing_run(win.run_length(df, s, "x"), s, "x").orderBy("s", "t").collect()
    assert [r["x_runlength"] for r in x] == [1, 2, 1, 1, 1, 2, 3, 1, 1, 1, 1, 1]
    assert [r["missing_run"] for r in x] == [0, 0, 1, 2, 0, 0, 0, 0, 0, 1, 2, 0]


def test_unique_count(df, frame):
    got = result(df.withColumn("n", win.unique_count(S, "x", 6)), "n")
    same(got, expected(frame, lambda v: v.shift(1).rolling(6, min_periods=1).apply(lambda w: len(set(w[~np.isnan(w)])), raw=True).fillna(0)))


def test_volatility_ratio_and_baseline(df, frame):
    def ratio(v):
        step = v.diff().abs()
        return step.rolling(6, min_periods=3).median() / (step.rolling(20, min_periods=5).median() + 1e-6)

    same(result(win.volatility_ratio(df, S, "x", 6, 20, 3, 5), "vol_ratio"), expected(frame, ratio))
    got = result(df.withColumn("b", win.baseline_residual(S, "x", 20, 5)), "b")
    same(got, expected(frame, lambda v: v - v.rolling(20, min_periods=5).median()))


def test_centred_fit(df, frame):
    def part(which):
        def f(v):
            i = pd.Series(np.arange(len(v)), index=v.index, dtype=float)
            o = dict(window=24, center=True, min_periods=8)
            cov = (i * v).rolling(**o).mean() - i.rolling(**o).mean() * v.rolling(**o).mean()
            vx = (i * i).rolling(**o).mean() - i.rolling(**o).mean() ** 2
            vy = v.rolling(**o).var()
            return {"span": (cov / vx.replace(0, np.nan) * 24).abs(), "flat": vy**0.5}[which]

        return f

    x = win.centred_fit(df, S, "x", 24)
    a, b = result(x, "x_ctr_span_24"), expected(frame, part("span"))
    keep = ~np.isnan(a) & ~np.isnan(b)
    assert keep.sum() > 100 and np.allclose(a[keep], b[keep], atol=1e-6)
    c, d = result(x, "x_ctr_flat_24"), expected(frame, part("flat"))
    keep = ~np.isnan(c) & ~np.isnan(d)
    assert np.allclose(c[keep], d[keep], atol=1e-5)
    r2 = result(x, "x_ctr_r2_24")
    assert np.nanmin(r2) >= 0 and np.nanmax(r2) <= 1


def test_percent_rank_averages_ties(spark):
    values = [3.0, 1.0, 3.0, 2.0, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = sorted(r[0] for r in df.select(win.percent_rank("x")).collect())
    assert got == sorted(pd.Series(values).rank(pct=True))


def test_features_are_causal_and_series_are_isolated(df):
    features = {**win.lags(S, "x"), **win.rolling(S, "x", (5,), ("mean", "median")), **win.residuals(S, "x", (5,))}
    past = lambda d: {(r["s"], r["i"]): (r["x_roll_mean_5"], r["x_roll_median_5"], r["x_lag2"]) for r in d.withColumns(features).collect()}
    whole = past(df)
    changed = past(df.withColumn("x", F.when((F.col("i") >= 30) | (F.col("s") == "b"), 99.0).otherwise(F.col("x"))))
    assert all(whole[k] == changed[k] for k in whole if k[0] != "b" and k[1] <= 30)


def test_sequences(spark):
    df = spark.createDataFrame([("a", k, None if k == 5 else float(k)) for k in range(20)], "s string, t int, x double")
    got = win.sequences(df, Series(("s",), ("t",)), ["x"], 4, 2).orderBy("t").collect()
    assert [r["t"] for r in got] == [3, 9, 11, 13, 15, 17, 19]
    assert got[0]["x_seq"] == [0.0, 1.0, 2.0, 3.0]
