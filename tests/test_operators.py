import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.functions import scalars as sc
from gaugeline.operators import grid as gr
from gaugeline.operators import metrics as me
from gaugeline.operators import profile as pr
from gaugeline.operators import quality as qa
from gaugeline.operators import splits as sp
from gaugeline.operators import statistics as st
from gaugeline.operators.windows import Series
from gaugeline.plans import tracking
from gaugeline.sources import readers, writers


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, 0.0, "a"), (None, 2.0, None), (float("nan"), 4.0, "b+c")], "x double, y double, k string")
    assert [r[0] for r in sc.nan_to_null(df).select("x").collect()] == [1.0, None, None]
    assert df.select(sc.ratio(F.col("y"), F.lit(0.0))).first()[0] is None
    clipped = sc.nan_to_null(df).select(sc.clip(F.col("x"), 2.0, 3.0), sc.clip(F.col("y"), 1.0, 3.0)).collect()
    assert [tuple(r) for r in clipped] == [(2.0, 1.0), (None, 2.0), (None, 3.0)]
    assert [r[0] for r in df.select(sc.series_key("k", "y")).collect()] == ["a_0.0", None, "b+c_4.0"]
    assert [r[0] for r in df.select(sc.coded(sc.first_part(F.col("k")), {"b": 3})).collect()] == [0, 0, 3]
    wall = spark.createDataFrame([("2024-01-01 00:30:00+09:00",), ("2024-01-01T05:00:00",), ("what",)], "t string").select(F.hour(sc.wall_clock(F.col("t"))))
    assert [r[0] for r in wall.collect()] == [0, 5, None]
    rate = spark.range(20000).select(F.avg((sc.hash_uniform(1, "id") < 0.3).cast("double"))).first()[0]
    assert abs(rate - 0.3) < 0.02


def test_profiles(spark):
    rows = [(1, 1, 20.0, 0), (1, 1, 99.0, 5), (1, 5, 10.0, 1), (1, 6, 8.0, 2), (2, 1, 18.0, 3), (2, 8, 4.0, 4), (3, 6, 7.0, 6), (4, 2, 9.0, 7), (4, 4, 11.0, 8), (5, 3, None, 9)]
    df = spark.createDataFrame(rows, "k int, layer int, temp double, row_id int")
    p = pr.Profile(("k",), order=("row_id",))
    b = {r["k"]: r for r in pr.boundaries(df, p).collect()}
    assert set(b) == {1, 2} and (b[1]["surf"], b[1]["bot"], b[1]["deep_6"]) == (20.0, 10.0, 8.0) and b[2]["bot"] is None
    ratios = pr.shape_ratios(df, p, 1)
    share = (19.15 - 4.18) / (30.21 - 4.18)
    assert ratios.keys() == {6} and ratios[6] == pytest.approx((10 - (20 - share * 12)) / 12)
    rebuilt, seen = pr.rebuilt_bottom(p, {8: 0.1}, 15.0)
    got = {r["k"]: (r["v"], r["o"]) for r in pr.boundaries(df, p).select("k", rebuilt.alias("v"), seen.alias("o")).collect()}
    assert got[1] == (10.0, 1) and got[2][0] == pytest.approx(18 - (19.15 - 4.18) / (49.35 - 4.18) * 14 + 0.1 * 14)
    gaps = {(r["k"], r["layer"]): (r["grad_upper"], r["grad_lower"]) for r in pr.neighbour_gaps(df.drop("row_id"), p).distinct().collect()}
    assert gaps[4, 2] == (None, None) and gaps[4, 4] == (None, None)  # layer 3 lies between, though missing here
    assert gaps[1, 6] == (-2.0, None)
    wide = pr.wide(df, p, [1, 5, 6])
    assert {(r["k"], r["layer"], r["temp"]) for r in pr.long(wide, p, [1, 5, 6]).collect()} == {(1, 1, 20.0), (1, 5, 10.0), (1, 6, 8.0), (2, 1, 18.0), (3, 6, 7.0)}
    station = df.withColumn("s", F.lit("x"))
    gap = {r["k"]: r["boundary_gap"] for r in pr.boundary_gap(station, p, 5, "s", "k").collect()}
    assert gap == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4}


def test_greedy_separation(spark):
    df = spark.createDataFrame([("a", m) for m in (0, 10, 50, 78, 90, 160)] + [("b", 5)], "station string, minute long")
    assert sorted(tuple(r) for r in gr.separated(df, ["station"], "minute", 78).collect()) == [("a", 0), ("a", 78), ("a", 160), ("b", 5)]
    r = np.random.default_rng(0)
    at = sorted(set(r.integers(0, 5000, 300).tolist()))
    want, last = [], None
    for m in at:
        if last is None or m - last >= 33:
            want.append(m)
            last = m
    got = gr.separated(spark.createDataFrame([("a", m) for m in at], "station string, minute long"), ["station"], "minute", 33)
    assert sorted(x["minute"] for x in got.collect()) == want


def test_purge_is_closed_and_by_station(spark):
    t = spark.createDataFrame([("a", m) for m in range(0, 400, 10)] + [("b", 100)], "station string, minute long")
    v = spark.createDataFrame([("a", 100), ("a", 250)], "station string, minute long")
    got = {tuple(r) for r in gr.purged(t, v, before=20, after=10, buffer=5).collect()}
    want = {(s, m) for s, m in map(tuple, t.collect()) if not any(s == a and m - 20 <= x + 15 and m + 10 >= x - 20 for a, x in map(tuple, v.collect()))}
    assert got == want and ("b", 100) in got


def test_contexts_and_range_features(spark):
    g = spark.createDataFrame([("a", 10 * k, None if k % 2 else float(k % 17), float(k)) for k in range(1000)], "station string, minute long, hs double, wspd double")
    a = spark.createDataFrame([("a", 2880), ("a", 5000), ("a", 100)], "station string, minute long")
    c = gr.contexts(a, g)
    n = {r["ref_minute"]: r["n"] for r in c.groupBy("ref_minute").agg(F.count("*").alias("n")).collect()}
    assert n == {2880: 289, 5000: 289, 100: 11}
    f = gr.range_features(c, ["station", "ref_minute"], gust=None, height=None).filter("ref_minute = 5000").first()
    pdf = g.toPandas().set_index("minute")
    h = pdf.loc[5000 - 180 : 5000, "hs"].dropna()
    assert f["hs_mean_3h"] == pytest.approx(h.mean()) and f["hs_std_3h"] == pytest.approx(h.std()) and f["hs_diff_3h"] == pytest.approx(f["latest_hs"] - h.iloc[0])
    assert f["hs_slope_3h"] == pytest.approx(np.polyfit((h.index - 5000) / 60.0, h, 1)[0])
    assert f["obs_count_48h"] == 145 and f["missing_ratio_48h"] == pytest.approx(1 - 145 / 289)
    empty = gr.range_features(c.withColumn("hs", F.lit(None).cast("double")), ["ref_minute"], gust=None, height=None).first()
    assert (empty["latest_hs"], empty["latest_hs_age"], empty["hs_mean_6h"], empty["hs_std_6h"]) == (1.5, 9999, 1.5, 0.0)


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (1, 0.05), (0, 0.05)], "y int, p double")
    r = me.ranking(df, "y", "p").first()
    pairs = [(a, b) for a in df.filter("y = 1").collect() for b in df.filter("y = 0").collect()]
    assert r["roc_auc"] == pytest.approx(sum((a["p"] > b["p"]) + 0.5 * (a["p"] == b["p"]) for a, b in pairs) / 9)
    assert me.ranking(df.filter("y = 1"), "y", "p").first()["roc_auc"] is None
    c = me.classification(df.withColumn("z", (F.col("p") >= 0.8).cast("int")), "y", "z").first()
    assert c["precision"] == pytest.approx(2 / 3) and c["recall"] == pytest.approx(2 / 3) and c["accuracy"] == pytest.approx(4 / 6)
    none = me.classification(df.withColumn("z", F.lit(0)), "y", "z").first()
    assert none["f1"] == 0.0 and none["precision"] == 0.0
    one = spark.createDataFrame([(1.0, 2.0)], "t double, q double")
    assert tuple(me.regression(one, "t", "q").first()) == (1, 1.0, 1.0, 1.0)
    assert tuple(me.regression(one.limit(0), "t", "q").first()) == (0, 0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        me.blended({"a": -1.0})
    filled = me.filled(spark.createDataFrame([(None,), (40.0,)], "q double"), "q", 15.0, 0.0, 30.0)
    assert sorted(x[0] for x in filled.collect()) == [30.0, 30.0]


def test_splits(spark):
    df = spark.createDataFrame([(int(k // 3), int(k)) for k in range(101)], "t int, i int")
    got = {r["i"] for r in sp.by_row_count(df, ["t", "i"], 0.25, slices=7).filter("part = 'valid'").collect()}
    assert got == set(range(75, 101))
    tied = spark.createDataFrame([(5, int(k)) for k in range(20)], "t int, i int")
    assert sp.by_row_count(tied, ["t", "i"]).filter("part = 'valid'").count() == 4
    assert sp.by_row_count(df.limit(0), ["t", "i"]).count() == 0
    masked = sp.masked(df.withColumn("x", F.lit(1.0)), F.when(F.col("i") == 1, F.lit(None).cast("boolean")).otherwise(F.col("i") < 3), ["x"], "x")
    assert masked.filter("x IS NULL").count() == 2 and masked.filter("truth = 1").count() == 2
    rich = sp.rich_weights(spark.createDataFrame([(1, 6), (1, 7), (1, 8), (2, 6)], "t int, l int"), "t", "l", [6, 7, 8])
    assert rich.agg(F.avg("weight")).first()[0] == pytest.approx(1.0)


def test_fitted_statistics(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0)], "k string, x double")
    const = st.robust(spark.createDataFrame([(2.0,), (2.0,)], "x double"), ["x"]).first()
    assert const["x_mad"] == st.FLOOR and const["x_std"] == st.FLOOR
    values = st.imputation(train, ["x"], ["k"])
    assert values == {"x": 3.0, "k": "a"}
    assert st.flagged_columns(train, ["k", "x"]) == ["k", "x"]
    off = {r["k"]: r["x_dev_k_mean"] for r in st.offsets(train, spark.createDataFrame([("a", 4.0), ("z", 4.0)], "k string, x double"), "x", "k").collect()}
    assert off == {"a": 2.0, "z": 1.0}
    w = st.balanced_weights(spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int"), "y")
    assert {(r["y"], round(r["weight"], 6)) for r in w.collect()} == {(0, round(4 / 6, 6)), (1, 2.0)}


def test_quality(spark):
    df = spark.createDataFrame([(1, 5, None), (2, None, "x"), (2, 9, "y")], "k int, v int, s string")
    with pytest.raises(ValueError, match="missing"):
        qa.require(df, ["nope"])
    assert {(r["column"], r["nulls"]) for r in qa.null_counts(df).collect()} == {("k", 0), ("v", 1), ("s", 1)}
    assert {(r["k"], r["rule"]) for r in qa.violations(df, {"v": F.col("v") < 8}, ["k"]).collect()} == {(2, "v")}
    assert {(r["k"], r["problem"]) for r in qa.one_to_one(df, df.filter("k = 1"), ["k"]).collect()} == {(2, "only_left")}


def test_sources_and_sinks(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = spark.createDataFrame([(3, 1.5, "c"), (1, float("nan"), "a"), (2, 2.5, None)], "k int, x double, s string")
    writers.delivery(df, f"{root}/out.csv", ["k", "x"], ["k"])
    back = readers.read(spark, f"{root}/out.csv", "k int, x double")
    assert [(r["k"], r["x"]) for r in back.collect()] == [(1, None), (2, 2.5), (3, 1.5)]
    writers.exchange(df, f"{root}/x.parquet", ["k", "x"])
    assert readers.read(spark, f"{root}/x.parquet").filter("x IS NULL").count() == 1
    assert readers.read(spark, f"{root}/none.csv", required=False) is None
    with pytest.raises(FileNotFoundError):
        readers.read(spark, f"{root}/none.csv")
    assert readers.times(spark, "2024-01-01 00:00:00", "2024-01-02 00:00:00").count() == 145
    with pytest.raises(ValueError, match="no prediction"):
        writers.keyed(df.select("k", "x"), df.filter("k < 3").select("k", "x"), ["k"], "x")
    with pytest.raises(ValueError, match="more than once"):
        writers.keyed(df.union(df).select("k", "x"), df.select("k", "x"), ["k"], "x")
    writers.text(spark, f"{root}/m/a.txt", "hello")
    hashes = {r["name"]: r["sha256"] for r in readers.file_hashes(spark, f"{root}/m", "*.txt").collect()}
    assert readers.verified(spark, f"{root}/m", {**hashes, "b.txt": "0"}) == ["b.txt"]
    assert "| k | x | s |" in writers.report("t", {"all": df})


def test_tracking(spark, tmp_path):
    t = tracking.Tracker(spark, f"file://{tmp_path}/runs")
    assert t.all().count() == 0
    a = t.save({"task_type": "x", "model": "m", "metric": {"metric_name": "rmse", "score": 2.0}, "config": {"a": "1"}, "metrics": {"rmse": 2.0}})
    b = t.save({"task_type": "x", "model": "n", "metric": {"metric_name": "rmse", "score": 1.0}, "config": {"a": "2"}, "metrics": {"rmse": 1.0}})
    c = t.save({"task_type": "y", "model": "m", "metric": {"metric_name": "f1", "score": 0.5}})
    (tmp_path / "runs" / "bad").mkdir()
    (tmp_path / "runs" / "bad" / "metadata.json").write_text("{not json")
    assert a.endswith("_001") and b.endswith("_002") and t.all().count() == 3
    assert {r["experiment_id"] for r in t.best().collect()} == {b, c}
    assert t.latest().first()["experiment_id"] == c and t.load(a)["metric"]["score"] == 2.0
    assert {(r["key"], r["left"], r["right"]) for r in t.compare(a, b).collect()} == {("a", "1", "2"), ("rmse", "2.0", "1.0")}
    assert {(r["Experiment"], r["Rank"]) for r in t.leaderboard().collect()} == {(b, 1), (a, 2), (c, 1)}
    assert json.loads((tmp_path / "runs" / a / "metadata.json").read_text())["model"] == "m"
