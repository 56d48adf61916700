import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import order, splits, windows
from gaugeline.plans import models
from gaugeline.plans.tracking import Tracker
from gaugeline.sources import readers


def values(n=400):
    r = random.Random(4)
    return [None if i % 17 == 0 else r.choice([5.0, 5.0, 5.0, r.random() * 10, float(r.randint(-3, 3))]) for i in range(n)]


@pytest.mark.parametrize("slice_", [7, 100_000])
def test_percentiles_and_sums_of_all_rows(spark, slice_):
    x = values()
    known = np.array([v for v in x if v is not None])
    df = spark.createDataFrame([(v,) for v in x], "x double")
    row = order.percentiles(df, "x", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.951, "e": 1.0}, slice_).first()
    assert np.allclose(list(row), np.quantile(known, [0.0, 0.25, 0.5, 0.951, 1.0]))
    assert order.percentiles(df.limit(0), "x", {"a": 0.5}).first()["a"] is None
    g = df.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    for down in (False, True):
        got = {r["x"]: r["at"] for r in order.ahead(g, "x", {"at": "n"}, down, slice_).collect()}
        low = lambda v: float("-inf") if v is None else v
        assert got == {v: sum((low(w) > low(v)) if down else (low(w) < low(v)) for w in x) for v in set(x)}


def test_cuts_at_a_row_of_any_order(spark):
    r = random.Random(2)
    at = lambda k: dt.datetime(2024, 3, 9) + dt.timedelta(minutes=90 * k)
    rows = [(at(0 if i % 3 else i % 40), r.choice("abc") * r.randint(1, 9), i) for i in range(300)]
    df = spark.createDataFrame(rows, "t timestamp, s string, i int").withColumn("t", F.col("t").cast("timestamp_ntz"))
    for test in (0.2, 0.55, 1.0, 0.0):
        got = {x["i"] for x in splits.by_row_count(df, ["t", "s", "i"], test).filter("part = 'train'").collect()}
        assert got == {i for _, _, i in sorted(rows)[: int(300 * (1 - test))]}


def test_shares_are_average_ranks(spark):
    x = values(120)
    df = spark.createDataFrame(list(enumerate(x)), "i int, x double")
    known = [v for v in x if v is not None]
    want = {i: None if v is None else (sum(w < v for w in known) + (sum(w == v for w in known) + 1) / 2) / len(known) for i, v in enumerate(x)}
    got = {r["i"]: r["p"] for r in order.shares(df, "x", "p").collect()}
    assert all(got[i] is None if w is None else abs(got[i] - w) < 1e-12 for i, w in want.items())


def test_rows_that_repeat_have_ids_of_their_own(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 1, "y"), ("b", 2, "x"), (None, 2, "x")], "s string, k int, label string")
    ids = [r["row_id"] for r in readers.with_row_id(df, ["s", "k"]).collect()]
    assert len(set(ids)) == 5
    assert sorted(ids) == sorted(r["row_id"] for r in readers.with_row_id(df.repartition(3), ["s", "k"]).collect())


def test_a_model_for_each_of_too_many_groups_is_refused(spark):
    df = spark.range(models.MOST_GROUPS + 1).selectExpr("id AS g", "double(id) AS y", "double(id) AS x")
    with pytest.raises(ValueError, match="more than"):
        models.Grouped(["x"], "y", "g").fit(df)


def test_models_are_verified_when_they_are_loaded(spark, tmp_path):
    df = spark.range(60).selectExpr("double(id) AS x", "double(id * 2) AS y")
    made = models.Boosted(["x"], "y", params={"maxIter": 2}).fit(df)
    made.save(f"file://{tmp_path}/m")
    loaded = models.Boosted([], "y").load(f"file://{tmp_path}/m")
    assert loaded.features == ["x"] and loaded.predict(df).collect() == made.predict(df).collect()
    with pytest.raises(ValueError, match="holds"):
        models.Boosted([], "z").load(f"file://{tmp_path}/m")
    part = next((tmp_path / "m" / "models").rglob("part-*.parquet"))
    part.with_name(f".{part.name}.crc").unlink(missing_ok=True)
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(ValueError, match="changed"):
        models.Boosted([], "y").load(f"file://{tmp_path}/m")


def test_runs_are_started_finished_and_found(spark, tmp_path):
    t = Tracker(spark, f"file://{tmp_path}/runs")
    with pytest.raises(RuntimeError):
        t.finish("rmse", 1.0)
    a = t.start("forecast", "waves", "gbt", feature_names=["x", "y"], tags=["sea", "old"])
    with pytest.raises(RuntimeError):
        t.start("forecast", "waves", "gbt")
    assert t.finish("rmse", 0.7, user_note="fine")["feature_count"] == 2
    b = t.start("forecast", "waves", "gbt", tags=["sea"])
    t.finish("rmse", 0.5)
    assert a.endswith("_001") and b.endswith("_002")
    ids = lambda df: [r["experiment_id"] for r in df.collect()]
    assert ids(t.find(below=0.6)) == [b] and ids(t.find(metric="rmse", above=0.6, tags=("sea", "old"))) == [a]
    assert ids(t.best("rmse")) == [b] and t.load(a)["user_note"] == "fine"
    board = spark.read.option("header", True).csv(f"file://{tmp_path}/runs/leaderboard").collect()
    assert [r["Experiment"] for r in board] == [b, a]


def test_vectors_of_numpy_files(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([0.5, 1.5]))
    np.save(tmp_path / "b.npy", np.arange(3, dtype=np.float32))
    got = sorted(map(tuple, readers.npy(spark, f"file://{tmp_path}").collect()))
    assert got == [("a.npy", 0, 0.5), ("a.npy", 1, 1.5), ("b.npy", 0, 0.0), ("b.npy", 1, 1.0), ("b.npy", 2, 2.0)]


def test_ema_weighs_over_gaps(spark):
    x = values(80)
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(x)], "k string, i int, v double")
    got = {r["i"]: r["v_ema_5"] for r in windows.ema(df, windows.Series(("k",), ("i",)), "v", (5,)).collect()}
    top = below = 0.0
    for i, v in enumerate([None, *x[:-1]]):
        top, below = top * (1 - 2 / 6), below * (1 - 2 / 6)
        if v is not None:
            top, below = top + v, below + 1
        assert got[i] is None if below == 0 else abs(got[i] - top / below) < 1e-9
