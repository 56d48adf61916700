import math

import pytest
from pyspark.sql import functions as F

from gaugeline.plans import tasks
from gaugeline.plans.plugins import AnomalyFeatures, ProfileFeatures


def noisy(k, seed):
    return math.sin(k * 12.9898 + seed * 78.233) * 0.3


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("panel")
    rows = []
    for s, station in enumerate(("north", "south")):
        for k in range(400):
            for layer in (1, 2, 3):
                bad = k % 40 in (7, 8, 9) and layer == 2
                day, minute = divmod(k * 10, 1440)
                rows.append((f"2024-06-{day + 1:02d} {minute // 60:02d}:{minute % 60:02d}:00", station, layer, 15.0 + 3 * math.sin(k / 30) - layer + noisy(k, layer + s) + (6.0 if bad else 0.0), int(bad)))
    spark.createDataFrame(rows, "time string, station string, layer int, temp double, label int").coalesce(1).write.option("header", True).csv(f"{root}/train.csv")
    return root


def test_anomaly_task_finds_what_is_planted(spark, panel):
    task = tasks.create("anomaly_qc", spark, {"dataset": {"train": f"file://{panel}/train.csv"}, "feature": {"presets": {"light": 1.0}, "windows": (12,)}, "model": {"maxIter": 8}, "experiments": f"file://{panel}/runs"})
    out = task.run()
    assert task.metrics["roc_auc"] > 0.95 and task.metrics["f1"] > 0.6
    assert out.count() == 2400 and 0.01 < out.agg(F.avg("label")).first()[0] < 0.05


def test_reconstruction_beats_the_straight_line(spark, tmp_path):
    rows = []
    for k in range(300):
        month, day = 6 + k // 100, k % 28 + 1
        top, bottom = 22 + 3 * math.sin(k / 20) + noisy(k, 1), 12 + 2 * math.cos(k / 35) + noisy(k, 2)
        t = f"2024-{month:02d}-{day:02d} {k % 24:02d}:{k % 6 * 10:02d}:00"
        for layer, depth in ((1, 4.18), (2, 6.87), (3, 9.83), (4, 14.87), (5, 19.15), (6, 30.21)):
            r = min((depth - 4.18) / 14.97, 1.0)
            v = top + r * (bottom - top) - 2.0 * r * (1 - r) * 4 if layer < 6 else bottom - 2 + noisy(k, 3)
            if not (layer == 5 and k % 10 == 3):
                rows.append((t, "north", layer, v, depth))
    df = spark.createDataFrame(rows, "time string, station string, layer int, temp double, depth double").dropDuplicates(["time", "layer"])
    df.write.parquet(f"{tmp_path}/train.parquet")
    task = tasks.create("profile_reconstruction", spark, {"dataset": {"train": f"file://{tmp_path}/train.parquet"}, "feature": {"preset": "r2"}, "model": {"maxIter": 8}, "model_mode": "unified"})
    out = task.run()
    assert task.metrics["rmse"] < 0.5 * task.metrics["linear_rmse"]
    assert out.filter("temp IS NULL").count() == 0


def test_forecast_task(spark, tmp_path):
    rows = [("a", f"2024-01-{k // 72 + 1:02d} {k % 72 // 3:02d}:{k % 3 * 20:02d}:00", 1.5 + math.sin(k / 20) + 0.1 * noisy(k, 1)) for k in range(72 * 28)]
    spark.createDataFrame(rows, "station string, time string, hs double").withColumn("time", F.col("time").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/wave.parquet")
    task = tasks.create("wave_forecast", spark, {"dataset": {"wave": f"file://{tmp_path}/wave.parquet"}, "leads": [3, 6], "model": {"maxIter": 8}, "validation": {"dense_stride_steps": 6}})
    scores = task.run()
    assert task.metrics["rmse"] < task.metrics["persistence_rmse"]
    assert scores.count() == 4


def test_presets_and_names(spark):
    with pytest.raises(KeyError):
        tasks.create("nothing", spark, {})
    with pytest.raises(ValueError):
        AnomalyFeatures(["x"], preset="odd")
    with pytest.raises(ValueError):
        ProfileFeatures("odd")
    df = spark.createDataFrame([(f"2024-0{1 + k % 2}-01 {k % 24:02d}:00:00", "s", k % 8 + 1, float(k), k) for k in range(96)], "time string, station string, layer int, temp double, row_id int").withColumn("time", F.col("time").cast("timestamp_ntz"))
    widths = [len(ProfileFeatures(p, depth=None, least=1).fit(df).transform(df).columns) for p in ("light", "r1", "r2", "r3", "full")]
    assert widths == sorted(widths) and len(set(widths)) == 5
    a = AnomalyFeatures(["temp"], ("station", "layer"), preset="full", windows=(4,), offset_keys=["layer"]).fit(df).transform(df)
    assert a.count() == 96 and {"temp_ema_4", "temp_slope_4", "temp_roll_mad_4", "temp_uniq_count_4", "temp_runlength", "temp_robust_zscore", "temp_dev_layer_mean", "sin_month"} <= set(a.columns)
    assert "cos_dow" in a.columns or "sin_hour" in a.columns
