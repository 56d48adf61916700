import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from gaugeline.streaming.windows import smoothed, windowed


def source(spark, tmp_path):
    rows = [(f"k{i % 3}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), None if i % 11 == 0 else float(i // 6)) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, value double").orderBy("ts")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    return df, spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")


def test_windows_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    df, stream = source(spark, tmp_path)
    q = windowed(stream, "ts", ["key"], "value").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    low = lambda d: sorted(map(str, d.select("start", "key", "n", F.round("mean", 6)).collect()))
    assert low(spark.table("w")) == low(windowed(df, "ts", ["key"], "value"))


def test_state_keeps_runs_and_means(spark, tmp_path):
    df, stream = source(spark, tmp_path)
    q = smoothed(stream, "key", "ts", "value", 12).writeStream.outputMode("append").format("memory").queryName("s").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("s").toPandas().sort_values(["key", "time"])
    want = df.toPandas().sort_values(["key", "ts"])
    ema = want.groupby("key")["value"].apply(lambda v: v.shift(1).ewm(span=12, adjust=True, ignore_na=False).mean()).to_numpy()
    pd.testing.assert_series_equal(pd.Series(got["ema"].to_numpy(dtype=float)), pd.Series(ema), check_names=False)
    for k, g in got.groupby("key"):
        run, last = 0, None
        for v, r in zip(g["value"], g["run_length"]):
            run = run + 1 if last is not None and v == last and v == v else 1
            last = v if v == v else None
            assert r == run
