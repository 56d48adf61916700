"""Causal statistics over streams: event-time windows, sessions, and runs kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(df: DataFrame, time: str, keys: list[str], value: str, size: str = "1 hour", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Statistics of tumbling or sliding windows; works on a table as well."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    x = df.withWatermark(time, late) if df.isStreaming else df
    g = x.groupBy(w.alias("w"), *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_samp(value).alias("std"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "mean", "min", "max", "std")


def sessions(df: DataFrame, time: str, keys: list[str], gap: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    x = df.withWatermark(time, late) if df.isStreaming else df
    g = x.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def smoothed(df: DataFrame, key: str, time: str, value: str, span: int = 12) -> DataFrame:
    """Per key and row: how many equal values in a row end there, and the exponentially weighted mean before it.

    The state of a key is a handful of numbers.  Rows of a micro-batch are taken in order of time;
    rows that arrive in a later batch than their successors count where they arrive.
    """
    keep = 1 - 2 / (span + 1)

    def step(k, frames, state: GroupState):
        import pandas as pd

        last, run, top, below = state.get if state.exists else (None, 0, 0.0, 0.0)
        out = []
        for frame in frames:
            for t, v in frame.sort_values(time)[[time, value]].itertuples(index=False):
                missing = v is None or v != v
                run = run + 1 if not missing and last is not None and v == last else 1
                out.append((k[0], t, None if missing else float(v), run, top / below if below > 0 else None))
                top, below = top * keep, below * keep
                if not missing:
                    top, below = top + v, below + 1.0
                last = None if missing else float(v)
        state.update((last, run, top, below))
        yield pd.DataFrame(out, columns=["key", "time", "value", "run_length", "ema"])

    return df.select(F.col(key).cast("string").alias("key"), F.col(time).alias("time_"), F.col(value).cast("double").alias("value_")).withColumnsRenamed({"time_": time, "value_": value} if time != "key" else {}).groupBy("key").applyInPandasWithState(
        step, "key string, time timestamp, value double, run_length long, ema double", "last double, run long, top double, below double", "append", GroupStateTimeout.NoTimeout
    )
