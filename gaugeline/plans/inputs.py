"""The driver's tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid
from ..operators.profile import Profile
from ..operators.windows import Series


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Readings: every seventh value is missing; ``flat`` repeats often.
READINGS_SQL = """r AS (SELECT event_id, user_id, event_type, ts, value, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE floor(value / 25) END AS flat,
  CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute FROM events)"""


def readings(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value")
    known = F.col("event_id") % 7 != 0
    return x.withColumns({"v": F.when(known, F.col("value")), "flat": F.when(known, F.floor(F.col("value") / 25).cast("double")), "minute": grid.minute("ts")})


BY_USER = Series(("user_id",), ("ts", "event_id"))
BY_TYPE = Series(("event_type",), ("ts", "event_id"))

#: Profiles: an order is a station and time, a line number a layer.
PROFILES_SQL = "p AS (SELECT l_orderkey, l_linenumber AS layer, l_quantity AS temp, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM lineitem)"
PROFILE = Profile(("l_orderkey",), "layer", "temp", ("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"), deep=(6, 7))


def profiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("layer"), F.col("l_quantity").alias("temp"), "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


#: Two irregular series on an hourly grid: three stations, views as waves and purchases as wind.
GRID_SQL = """b AS (SELECT CAST(user_id % 3 AS INTEGER) AS station, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 60 AS minute, event_type, value, event_id FROM events),
hs AS (SELECT station, minute, min_by(value, event_id) AS hs FROM b WHERE event_type = 'view' GROUP BY ALL),
wi AS (SELECT station, minute, min_by(value, event_id) AS wspd FROM b WHERE event_type = 'purchase' GROUP BY ALL),
ends AS (SELECT min(minute) AS a, max(minute) AS z FROM b),
g AS (SELECT s.station, m.minute, hs.hs, wi.wspd FROM (SELECT DISTINCT station FROM b) s, (SELECT unnest(generate_series(a, z, 60)) AS minute FROM ends) m
      LEFT JOIN hs ON hs.station = s.station AND hs.minute = m.minute LEFT JOIN wi ON wi.station = s.station AND wi.minute = m.minute)"""
BY_STATION = Series(("station",), ("minute",))


def gridded(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select((F.col("user_id") % 3).cast("int").alias("station"), (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) * 60).cast("long").alias("minute"), "event_type", "value", "event_id")
    ends = x.agg(F.min("minute").alias("a"), F.max("minute").alias("z"))
    stations = x.select("station").distinct()
    lines = stations.crossJoin(F.broadcast(ends))  # one row of ends
    full = lines.withColumn("minute", F.explode(F.sequence("a", "z", F.lit(60).cast("long")))).drop("a", "z")
    one = lambda kind, name: grid.unique_times(x.filter(F.col("event_type") == kind).withColumnRenamed("value", name), [name], ["event_id"])
    return grid.aligned(full, one("view", "hs"), one("purchase", "wspd"))


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
