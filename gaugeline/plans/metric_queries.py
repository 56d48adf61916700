"""Queries that score, split, check and summarize."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as me
from ..operators import quality as qa
from ..operators import splits as sp
from . import tracking
from .inputs import READINGS_SQL, readings, rounded, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: Scores of labelled documents: short ones score high.
SCORES_SQL = "s AS (SELECT l.doc_id, l.quality AS y, round(1000.0::DOUBLE / (n_chars + 1), 4) AS p FROM labels l JOIN documents d USING (doc_id))"


def scores(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return x.select("doc_id", F.col("quality").alias("y"), F.round(1000.0 / (F.col("n_chars") + 1), 4).alias("p"))


FLAG_SQL = SCORES_SQL + ", t AS (SELECT quantile_cont(p, 1.0 - 0.3) AS thr FROM s), f AS (SELECT doc_id, y, p, CASE WHEN p >= thr THEN 1 ELSE 0 END AS pred FROM s, t)"


@query("quantile_threshold", f"WITH {FLAG_SQL} SELECT doc_id, pred FROM f")
def quantile_threshold(spark: SparkSession, d: str) -> DataFrame:
    return me.flagged(scores(spark, d), "p", 0.3).select("doc_id", "pred")


@query("class_metrics", f"""WITH {FLAG_SQL}, c AS (SELECT count(*) FILTER (y = 1 AND pred = 1)::DOUBLE AS tp, count(*) FILTER (y = 0 AND pred = 1)::DOUBLE AS fp, count(*) FILTER (y = 1 AND pred = 0)::DOUBLE AS fn, count(*) FILTER (y = 0 AND pred = 0)::DOUBLE AS tn FROM f)
SELECT round(coalesce(tp / nullif(tp + fp, 0), 0), 8) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 8) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 8) AS f1,
round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 8) AS macro_f1, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 8) AS accuracy FROM c""")
def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(me.classification(me.flagged(scores(spark, d), "p", 0.3), "y", "pred"))


@query("confusion_matrix", f"WITH {FLAG_SQL} SELECT y, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1 FROM f GROUP BY 1")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return me.confusion(me.flagged(scores(spark, d), "p", 0.3), "y", "pred")


@query("roc_pr_auc", f"""WITH {SCORES_SQL}, r AS (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS k FROM s),
g AS (SELECT p, count(*) FILTER (y = 1)::DOUBLE AS a, count(*)::DOUBLE AS n FROM s GROUP BY 1), c AS (SELECT a, sum(a) OVER w AS ca, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY p DESC)), m AS (SELECT count(*) FILTER (y = 1)::DOUBLE AS p1, count(*) FILTER (y = 0)::DOUBLE AS p0 FROM s)
SELECT (SELECT round((sum(k) FILTER (y = 1) - any_value(p1) * (any_value(p1) + 1) / 2) / (any_value(p1) * any_value(p0)), 8) FROM r, m) AS roc_auc, (SELECT round(sum(a * ca / cn) / any_value(p1), 8) FROM c, m) AS average_precision""")
def roc_pr_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(me.ranking(scores(spark, d), "y", "p"))


#: Forecasts: an order's price by its priority's mean; persistence is a constant.
FORECAST_SQL = """k AS (SELECT o_orderkey, o_totalprice AS y, o_orderpriority, o_orderstatus, month(o_orderdate) % 6 AS lead_h FROM orders), m AS (SELECT o_orderpriority, avg(y) AS p FROM k GROUP BY 1),
x AS (SELECT o_orderkey, y, p, 150000.0::DOUBLE AS b, CAST(lead_h AS INTEGER) AS lead_h, o_orderstatus AS station FROM k JOIN m USING (o_orderpriority))"""


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"), "o_orderpriority", F.col("o_orderstatus").alias("station"), (F.month("o_orderdate") % 6).alias("lead_h"))
    means = k.groupBy("o_orderpriority").agg(F.avg("y").alias("p"))
    return k.join(means, "o_orderpriority").withColumn("b", F.lit(150000.0))


@query("reg_metrics", f"""WITH {FORECAST_SQL} SELECT lead_h, count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)), 6) AS r2 FROM x GROUP BY 1""")
def reg_metrics(spark: SparkSession, d: str) -> DataFrame:
    x = me.regression(forecasts(spark, d), "y", "p", ["lead_h"])
    return x.select("lead_h", "n", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


@query("forecast_metrics_gsets", f"""WITH {FORECAST_SQL}, g AS (SELECT lead_h, station, sqrt(avg((y - p) * (y - p))) AS r, sqrt(avg((y - b) * (y - b))) AS q, count(*) AS n FROM x GROUP BY GROUPING SETS ((), (lead_h), (station)))
SELECT coalesce(CAST(lead_h AS VARCHAR), 'all') AS lead_h, coalesce(station, 'all') AS station, round(r, 4) AS rmse, round(q, 4) AS persistence_rmse, n, round((q - r) / greatest(q, 1e-6) * 100, 6) AS improvement_pct FROM g""")
def forecast_metrics_gsets(spark: SparkSession, d: str) -> DataFrame:
    x = me.forecast(forecasts(spark, d), "y", "p", "b")
    return x.select(F.coalesce(F.col("lead_h").cast("string"), F.lit("all")).alias("lead_h"), F.coalesce("station", F.lit("all")).alias("station"), F.round("rmse", 4).alias("rmse"), F.round("persistence_rmse", 4).alias("persistence_rmse"), "n", F.round("improvement_pct", 6).alias("improvement_pct"))


@query("prediction_fill", f"""WITH {READINGS_SQL}, m AS (SELECT avg(v) AS m FROM r) SELECT event_id, round(CASE WHEN coalesce(v, m, 15) IS NOT NULL THEN least(30, greatest(0, coalesce(v, m, 15))) END, 8) AS v FROM r, m""")
def prediction_fill(spark: SparkSession, d: str) -> DataFrame:
    return rounded(me.filled(readings(spark, d).select("event_id", "v"), "v", 15.0, 0.0, 30.0))


@query("weighted_blend", f"WITH {READINGS_SQL} SELECT event_id, round(value * 0.75::DOUBLE + coalesce(flat, 0) * 0.25::DOUBLE, 8) AS blended FROM r")
def weighted_blend(spark: SparkSession, d: str) -> DataFrame:
    x = readings(spark, d).withColumn("flat", F.coalesce("flat", F.lit(0.0)))
    return rounded(x.select("event_id", me.blended({"value": 3.0, "flat": 1.0}).alias("blended")))


@query("reconcile_diff", """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 10 <> 1), b AS (SELECT o_orderkey AS k, o_totalprice + CASE WHEN o_orderkey % 5 = 0 THEN 0.5 ELSE 0 END AS v FROM orders WHERE o_orderkey % 10 <> 2), x AS (SELECT a.k AS ka, b.k AS kb, abs(a.v - b.v) AS d FROM a FULL JOIN b ON a.k = b.k)
SELECT count(*) FILTER (kb IS NULL) AS only_left, count(*) FILTER (ka IS NULL) AS only_right, count(*) FILTER (d > 0.01) AS differing, round(max(d), 6) AS max_abs_diff, round(sqrt(avg(d * d)), 6) AS rms_diff FROM x""")
def reconcile_diff(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = o.filter("k % 10 <> 2").withColumn("v", F.col("v") + F.when(F.col("k") % 5 == 0, 0.5).otherwise(0.0))
    return rounded(me.reconciled(o.filter("k % 10 <> 1"), b, ["k"], "v", 0.01), 6)


@query("split_rowcount", "WITH n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS i, count(*) OVER () AS c FROM events) SELECT event_id, CASE WHEN i <= CAST(floor(c * (1 - 0.2)) AS BIGINT) THEN 'train' ELSE 'valid' END AS part FROM n")
def split_rowcount(spark: SparkSession, d: str) -> DataFrame:
    return sp.by_row_count(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "part")


@query("split_distinct_time", "WITH t AS (SELECT o_orderdate AS d, row_number() OVER (ORDER BY o_orderdate) AS i, count(*) OVER () AS c FROM (SELECT DISTINCT o_orderdate FROM orders)), k AS (SELECT d AS cut FROM t WHERE i = CAST(floor(c * (1 - 0.2)) AS BIGINT) + 1) SELECT o_orderkey, CASE WHEN o_orderdate < cut THEN 'train' ELSE 'valid' END AS part FROM orders, k")
def split_distinct_time(spark: SparkSession, d: str) -> DataFrame:
    return sp.by_distinct_time(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").select("o_orderkey", "part")


@query("season_slices", """WITH w(name, a, z) AS (VALUES ('one', TIMESTAMP '1994-01-01', TIMESTAMP '1994-03-31'), ('two', TIMESTAMP '1996-07-01', TIMESTAMP '1996-09-30'), ('none', TIMESTAMP '1960-01-01', TIMESTAMP '1961-01-01')),
x AS (SELECT o_orderkey, name, o_orderstatus FROM orders JOIN w ON o_orderdate BETWEEN a AND z), k AS (SELECT name FROM x GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'F') > 5) SELECT o_orderkey, name AS "window" FROM x WHERE name IN (SELECT name FROM k)""")
def season_slices(spark: SparkSession, d: str) -> DataFrame:
    windows = [("one", "1994-01-01", "1994-03-31"), ("two", "1996-07-01", "1996-09-30"), ("none", "1960-01-01", "1961-01-01")]
    return sp.season_slices(table(spark, d, "orders"), "o_orderdate", windows, 5, F.col("o_orderstatus") == "F").select("o_orderkey", "window")


@query("quality_checks", """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, unnest(list_filter([CASE WHEN NOT (l_quantity BETWEEN 2 AND 49) THEN 'quantity' END, CASE WHEN NOT (l_discount <= 0.09) THEN 'discount' END, CASE WHEN NOT (l_returnflag IN ('A', 'N')) THEN 'flag' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem) SELECT rule, count(*) AS n FROM v GROUP BY 1""")
def quality_checks(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    qa.require(x, ["l_orderkey", "l_quantity"], "lineitem", filled=True)
    rules = {"quantity": F.col("l_quantity").between(2, 49), "discount": F.col("l_discount") <= 0.09, "flag": F.col("l_returnflag").isin("A", "N")}
    return qa.violations(x, rules, ["l_orderkey", "l_linenumber"]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("null_counts", f"WITH {READINGS_SQL} SELECT 'v' AS \"column\", count(*) FILTER (v IS NULL) AS nulls FROM r UNION ALL SELECT 'flat', count(*) FILTER (flat IS NULL) FROM r UNION ALL SELECT 'value', count(*) FILTER (value IS NULL) FROM r")
def null_counts(spark: SparkSession, d: str) -> DataFrame:
    return qa.null_counts(readings(spark, d), ["v", "flat", "value"])


@query("group_sizes", "SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1 HAVING n <> 10 OR first <> 0 OR last <> 0")
def group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return qa.group_sizes(table(spark, d, "orders"), ["o_custkey"], 10, "o_orderkey", 0, 0)


@query("one_to_one", "WITH a AS (SELECT o_custkey AS k, count(*) AS a FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, 1 AS b FROM customer) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a IS NULL THEN 'only_right' WHEN b IS NULL THEN 'only_left' ELSE 'left_repeated' END AS problem FROM a FULL JOIN b ON a.k = b.k WHERE a IS NULL OR b IS NULL OR a > 1")
def one_to_one(spark: SparkSession, d: str) -> DataFrame:
    return qa.one_to_one(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k")), ["k"])


@query("time_order", "WITH x AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY value, event_id) AS b FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (ts IS NULL) AS unparsed, count(*) FILTER (ts < b) AS steps_back FROM x GROUP BY 1")
def time_order(spark: SparkSession, d: str) -> DataFrame:
    return qa.time_order(table(spark, d, "events"), ["user_id"], ["value", "event_id"], "ts")


@query("eda_summary", f"WITH {READINGS_SQL} SELECT event_type, 'v' AS \"column\", count(v) AS n, round(avg(v), 8) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, max(v) AS max FROM r GROUP BY 1")
def eda_summary(spark: SparkSession, d: str) -> DataFrame:
    x = qa.summary(readings(spark, d), ["v"], ["event_type"])
    return x.select("event_type", "column", "n", F.round("mean", 8).alias("mean"), F.round("std", 6).alias("std"), "min", *[F.round(q, 6).alias(q) for q in ("q25", "q50", "q75")], "max")


@query("frequencies", "SELECT 'event_type' AS \"column\", event_type AS value, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY user_id")
def frequencies(spark: SparkSession, d: str) -> DataFrame:
    return qa.frequencies(table(spark, d, "events"), ["event_type", "user_id"])


@query("leaderboard_rank", """WITH x AS (SELECT p_partkey AS experiment_id, CASE WHEN p_size % 2 = 0 THEN 'rmse' ELSE 'f1' END AS metric_name, p_retailprice AS score FROM part) SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY CASE WHEN metric_name = 'rmse' THEN score ELSE -score END, experiment_id) AS rank FROM x""")
def leaderboard_rank(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part").select(F.col("p_partkey").alias("experiment_id"), F.when(F.col("p_size") % 2 == 0, "rmse").otherwise("f1").alias("metric_name"), F.col("p_retailprice").alias("score"))
    return tracking.ranked(x)


@query("windowed_stream", "SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS start, count(value) AS n, round(avg(value), 8) AS mean, min(value) AS min, max(value) AS max FROM events GROUP BY ALL")
def windowed_stream(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.windows import windowed

    x = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = windowed(x, "ts", ["event_type"], "value")
    return w.select("event_type", F.unix_seconds("start").alias("start"), "n", F.round("mean", 8).alias("mean"), "min", "max")


@query("user_sessions", """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts))) AS BIGINT) + 21600 AS stop, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.windows import sessions

    x = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(x, "ts", ["user_id"], "6 hours").select("user_id", F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("stop"), "n")
