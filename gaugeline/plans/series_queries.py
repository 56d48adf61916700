"""Queries over series of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import order
from ..operators import statistics as st
from ..operators import windows as win
from .inputs import BY_TYPE, BY_USER, READINGS_SQL, readings, rounded, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def frame(a: int, b: int, keys: str = "user_id") -> str:
    side = lambda k: f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}" if k else "CURRENT ROW"
    return f"(PARTITION BY {keys} ORDER BY ts, event_id ROWS BETWEEN {side(a)} AND {side(b)})"


@query("flag_anomalies", f"""WITH {READINGS_SQL},
x AS (SELECT *, CASE WHEN count(v) OVER f >= 6 THEN v - quantile_cont(v, 0.5) OVER f END AS resid FROM r WINDOW f AS {frame(-47, 0, 'event_type')}),
m AS (SELECT event_type, quantile_cont(resid, 0.5) AS centre FROM x GROUP BY 1),
s AS (SELECT event_type, any_value(centre) AS centre, greatest(quantile_cont(abs(resid - centre), 0.5), 1e-6) AS spread FROM x JOIN m USING (event_type) GROUP BY 1),
z AS (SELECT event_type, round(abs(resid - centre) / spread, 8) AS score FROM x JOIN s USING (event_type) WHERE resid IS NOT NULL),
t AS (SELECT quantile_cont(score, 0.95) AS thr FROM z)
SELECT event_type, count(*) AS n, count(*) FILTER (score >= thr) AS n_flagged, round(max(score), 6) AS max_score FROM z, t GROUP BY 1""")
def flag_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Readings per series whose causal residual is far out for that series."""
    x = readings(spark, d).withColumn("resid", win.baseline_residual(BY_TYPE, "v", 48, 6))
    scale = st.group_scale(x, "resid", ["event_type"])
    z = x.filter("resid IS NOT NULL").join(F.broadcast(scale), "event_type").select("event_type", F.round(F.abs(F.col("resid") - F.col("centre")) / F.col("spread"), 8).alias("score"))
    t = order.percentiles(z, "score", {"thr": 0.95})
    return z.crossJoin(F.broadcast(t)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= F.col("thr")).alias("n_flagged"), F.round(F.max("score"), 6).alias("max_score"))


@query("lag_diff", f"""WITH {READINGS_SQL} SELECT event_id, lag(v, 1) OVER w AS v_lag1, lag(v, 2) OVER w AS v_lag2, lag(v, 3) OVER w AS v_lag3, lag(v, 6) OVER w AS v_lag6, lag(v, 12) OVER w AS v_lag12,
round(lag(v, 1) OVER w - lag(v, 2) OVER w, 8) AS v_diff1, round(lag(v, 1) OVER w - lag(v, 3) OVER w, 8) AS v_diff2, round(lag(v, 1) OVER w - lag(v, 7) OVER w, 8) AS v_diff6,
round(lag(v, 1) OVER w - lag(v, 2) OVER w, 8) AS v_gradient, round(abs(lag(v, 1) OVER w - lag(v, 2) OVER w), 8) AS v_abs_gradient,
round(lag(v, 1) OVER w - lag(v, 2) OVER w - (lag(v, 2) OVER w - lag(v, 3) OVER w), 8) AS v_second_deriv FROM r {W}""")
def lag_diff(spark: SparkSession, d: str) -> DataFrame:
    x = readings(spark, d)
    return rounded(x.select("event_id", *[c.alias(n) for n, c in (win.lags(BY_USER, "v") | win.differences(BY_USER, "v")).items()]))


def _moments_sql(w: int) -> str:
    f = f"OVER {frame(-w, -1)}"
    return f"round(avg(v) {f}, 8) AS v_roll_mean_{w}, round(stddev_samp(v) {f}, 6) AS v_roll_std_{w}, round(var_samp(v) {f}, 9) AS v_roll_var_{w}, min(v) {f} AS v_roll_min_{w}, max(v) {f} AS v_roll_max_{w}, round(max(v) {f} - min(v) {f}, 8) AS v_roll_range_{w}"


@query("roll_moments", f"WITH {READINGS_SQL} SELECT event_id, {_moments_sql(12)}, {_moments_sql(48)} FROM r")
def roll_moments(spark: SparkSession, d: str) -> DataFrame:
    c = win.rolling(BY_USER, "v", (12, 48), ("mean", "std", "var", "min", "max", "range"))
    return readings(spark, d).select("event_id", *[F.round(x, 6 if "_std_" in n else 9 if "_var_" in n else 8).alias(n) for n, x in c.items()])


@query("roll_quantiles", f"WITH {READINGS_SQL} SELECT event_id, " + ", ".join(f"round(quantile_cont(v, {q}) OVER {frame(-w, -1)}, 6) AS v_roll_{n}_{w}" for w in (12, 48) for n, q in (("median", 0.5), ("q25", 0.25), ("q75", 0.75))) + " FROM r")
def roll_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(readings(spark, d).select("event_id", *[c.alias(n) for n, c in win.rolling(BY_USER, "v", (12, 48), ("median", "q25", "q75")).items()]), 6)


@query("roll_mad", f"""WITH {READINGS_SQL}, x AS (SELECT event_id, user_id, ts, abs(lag(v, 1) OVER w - quantile_cont(v, 0.5) OVER {frame(-12, -1)}) AS o FROM r {W})
SELECT event_id, round(quantile_cont(o, 0.5) OVER {frame(-11, 0)}, 6) AS v_roll_mad_12 FROM x""")
def roll_mad(spark: SparkSession, d: str) -> DataFrame:
    return rounded(win.rolling_mad(readings(spark, d), BY_USER, "v", 12).select("event_id", "v_roll_mad_12"), 6)


@query("ema", f"""WITH {READINGS_SQL}, n AS (SELECT *, row_number() OVER w AS i FROM r {W}),
x AS (SELECT a.event_id, sum(pow(1 - 2 / 13.0::DOUBLE, a.i - 1 - b.i) * b.v) / sum(CASE WHEN b.v IS NOT NULL THEN pow(1 - 2 / 13.0::DOUBLE, a.i - 1 - b.i) END) AS e FROM n a JOIN n b ON a.user_id = b.user_id AND b.i < a.i GROUP BY 1)
SELECT n.event_id, round(e, 6) AS v_ema_12, round(lag(v, 1) OVER w - e, 6) AS v_ema_diff_12 FROM n LEFT JOIN x USING (event_id) {W}""")
def ema(spark: SparkSession, d: str) -> DataFrame:
    x = readings(spark, d).select("event_id", "user_id", "ts", "v")
    return rounded(win.ema(x, BY_USER, "v", (12,)).select("event_id", "v_ema_12", "v_ema_diff_12"), 6)


@query("roll_slope", f"""WITH {READINGS_SQL}, n AS (SELECT *, CAST(row_number() OVER w AS DOUBLE) AS i FROM r {W})
SELECT event_id, round(CASE WHEN count(value) OVER f = 12 THEN regr_slope(value, i) OVER f END, 6) AS value_slope_12, round(CASE WHEN count(v) OVER f = 12 THEN regr_slope(v, i) OVER f END, 6) AS v_slope_12 FROM n WINDOW f AS {frame(-12, -1)}""")
def roll_slope(spark: SparkSession, d: str) -> DataFrame:
    x = win.with_slopes(win.with_slopes(readings(spark, d), BY_USER, "value", (12,)), BY_USER, "v", (12,))
    return rounded(x.select("event_id", "value_slope_12", "v_slope_12"), 6)


@query("run_length", f"""WITH {READINGS_SQL}, c AS (SELECT *, CASE WHEN flat IS NULL OR lag(flat) OVER w IS NULL OR flat <> lag(flat) OVER w THEN 1 ELSE 0 END AS new FROM r {W}),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS flat_runlength FROM i""")
def run_length(spark: SparkSession, d: str) -> DataFrame:
    return win.run_length(readings(spark, d), BY_USER, "flat").select("event_id", "flat_runlength")


@query("missing_run", f"""WITH {READINGS_SQL}, c AS (SELECT *, count(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM r)
SELECT event_id, CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, seen ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS missing_run FROM c""")
def missing_run(spark: SparkSession, d: str) -> DataFrame:
    return win.missing_run(readings(spark, d), BY_USER, "v").select("event_id", "missing_run")


@query("roll_unique", f"WITH {READINGS_SQL} SELECT event_id, count(DISTINCT flat) OVER {frame(-12, -1)} AS flat_uniq_count_12 FROM r")
def roll_unique(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).select("event_id", win.unique_count(BY_USER, "flat", 12).alias("flat_uniq_count_12"))


@query("cv_devroll", f"""WITH {READINGS_SQL} SELECT event_id, round(lag(v, 1) OVER w - avg(v) OVER f, 8) AS v_resid_rollmean_12, round(v - avg(v) OVER f, 8) AS v_dev_rollmean_12,
round(stddev_samp(v) OVER f / nullif(abs(avg(v) OVER f), 0), 6) AS v_cv_12 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS {frame(-12, -1)}""")
def cv_devroll(spark: SparkSession, d: str) -> DataFrame:
    c = win.residuals(BY_USER, "v", (12,))
    return readings(spark, d).select("event_id", *[F.round(x, 6 if "_cv_" in n else 8).alias(n) for n, x in c.items()])


@query("vol_ratio", f"""WITH {READINGS_SQL}, s AS (SELECT *, abs(v - lag(v, 1) OVER w) AS step FROM r WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT event_id, round(CASE WHEN count(step) OVER a >= 6 THEN quantile_cont(step, 0.5) OVER a END / (CASE WHEN count(step) OVER b >= 48 THEN quantile_cont(step, 0.5) OVER b END + 1e-6), 6) AS vol_ratio
FROM s WINDOW a AS {frame(-17, 0, 'event_type')}, b AS {frame(-287, 0, 'event_type')}""")
def vol_ratio(spark: SparkSession, d: str) -> DataFrame:
    return rounded(win.volatility_ratio(readings(spark, d), BY_TYPE, "v", long=288).select("event_id", "vol_ratio"), 6)


@query("long_residual", f"WITH {READINGS_SQL} SELECT event_id, round(v - CASE WHEN count(v) OVER f >= 48 THEN quantile_cont(v, 0.5) OVER f END, 6) AS v_resid_long FROM r WINDOW f AS {frame(-287, 0, 'event_type')}")
def long_residual(spark: SparkSession, d: str) -> DataFrame:
    return rounded(readings(spark, d).select("event_id", win.baseline_residual(BY_TYPE, "v", 288, 48).alias("v_resid_long")), 6)


@query("centred_fit", f"""WITH {READINGS_SQL}, n AS (SELECT *, CAST(row_number() OVER w - 1 AS DOUBLE) AS i FROM r {W}),
m AS (SELECT event_id, CASE WHEN count(v) OVER f >= 8 THEN avg(i * v) OVER f - avg(i) OVER f * avg(v) OVER f END AS cov, CASE WHEN count(i) OVER f >= 8 THEN avg(i * i) OVER f - avg(i) OVER f * avg(i) OVER f END AS vx,
      CASE WHEN count(v) OVER f >= 8 THEN var_samp(v) OVER f END AS vy FROM n WINDOW f AS {frame(-12, 11)}),
q AS (SELECT *, cov * cov / nullif(vx * vy, 0) AS r2 FROM m)
SELECT event_id, round(abs(cov / nullif(vx, 0) * 24), 5) AS v_ctr_span_24, round(CASE WHEN r2 IS NOT NULL THEN least(1, greatest(0, r2)) END, 6) AS v_ctr_r2_24, round(sqrt(vy), 6) AS v_ctr_flat_24 FROM q""")
def centred_fit(spark: SparkSession, d: str) -> DataFrame:
    x = win.centred_fit(readings(spark, d), BY_USER, "v", 24)
    return x.select("event_id", F.round("v_ctr_span_24", 5).alias("v_ctr_span_24"), F.round("v_ctr_r2_24", 6).alias("v_ctr_r2_24"), F.round("v_ctr_flat_24", 6).alias("v_ctr_flat_24"))


@query("pct_rank_blend", f"""WITH {READINGS_SQL}, k AS (SELECT event_id, (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE) / count(v) OVER () AS a, (rank() OVER (ORDER BY flat) + (count(*) OVER (PARTITION BY flat) - 1) / 2.0::DOUBLE) / count(flat) OVER () AS b FROM r WHERE v IS NOT NULL)
SELECT event_id, round(a, 8) AS rank_v, round(b, 8) AS rank_flat, round(greatest(a, 0.7::DOUBLE * a + 0.3::DOUBLE * b), 8) AS blended FROM k""")
def pct_rank_blend(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.metrics import rank_blend

    x = readings(spark, d).filter("v IS NOT NULL").select("event_id", "v", "flat")
    x = order.shares(order.shares(x, "v", "rank_v"), "flat", "rank_flat").drop("v", "flat")
    return rounded(x.withColumn("blended", rank_blend(F.col("rank_v"), F.col("rank_flat"), 0.3)))


@query("array_windows", f"""WITH {READINGS_SQL}, n AS (SELECT *, row_number() OVER w AS i, count(v) OVER f AS c, list(v) OVER f AS l FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS {frame(-7, 0)})
SELECT event_id, CAST(len(l) AS INTEGER) AS n_values, l[1] AS first_value, l[8] AS last_value, round(list_aggregate(l, 'median'), 8) AS middle FROM n WHERE i >= 8 AND c = 8 AND (i - 8) % 4 = 0""")
def array_windows(spark: SparkSession, d: str) -> DataFrame:
    x = win.sequences(readings(spark, d), BY_USER, ["v"], 8, 4)
    back = F.get("v_seq", F.lit(0)) - F.get(win.centred(F.col("v_seq")), F.lit(0))
    return x.select("event_id", F.size("v_seq").alias("n_values"), F.get("v_seq", F.lit(0)).alias("first_value"), F.get("v_seq", F.lit(7)).alias("last_value"), F.round(back, 8).alias("middle"))


@query("sequence_channels", f"""WITH {READINGS_SQL}, n AS (SELECT *, row_number() OVER w AS i, count(v) OVER f AS c, list(v) OVER f AS l, list(flat) OVER f AS g FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS {frame(-7, 0)})
SELECT event_id, round(l[1] - list_aggregate(l, 'median'), 8) AS v_first, round(g[8] - list_aggregate(g, 'median'), 8) AS flat_last, round(list_sum(list_transform(generate_series(2, 8), lambda k: abs(l[k] - l[k - 1]))), 6) AS steps FROM n WHERE i >= 8 AND c = 8 AND (i - 8) % 4 = 0""")
def sequence_channels(spark: SparkSession, d: str) -> DataFrame:
    x = win.channels(readings(spark, d), BY_USER, "v", "flat", 8, 4)
    steps = F.aggregate("v_steps", F.lit(0.0), lambda a, e: a + e)
    return x.select("event_id", F.round(F.get("v_centred", F.lit(0)), 8).alias("v_first"), F.round(F.get("flat_centred", F.lit(7)), 8).alias("flat_last"), F.round(steps, 6).alias("steps"))


@query("robust_stats", f"""WITH {READINGS_SQL}, q AS (SELECT avg(v) AS m, greatest(stddev_samp(v), 1e-10) AS s, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q75 FROM r), d AS (SELECT greatest(quantile_cont(abs(v - med), 0.5), 1e-10) AS mad FROM r, q)
SELECT event_id, round((v - m) / s, 6) AS v_zscore, round((v - med) / mad, 6) AS v_robust_zscore, CASE WHEN v < q25 - 1.5::DOUBLE * (q75 - q25) OR v > q75 + 1.5::DOUBLE * (q75 - q25) THEN 1 ELSE 0 END AS v_iqr_flag FROM r, q, d""")
def robust_stats(spark: SparkSession, d: str) -> DataFrame:
    x = readings(spark, d)
    return rounded(st.robust_scores(x, st.robust(x, ["v"]), "v").select("event_id", "v_zscore", "v_robust_zscore", "v_iqr_flag"), 6)


@query("group_scale", f"""WITH {READINGS_SQL}, m AS (SELECT user_id, quantile_cont(v, 0.5) AS centre FROM r GROUP BY 1)
SELECT user_id, round(any_value(centre), 6) AS centre, round(greatest(quantile_cont(abs(v - centre), 0.5), 1e-6), 6) AS spread FROM r JOIN m USING (user_id) GROUP BY 1""")
def group_scale(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.group_scale(readings(spark, d), "v", ["user_id"]), 6)


@query("offset_means", f"""WITH {READINGS_SQL}, t AS (SELECT * FROM r WHERE event_id % 5 <> 0), m AS (SELECT user_id, avg(v) AS m FROM t WHERE user_id % 4 <> 0 GROUP BY 1), a AS (SELECT avg(v) AS a FROM t WHERE user_id % 4 <> 0)
SELECT event_id, round(v - coalesce(m, a), 8) AS v_dev_user_id_mean FROM r LEFT JOIN m USING (user_id), a""")
def offset_means(spark: SparkSession, d: str) -> DataFrame:
    x = readings(spark, d)
    return rounded(st.offsets(x.filter("event_id % 5 <> 0 AND user_id % 4 <> 0"), x, "v", "user_id").select("event_id", "v_dev_user_id_mean"))


@query("group_spread", f"""WITH {READINGS_SQL}, g AS (SELECT minute // 60 AS hour, quantile_cont(v, 0.5) AS m, max(v) - min(v) AS s, count(v) AS n FROM r GROUP BY 1)
SELECT event_id, round(m, 6) AS v_layer_median, round(s, 8) AS v_layer_spread, n AS v_layer_count, round(v - m, 6) AS v_dev_layers FROM r JOIN g ON g.hour = r.minute // 60""")
def group_spread(spark: SparkSession, d: str) -> DataFrame:
    x = readings(spark, d).withColumn("hour", F.expr("minute div 60"))
    x = st.group_spread(x, "v", ["hour"])
    return x.select("event_id", F.round("v_layer_median", 6).alias("v_layer_median"), F.round("v_layer_spread", 8).alias("v_layer_spread"), "v_layer_count", F.round("v_dev_layers", 6).alias("v_dev_layers"))


_PARTS = {"hour": ("hour(ts)", 24), "month": ("month(ts)", 12), "doy": ("dayofyear(ts)", 365.25), "dow": ("isodow(ts) - 1", 7)}


@query("seasonality", "SELECT event_id, " + ", ".join(f"round({f}(2 * pi() * ({x}) / {p}), 8) + 0.0::DOUBLE AS {f}_{n}" for n, (x, p) in _PARTS.items() for f in ("sin", "cos")) + " FROM events")
def seasonality(spark: SparkSession, d: str) -> DataFrame:
    at = {"hour": F.hour("ts"), "month": F.month("ts"), "doy": F.dayofyear("ts"), "dow": F.weekday("ts")}
    cols = [(F.round(c, 8) + 0.0).alias(f"{f}_{n}") for n, (_, p) in _PARTS.items() for f, c in zip(("sin", "cos"), sc.cyclic(at[n], p))]
    return table(spark, d, "events").select("event_id", *cols)


@query("impute_flags", f"""WITH {READINGS_SQL}, t AS (SELECT * FROM r WHERE event_id % 3 <> 0), f AS (SELECT quantile_cont(v, 0.5) AS med FROM t), c AS (SELECT event_type AS m FROM t GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)
SELECT event_id, round(coalesce(v, med), 8) AS v, CASE WHEN v IS NULL THEN 1 ELSE 0 END AS v_isnull, coalesce(CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END, m) AS event_type FROM r, f, c""")
def impute_flags(spark: SparkSession, d: str) -> DataFrame:
    x = readings(spark, d)
    train = x.filter("event_id % 3 <> 0")
    values = st.imputation(train, ["v"], ["event_type"])
    holes = x.withColumn("event_type", F.when(F.col("event_id") % 11 != 0, F.col("event_type")))
    return rounded(st.imputed(holes, values, st.flagged_columns(train, ["v", "value"])).select("event_id", "v", "v_isnull", "event_type"))


@query("cat_group_stats", f"""WITH {READINGS_SQL}, t AS (SELECT event_type, avg(v) AS m, stddev_samp(v) AS s FROM r WHERE event_id % 3 <> 0 GROUP BY 1)
SELECT event_id, round(m, 8) AS event_type_v_mean, round(s, 6) AS event_type_v_std FROM r LEFT JOIN t USING (event_type)""")
def cat_group_stats(spark: SparkSession, d: str) -> DataFrame:
    x = readings(spark, d)
    y = st.category_statistics(x.filter("event_id % 3 <> 0"), x, ["event_type"], ["v"])
    return y.select("event_id", F.round("event_type_v_mean", 8).alias("event_type_v_mean"), F.round("event_type_v_std", 6).alias("event_type_v_std"))


@query("interactions", f"""WITH {READINGS_SQL} SELECT event_id, round(v * flat, 6) AS v_x_flat, round(v / nullif(flat + 1e-5::DOUBLE, 0), 4) AS v_div_flat FROM r""")
def interactions(spark: SparkSession, d: str) -> DataFrame:
    c = st.interactions(["v", "flat"])
    return readings(spark, d).select("event_id", F.round(c["v_x_flat"], 6).alias("v_x_flat"), F.round(c["v_div_flat"], 4).alias("v_div_flat"))


@query("standard_scale", f"""WITH {READINGS_SQL}, f AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM r WHERE event_id % 3 <> 0) SELECT event_id, round((v - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS v_scaled FROM r, f""")
def standard_scale(spark: SparkSession, d: str) -> DataFrame:
    x = readings(spark, d)
    return rounded(st.standardized(x.filter("event_id % 3 <> 0"), x, ["v"]).select("event_id", "v_scaled"), 6)


@query("balanced_weights", f"""WITH {READINGS_SQL}, k AS (SELECT event_type, count(*) AS n FROM r GROUP BY 1), a AS (SELECT sum(n) AS a, count(*) AS c FROM k)
SELECT event_id, round(a::DOUBLE / (c * n)::DOUBLE * CASE WHEN v IS NULL THEN 0.35::DOUBLE ELSE 1 END, 8) AS weight FROM r JOIN k USING (event_type), a""")
def balanced_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.balanced_weights(readings(spark, d), "event_type", F.col("v").isNull()).select("event_id", "weight"))


@query("series_key", """SELECT event_id, CAST(user_id AS VARCHAR) || '_' || event_type AS series, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS is_view, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_purchase,
CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END AS code, trim(split_part(event_type || ' + x', '+', 1)) AS first_label FROM events""")
def series_key(spark: SparkSession, d: str) -> DataFrame:
    hot = sc.one_hot(F.col("event_type"), ["view", "purchase"], "is_")
    return table(spark, d, "events").select("event_id", sc.series_key("user_id", "event_type").alias("series"), *[c.alias(n) for n, c in hot.items()], sc.coded(F.col("event_type"), {"view": 1, "click": 2}).alias("code"), sc.first_part(F.concat("event_type", F.lit(" + x"))).alias("first_label"))


@query("json_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.absent') IS NULL AS no_absent FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").withColumn("j", F.from_json("props", "k long, absent string"))
    return x.select("event_id", F.col("j.k").alias("k"), F.col("j.absent").isNull().alias("no_absent"))


@query("array_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm, CAST(len(embedding) AS INTEGER) AS n, round(list_aggregate(embedding, 'median')::DOUBLE, 5) AS middle FROM embeddings")
def array_norms(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    norm = F.sqrt(F.aggregate(F.transform("e", lambda v: v * v), F.lit(0.0), lambda a, v: a + v))
    return x.select("vec_id", F.round(norm, 4).alias("norm"), F.size("e").alias("n"), F.round(F.get("e", F.lit(0)) - F.get(win.centred(F.col("e")), F.lit(0)), 5).alias("middle"))
