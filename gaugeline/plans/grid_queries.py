"""Queries over gridded series, cases and their features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid as gr
from ..operators import splits as sp
from .inputs import BY_STATION, GRID_SQL, gridded, rounded

QUERIES, SQL = {}, {}
LEADS = (3, 6, 12)


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def latest_sql(rows: int) -> str:
    f = f"OVER (PARTITION BY station ORDER BY minute ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"last_value(hs IGNORE NULLS) {f} AS latest_hs, CAST(minute - last_value(CASE WHEN hs IS NOT NULL THEN minute END IGNORE NULLS) {f} AS DOUBLE) AS latest_hs_age"


@query("grid_align", f"WITH {GRID_SQL} SELECT * FROM g")
def grid_align(spark: SparkSession, d: str) -> DataFrame:
    return gridded(spark, d)


@query("latest_finite", f"WITH {GRID_SQL} SELECT station, minute, {latest_sql(49)} FROM g")
def latest_finite(spark: SparkSession, d: str) -> DataFrame:
    return gridded(spark, d).select("station", "minute", *[c.cast("double").alias(n) for n, c in gr.latest(BY_STATION, "hs", 49).items()])


@query("lead_targets", f"WITH {GRID_SQL} SELECT station, minute, " + ", ".join(f"lead(hs, {h}) OVER (PARTITION BY station ORDER BY minute) AS target_{h}h" for h in LEADS) + " FROM g")
def lead_targets(spark: SparkSession, d: str) -> DataFrame:
    return gridded(spark, d).select("station", "minute", *[c.alias(n) for n, c in gr.lead_targets(BY_STATION, "hs", LEADS, 60).items()])


ELIGIBLE_SQL = "x AS (SELECT *, row_number() OVER w AS n, last_value(hs IGNORE NULLS) OVER (PARTITION BY station ORDER BY minute ROWS BETWEEN 48 PRECEDING AND CURRENT ROW) AS latest, " + ", ".join(f"lead(hs, {h}) OVER w AS target_{h}h" for h in LEADS) + """ FROM g WINDOW w AS (PARTITION BY station ORDER BY minute)),
el AS (SELECT * FROM x WHERE n > 48 AND latest >= 5 AND target_3h IS NOT NULL AND target_6h IS NOT NULL AND target_12h IS NOT NULL)"""


def anchors(spark: SparkSession, d: str) -> DataFrame:
    return gr.eligible(gridded(spark, d), BY_STATION, "hs", LEADS, 48, 60, 5.0)


@query("eligible_cases", f"WITH {GRID_SQL}, {ELIGIBLE_SQL} SELECT station, minute, target_3h, target_6h, target_12h FROM el")
def eligible_cases(spark: SparkSession, d: str) -> DataFrame:
    return anchors(spark, d).select("station", "minute", *[f"target_{h}h" for h in LEADS])


SEPARATED_SQL = """o AS (SELECT station, list(minute ORDER BY minute) AS l FROM el GROUP BY 1),
k AS (SELECT station, unnest(list_reduce(list_prepend([]::BIGINT[], list_transform(l, lambda v: [v])), lambda a, v: CASE WHEN len(a) = 0 OR v[1] - a[-1] >= 1800 THEN list_append(a, v[1]) ELSE a END)) AS minute FROM o)"""


@query("greedy_separation", f"WITH {GRID_SQL}, {ELIGIBLE_SQL}, {SEPARATED_SQL} SELECT station, minute FROM k")
def greedy_separation(spark: SparkSession, d: str) -> DataFrame:
    return gr.separated(anchors(spark, d), ["station"], "minute", 1800).select("station", "minute")


@query("stride_sample", f"WITH {GRID_SQL}, {ELIGIBLE_SQL} SELECT station, minute FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY minute) AS i FROM el) WHERE (i - 1) % 3 = 0")
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    return gr.strided(anchors(spark, d), BY_STATION, 3).select("station", "minute")


@query("interval_purge", f"""WITH {GRID_SQL}, {ELIGIBLE_SQL}, t AS (SELECT station, minute FROM el WHERE minute % 120 = 0), v AS (SELECT station, minute FROM el WHERE minute % 7980 = 0)
SELECT t.station, t.minute FROM t WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.station = t.station AND t.minute - 600 <= v.minute + 360 + 60 AND t.minute + 360 >= v.minute - 600)""")
def interval_purge(spark: SparkSession, d: str) -> DataFrame:
    x = anchors(spark, d).select("station", "minute")
    return gr.purged(x.filter("minute % 120 = 0"), x.filter("minute % 7980 = 0"), before=600, after=360, buffer=60)


CONTEXT_SQL = f"{GRID_SQL}, {ELIGIBLE_SQL}, {SEPARATED_SQL}, cx AS (SELECT k.station, k.minute AS ref_minute, g.hs, g.wspd, CAST(g.minute - k.minute AS INTEGER) AS step_minute FROM k JOIN g ON g.station = k.station AND g.minute BETWEEN k.minute - 2880 AND k.minute)"


def contexts(spark: SparkSession, d: str) -> DataFrame:
    g = gridded(spark, d)
    a = gr.separated(gr.eligible(g, BY_STATION, "hs", LEADS, 48, 60, 5.0), ["station"], "minute", 1800).select("station", "minute")
    return gr.contexts(a, g)


@query("case_context", f"WITH {CONTEXT_SQL} SELECT station, ref_minute, step_minute, hs, wspd FROM cx")
def case_context(spark: SparkSession, d: str) -> DataFrame:
    return contexts(spark, d).select("station", "ref_minute", "step_minute", "hs", "wspd")


def _range_sql() -> str:
    out = ["latest_hs", "latest_hs_step", "latest_hs_age", "hs_at_0", "round(latest_hs * latest_hs, 6) AS hs_energy"]
    agg = ["coalesce(max_by(hs, step_minute) FILTER (hs IS NOT NULL), 1.5::DOUBLE) AS latest_hs", "coalesce(max(step_minute) FILTER (hs IS NOT NULL), -9999) AS latest_hs_step", "coalesce(-max(step_minute) FILTER (hs IS NOT NULL), 9999) AS latest_hs_age", "CAST(max(CASE WHEN step_minute = 0 AND hs IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS hs_at_0", "max_by(wspd, step_minute) FILTER (wspd IS NOT NULL) AS latest_wspd", "count(*) AS n"]
    for h in (6, 24, 48):
        w = f"FILTER (step_minute >= {-60 * h} AND hs IS NOT NULL)"
        ww = f"FILTER (step_minute >= {-60 * h} AND wspd IS NOT NULL)"
        agg += [f"count(*) {w} AS n{h}, avg(hs) {w} AS m{h}, stddev_samp(hs) {w} AS s{h}, min(hs) {w} AS lo{h}, max(hs) {w} AS hi{h}, min_by(hs, step_minute) {w} AS f{h}, regr_slope(hs, step_minute / 60.0::DOUBLE) {w} AS sl{h}, avg(wspd) {ww} AS wm{h}, max(wspd) {ww} AS wx{h}, stddev_samp(wspd) {ww} AS ws{h}, count(*) {ww} AS wn{h}"]
        out += [
            f"round(CASE WHEN n{h} > 0 THEN m{h} ELSE latest_hs END, 8) AS hs_mean_{h}h, round(CASE WHEN n{h} > 1 THEN s{h} ELSE 0 END, 6) AS hs_std_{h}h, CASE WHEN n{h} > 0 THEN lo{h} ELSE latest_hs END AS hs_min_{h}h, CASE WHEN n{h} > 0 THEN hi{h} ELSE latest_hs END AS hs_max_{h}h",
            f"round(CASE WHEN n{h} > 0 THEN hi{h} - lo{h} ELSE 0 END, 8) AS hs_range_{h}h, round(CASE WHEN n{h} > 0 THEN latest_hs - f{h} ELSE 0 END, 8) AS hs_diff_{h}h, round(CASE WHEN n{h} > 1 THEN sl{h} ELSE 0 END, 6) AS hs_slope_{h}h",
            f"round(wm{h}, 8) AS wspd_mean_{h}h, wx{h} AS wspd_max_{h}h, round(CASE WHEN wn{h} > 1 THEN ws{h} WHEN wn{h} = 1 THEN 0 END, 6) AS wspd_std_{h}h",
        ]
    out += ["CAST(n6 AS DOUBLE) AS obs_count_6h, CAST(n24 AS DOUBLE) AS obs_count_24h, CAST(n48 AS DOUBLE) AS obs_count_48h, round(1 - n48 / n::DOUBLE, 8) AS missing_ratio_48h"]
    return f"WITH {CONTEXT_SQL}, a AS (SELECT station, ref_minute, {', '.join(agg)} FROM cx GROUP BY ALL) SELECT station, ref_minute, {', '.join(out)} FROM a"


@query("range_window_features", _range_sql())
def range_window_features(spark: SparkSession, d: str) -> DataFrame:
    x = gr.range_features(contexts(spark, d), ["station", "ref_minute"], gust=None, height=None, hours=(6, 24, 48), high=())
    x = x.drop("latest_wspd", "wind_forcing_ratio", "hs_over_mean_24h", "hs_over_max_48h")
    return x.select(*[F.round(c, 6 if any(k in c for k in ("_std_", "_slope_", "energy")) else 8).alias(c) if t == "double" else F.col(c) for c, t in x.dtypes])


@query("wind_ratios", f"""WITH {CONTEXT_SQL}, a AS (SELECT station, ref_minute, coalesce(max_by(hs, step_minute) FILTER (hs IS NOT NULL), 1.5::DOUBLE) AS l, max_by(wspd, step_minute) FILTER (wspd IS NOT NULL) AS w,
  avg(hs) FILTER (step_minute >= -1440) AS m24, max(hs) AS x48, count(*) FILTER (hs >= 1.5) AS c15, count(*) FILTER (hs >= 50) AS c50 FROM cx GROUP BY ALL)
SELECT station, ref_minute, round(w * w / (l + 1e-6), 5) AS wind_forcing_ratio, round(l / (coalesce(m24, l) + 1e-6), 6) AS hs_over_mean_24h, round(l / (x48 + 1e-6), 6) AS hs_over_max_48h, CAST(c15 AS DOUBLE) AS high_count_1_5, CAST(c50 AS DOUBLE) AS high_count_50_0 FROM a""")
def wind_ratios(spark: SparkSession, d: str) -> DataFrame:
    x = gr.range_features(contexts(spark, d), ["station", "ref_minute"], gust=None, height=None, hours=(24, 48), high=(1.5, 50.0))
    return x.select("station", "ref_minute", F.round("wind_forcing_ratio", 5).alias("wind_forcing_ratio"), F.round("hs_over_mean_24h", 6).alias("hs_over_mean_24h"), F.round("hs_over_max_48h", 6).alias("hs_over_max_48h"), "high_count_1_5", "high_count_50_0")


@query("case_leads", f"WITH {GRID_SQL}, {ELIGIBLE_SQL}, {SEPARATED_SQL} SELECT station, minute, 'H_' || CAST(station AS VARCHAR) || '_' || strftime(to_timestamp(minute * 60) AT TIME ZONE 'UTC', '%Y%m%d%H%M') AS case_id, CAST(unnest([3, 6, 9, 12, 18, 24]) AS INTEGER) AS lead_h FROM k")
def case_leads(spark: SparkSession, d: str) -> DataFrame:
    x = gr.separated(anchors(spark, d), ["station"], "minute", 1800)
    return gr.case_leads(x.select("station", "minute", gr.case_id(F.col("station"), F.col("minute")).alias("case_id")))


@query("coverage_weights", f"""WITH {CONTEXT_SQL}, s AS (SELECT station, ref_minute, CASE WHEN avg(CASE WHEN wspd IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) > 0.5 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS w FROM cx GROUP BY ALL)
SELECT station, ref_minute, round(w / (SELECT avg(w) FROM s), 8) AS weight FROM s""")
def coverage_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sp.coverage_weights(contexts(spark, d), ["station", "ref_minute"], "wspd").select("station", "ref_minute", "weight"))


@query("forward_split", f"""WITH {GRID_SQL}, {ELIGIBLE_SQL}, cut AS (SELECT CAST(floor(quantile_cont(minute, 0.7)) AS BIGINT) AS c FROM el),
vo AS (SELECT station, list(minute ORDER BY minute) AS l FROM el, cut WHERE minute >= c GROUP BY 1),
v AS (SELECT station, unnest(list_reduce(list_prepend([]::BIGINT[], list_transform(l, lambda v: [v])), lambda a, v: CASE WHEN len(a) = 0 OR v[1] - a[-1] >= 1800 THEN list_append(a, v[1]) ELSE a END)) AS minute FROM vo),
t AS (SELECT station, minute FROM (SELECT station, minute, row_number() OVER (PARTITION BY station ORDER BY minute) AS i FROM el, cut WHERE minute < c) WHERE (i - 1) % 2 = 0)
SELECT station, minute, 'valid' AS part FROM v UNION ALL
SELECT t.station, t.minute, 'train' FROM t WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.station = t.station AND t.minute - 2880 <= v.minute + 1440 + 360 AND t.minute + 1440 >= v.minute - 2880)""")
def forward_split(spark: SparkSession, d: str) -> DataFrame:
    x = anchors(spark, d).select("station", "minute")
    cut = x.agg(F.floor(F.percentile("minute", 0.7)).cast("long")).first()[0]
    return sp.forward_split(x, cut, 1 << 40, sparse=1800)
