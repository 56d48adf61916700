"""Queries over vertical profiles and star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as pr
from ..operators import splits as sp
from ..operators import statistics as st
from ..operators import windows as win
from ..operators.windows import Series
from .inputs import PROFILE, PROFILES_SQL, profiles, rounded, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


ORDER = "(l_partkey, l_suppkey, l_extendedprice, l_shipdate, temp)"
#: First value of each layer by the order of rows.
BOUNDS_SQL = f"""{PROFILES_SQL}, f AS (SELECT l_orderkey, layer, temp FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, layer ORDER BY {ORDER}) AS n FROM p) WHERE n = 1),
b AS (SELECT l_orderkey, max(CASE WHEN layer = 1 THEN temp END) AS surf, max(CASE WHEN layer = 5 THEN temp END) AS bot, max(CASE WHEN layer = 6 THEN temp END) AS deep_6, max(CASE WHEN layer = 7 THEN temp END) AS deep_7
      FROM f GROUP BY 1 HAVING surf IS NOT NULL OR bot IS NOT NULL)"""
SHAPE_SQL = """s AS (SELECT """ + ", ".join(
    f"CASE WHEN count((bot - (surf - {share} * (surf - deep_{k}))) / nullif(CASE WHEN abs(surf - deep_{k}) > 1e-6 THEN surf - deep_{k} END, 0)) >= 20 THEN quantile_cont((bot - (surf - {share} * (surf - deep_{k}))) / nullif(CASE WHEN abs(surf - deep_{k}) > 1e-6 THEN surf - deep_{k} END, 0), 0.5) ELSE 0 END AS r{k}"
    for k, share in ((6, "((19.15::DOUBLE - 4.18::DOUBLE) / (30.21::DOUBLE - 4.18::DOUBLE))"), (7, "((19.15::DOUBLE - 4.18::DOUBLE) / (49.05::DOUBLE - 4.18::DOUBLE))"))
) + " FROM b)"
REBUILT_SQL = """u AS (SELECT l_orderkey, coalesce(surf, gm) AS surf_val, CASE WHEN bot IS NOT NULL THEN 1 ELSE 0 END AS observed,
  coalesce(bot, coalesce(surf, gm) + ((19.15::DOUBLE - 4.18::DOUBLE) / (30.21::DOUBLE - 4.18::DOUBLE)) * (deep_6 - coalesce(surf, gm)) + r6 * (coalesce(surf, gm) - deep_6),
           coalesce(surf, gm) + ((19.15::DOUBLE - 4.18::DOUBLE) / (49.05::DOUBLE - 4.18::DOUBLE)) * (deep_7 - coalesce(surf, gm)) + r7 * (coalesce(surf, gm) - deep_7), gm) AS bot_val, deep_6
  FROM b, s, (SELECT avg(temp) AS gm FROM p))"""


def _mean(x: DataFrame) -> float:
    return x.agg(F.coalesce(F.avg("temp"), F.lit(15.0))).first()[0]


@query("boundary_outer_join", f"WITH {BOUNDS_SQL} SELECT * FROM b")
def boundary_outer_join(spark: SparkSession, d: str) -> DataFrame:
    return pr.boundaries(profiles(spark, d), PROFILE)


@query("shape_ratio", f"WITH {BOUNDS_SQL}, {SHAPE_SQL} SELECT round(r6, 6) AS ratio_6, round(r7, 6) AS ratio_7 FROM s")
def shape_ratio(spark: SparkSession, d: str) -> DataFrame:
    r = pr.shape_ratios(profiles(spark, d), PROFILE, 20)
    return rounded(spark.range(1).select(F.lit(r.get(6, 0.0)).alias("ratio_6"), F.lit(r.get(7, 0.0)).alias("ratio_7")), 6)


@query("boundary_rebuild", f"WITH {BOUNDS_SQL}, {SHAPE_SQL}, {REBUILT_SQL} SELECT l_orderkey, round(surf_val, 6) AS surf_val, round(bot_val, 6) AS bot_val, observed AS bot_is_observed FROM u")
def boundary_rebuild(spark: SparkSession, d: str) -> DataFrame:
    x = profiles(spark, d)
    steps = pr.vertical(PROFILE, _mean(x), pr.shape_ratios(x, PROFILE, 20), "depth")
    b = pr.boundaries(x, PROFILE).withColumn("depth", F.lit(10.0)).withColumns(steps[0])
    return rounded(b.select("l_orderkey", "surf_val", "bot_val", "bot_is_observed"), 6)


@query("vertical_interp", f"""WITH {BOUNDS_SQL}, {SHAPE_SQL}, {REBUILT_SQL},
t AS (SELECT p.l_orderkey, p.layer, p.l_partkey, p.l_suppkey, p.temp, surf_val AS s, bot_val AS b, coalesce(deep_6, bot_val) AS d6,
  CASE p.layer WHEN 2 THEN 6.87::DOUBLE WHEN 3 THEN 9.83::DOUBLE ELSE 14.87::DOUBLE END AS depth FROM p JOIN u USING (l_orderkey) WHERE p.layer IN (2, 3, 4)),
v AS (SELECT *, least(1, greatest(0, (depth - 4.18::DOUBLE) / 14.97::DOUBLE)) AS r FROM t)
SELECT l_orderkey, layer, l_partkey, l_suppkey, temp, round(s + r * (b - s), 6) AS interp, round((s - b) / 14.97::DOUBLE, 6) AS gradient, round(greatest(s - b, 0), 6) AS stratification, round(4 * r * (1 - r), 6) AS curvature_weight,
  round(s + r * (b - s) - greatest(s - b, 0) * 0.3::DOUBLE * (4 * r * (1 - r)), 6) AS curved_estimate, round((b - d6) / 11.06::DOUBLE - (s - b) / 14.97::DOUBLE, 6) AS sharpness FROM v""")
def vertical_interp(spark: SparkSession, d: str) -> DataFrame:
    x = profiles(spark, d)
    b = pr.boundaries(x, PROFILE)
    rows = x.filter(F.col("layer").isin(2, 3, 4)).join(b, "l_orderkey").withColumn("effective_depth", pr.effective_depth(PROFILE))
    for step in pr.vertical(PROFILE, _mean(x), pr.shape_ratios(x, PROFILE, 20)):
        rows = rows.withColumns(step)
    out = rows.select("l_orderkey", "layer", "l_partkey", "l_suppkey", "temp", F.col("vertical_linear_interp").alias("interp"), F.col("vertical_gradient").alias("gradient"), "stratification", "curvature_weight", "curved_estimate", F.col("thermocline_sharpness").alias("sharpness"))
    return rounded(out, 6)


@query("profile_pivot", f"WITH {BOUNDS_SQL} SELECT l_orderkey, " + ", ".join(f"max(CASE WHEN layer = {k} THEN temp END) AS layer_{k}" for k in range(1, 8)) + " FROM f GROUP BY 1")
def profile_pivot(spark: SparkSession, d: str) -> DataFrame:
    return pr.wide(profiles(spark, d), PROFILE, list(range(1, 8)))


@query("profile_unpivot", f"WITH {PROFILES_SQL} SELECT l_orderkey, layer, round(avg(temp), 8) AS temp FROM p GROUP BY ALL")
def profile_unpivot(spark: SparkSession, d: str) -> DataFrame:
    layers = list(range(1, 8))
    return rounded(pr.long(pr.wide(profiles(spark, d), PROFILE, layers, "mean"), PROFILE, layers))


@query("neighbour_gap", f"""WITH {PROFILES_SQL}, m AS (SELECT l_orderkey, layer, avg(temp) AS v FROM p GROUP BY ALL), k AS (SELECT layer, row_number() OVER (ORDER BY layer) AS n FROM (SELECT DISTINCT layer FROM p)), q AS (SELECT m.*, n FROM m JOIN k USING (layer))
SELECT q.l_orderkey, q.layer, round(q.v - a.v, 8) AS grad_upper, round(q.v - c.v, 8) AS grad_lower FROM q LEFT JOIN q a ON a.l_orderkey = q.l_orderkey AND a.n = q.n - 1 LEFT JOIN q c ON c.l_orderkey = q.l_orderkey AND c.n = q.n + 1""")
def neighbour_gap(spark: SparkSession, d: str) -> DataFrame:
    x = profiles(spark, d).select("l_orderkey", "layer", "temp")
    return rounded(pr.neighbour_gaps(x, PROFILE).select("l_orderkey", "layer", "grad_upper", "grad_lower").distinct())


@query("boundary_gap", f"""WITH p AS (SELECT l_suppkey AS station, date_trunc('month', l_shipdate) AS time, l_linenumber AS layer, l_quantity AS temp FROM lineitem),
s AS (SELECT station, time, max(CASE WHEN layer = 7 THEN temp END) AS v FROM p GROUP BY ALL), c AS (SELECT *, count(v) OVER (PARTITION BY station ORDER BY time ROWS UNBOUNDED PRECEDING) AS seen FROM s)
SELECT station, CAST(epoch(time) AS BIGINT) AS at, CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY station, seen ORDER BY time ROWS UNBOUNDED PRECEDING) AS BIGINT) AS boundary_gap FROM c""")
def boundary_gap(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("station"), F.unix_seconds(F.date_trunc("month", F.col("l_shipdate").cast("timestamp"))).alias("at"), F.col("l_linenumber").alias("layer"), F.col("l_quantity").alias("temp"))
    out = pr.boundary_gap(x, pr.Profile(("station", "at")), 7, "station", "at")
    return out.select("station", "at", "boundary_gap").distinct()


@query("boundary_history", f"""WITH {BOUNDS_SQL}, k AS (SELECT l_orderkey // 100 AS station, l_orderkey, coalesce(surf, 25.0::DOUBLE) AS s FROM b)
SELECT l_orderkey, coalesce(lag(s, 1) OVER w, s) AS s_lag1, coalesce(lag(s, 2) OVER w, s) AS s_lag2, coalesce(lag(s, 6) OVER w, s) AS s_lag6, round(avg(s) OVER f, 8) AS s_roll_mean_6, round(coalesce(stddev_samp(s) OVER f, 0), 6) AS s_roll_std_6
FROM k WINDOW w AS (PARTITION BY station ORDER BY l_orderkey), f AS (PARTITION BY station ORDER BY l_orderkey ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def boundary_history(spark: SparkSession, d: str) -> DataFrame:
    b = pr.boundaries(profiles(spark, d), PROFILE).select("l_orderkey", F.expr("l_orderkey div 100").alias("station"), F.coalesce("surf", F.lit(25.0)).alias("s"))
    x = pr.boundary_history(b, Series(("station",), ("l_orderkey",)), ["s"])
    return x.select("l_orderkey", "s_lag1", "s_lag2", "s_lag6", F.round("s_roll_mean_6", 8).alias("s_roll_mean_6"), F.round("s_roll_std_6", 6).alias("s_roll_std_6"))


@query("nominal_depth", f"WITH {PROFILES_SQL}, k AS (SELECT layer, quantile_cont(l_extendedprice, 0.5) AS d FROM p WHERE layer IN (1, 2, 3) GROUP BY 1) SELECT n AS layer, round(coalesce(d, CASE n WHEN 4 THEN 14.87 WHEN 5 THEN 19.15 WHEN 6 THEN 30.21 WHEN 7 THEN 49.05 WHEN 8 THEN 49.35 ELSE n * 10.0 END::DOUBLE), 6) AS depth FROM (SELECT CAST(unnest(generate_series(1, 10)) AS INTEGER) AS n) LEFT JOIN k ON k.layer = n")
def nominal_depth(spark: SparkSession, d: str) -> DataFrame:
    x = profiles(spark, d).filter("layer <= 3")
    p = pr.Profile(layer="layer", depths=pr.nominal_depths(x, PROFILE, "l_extendedprice"))
    return rounded(spark.range(1, 11).select(F.col("id").cast("int").alias("layer")).select("layer", pr.effective_depth(p).alias("depth")), 6)


GRAINS = [["o_orderpriority", "o_orderstatus", "month"], ["o_orderstatus", "month"], ["o_orderstatus"], []]
CLIMATE_SQL = "o AS (SELECT *, month(o_orderdate) AS month FROM orders), t AS (SELECT * FROM o WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 < 2)"


@query("climatology_fallback", f"""WITH {CLIMATE_SQL}, a AS (SELECT o_orderpriority, o_orderstatus, month, avg(o_totalprice) AS m FROM t GROUP BY ALL), b AS (SELECT o_orderstatus, month, avg(o_totalprice) AS m FROM t GROUP BY ALL), c AS (SELECT o_orderstatus, avg(o_totalprice) AS m FROM t GROUP BY ALL), e AS (SELECT avg(o_totalprice) AS m FROM t)
SELECT o_orderkey, round(coalesce(a.m, b.m, c.m, e.m, 15.0), 4) AS expected FROM o LEFT JOIN a USING (o_orderpriority, o_orderstatus, month) LEFT JOIN b ON b.o_orderstatus = o.o_orderstatus AND b.month = o.month LEFT JOIN c ON c.o_orderstatus = o.o_orderstatus, e""")
def climatology_fallback(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("month", F.month("o_orderdate"))
    train = o.filter("o_orderkey % 3 = 0 AND o_orderkey % 7 < 2")
    out = st.fallback(o, st.climatology(train, "o_totalprice", GRAINS), GRAINS, "expected", 15.0)
    return rounded(out.select("o_orderkey", "expected"), 4)


@query("star_pivot", """SELECT r_name, o_orderstatus, count(*) AS n, CAST(count(DISTINCT c_custkey) AS BIGINT) AS customers, round(sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE, 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def star_pivot(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_totalprice"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    places = F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name"))  # 25 nations
    x = o.join(c, o.o_custkey == c.c_custkey).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy("r_name", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_custkey").alias("customers"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("total"))


HASH = "(('0x' || substr(md5({x}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("boundary_dropout", f"WITH {PROFILES_SQL}, k AS (SELECT *, {HASH.format(x=chr(39) + '42|' + chr(39) + ' || CAST(l_orderkey AS VARCHAR)')} AS u FROM p) SELECT l_orderkey, layer, l_partkey, l_suppkey, temp FROM k WHERE NOT (layer = 5 AND u < 0.3::DOUBLE)")
def boundary_dropout(spark: SparkSession, d: str) -> DataFrame:
    return sp.dropout(profiles(spark, d), "l_orderkey", "layer", 5, 0.3, 42).select("l_orderkey", "layer", "l_partkey", "l_suppkey", "temp")


@query("mask_update", f"WITH {PROFILES_SQL}, k AS (SELECT *, layer IN (2, 3, 4) AND {HASH.format(x=chr(39) + '7|' + chr(39) + ' || CAST(l_orderkey AS VARCHAR) || ' + chr(39) + '|' + chr(39) + ' || CAST(layer AS VARCHAR)')} < 0.3::DOUBLE AS is_masked FROM p) SELECT l_orderkey, layer, l_partkey, l_suppkey, is_masked, CASE WHEN is_masked THEN temp END AS truth, CASE WHEN NOT is_masked THEN temp END AS temp FROM k")
def mask_update(spark: SparkSession, d: str) -> DataFrame:
    hide = F.col("layer").isin(2, 3, 4) & sp.random_mask(0.3, 7, "l_orderkey", "layer")
    return sp.masked(profiles(spark, d), hide, ["temp"], "temp").select("l_orderkey", "layer", "l_partkey", "l_suppkey", "is_masked", "truth", "temp")


@query("deep_weights", f"""WITH {PROFILES_SQL}, k AS (SELECT l_orderkey FROM p WHERE layer IN (4, 5, 6, 7) GROUP BY 1 HAVING count(DISTINCT layer) >= 3), w AS (SELECT p.*, CASE WHEN k.l_orderkey IS NOT NULL THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM p LEFT JOIN k USING (l_orderkey))
SELECT l_orderkey, layer, l_partkey, l_suppkey, round(w / (SELECT avg(w) FROM w), 8) AS weight FROM w""")
def deep_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sp.rich_weights(profiles(spark, d), "l_orderkey", "layer", [4, 5, 6, 7]).select("l_orderkey", "layer", "l_partkey", "l_suppkey", "weight"))


@query("hidden_boundary", f"WITH {PROFILES_SQL}, h AS (SELECT DISTINCT l_orderkey FROM p WHERE layer = 5 AND l_orderkey % 4 = 0) SELECT p.l_orderkey, p.layer, p.l_partkey, p.l_suppkey FROM p WHERE NOT (p.layer = 5 AND p.l_orderkey IN (SELECT l_orderkey FROM h))")
def hidden_boundary(spark: SparkSession, d: str) -> DataFrame:
    x = profiles(spark, d)
    hidden = x.filter("layer = 5 AND l_orderkey % 4 = 0").select("l_orderkey", "layer").distinct()
    return x.join(hidden, ["l_orderkey", "layer"], "left_anti").select("l_orderkey", "layer", "l_partkey", "l_suppkey")
