"""Scores of predictions: classification, regression, forecasts, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, ratio
from . import order


def quantile_threshold(df: DataFrame, score: str, rate: float) -> DataFrame:
    """The score that the highest ``rate`` of rows reach (linear interpolation), as one row."""
    return order.percentiles(df, score, {"threshold": 1.0 - rate})


def flagged(df: DataFrame, score: str, rate: float, name: str = "pred") -> DataFrame:
    t = quantile_threshold(df, score, rate)
    return df.crossJoin(F.broadcast(t)).withColumn(name, (F.col(score) >= F.col("threshold")).cast("int")).drop("threshold")


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    count = lambda p: F.count_if(F.col(pred) == p).cast("long")
    return df.groupBy(label).agg(count(0).alias("pred_0"), count(1).alias("pred_1"))


def classification(df: DataFrame, label: str, pred: str) -> DataFrame:
    """precision, recall and f1 of class 1 (0 where undefined), macro f1 and accuracy, as one row."""
    c = lambda y, p: F.count_if((F.col(label) == y) & (F.col(pred) == p)).cast("double")
    x = df.agg(c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(1, 0).alias("fn"), c(0, 0).alias("tn"))
    zero = lambda e: F.coalesce(e, F.lit(0.0))
    f = lambda hit, a, b: zero(ratio(2.0 * F.col(hit), 2.0 * F.col(hit) + F.col(a) + F.col(b)))
    return x.select(
        zero(ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"), zero(ratio(F.col("tp"), F.col("tp") + F.col("fn"))).alias("recall"), f("tp", "fp", "fn").alias("f1"),
        ((f("tp", "fp", "fn") + f("tn", "fp", "fn")) / 2.0).alias("macro_f1"), zero(ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"),
    )


def ranking(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC-AUC and average precision, null unless both classes occur.

    Rows are first counted by distinct score, and scores are put in order slice by slice.
    """
    g = df.groupBy(score).agg(F.count_if(F.col(label) == 1).cast("double").alias("_p"), F.count_if(F.col(label) == 0).cast("double").alias("_n"))
    g = order.ahead(g, score, {"_bp": "_p", "_bn": "_n"}, down=True)
    g = g.withColumns({"_cp": F.col("_bp") + F.col("_p"), "_cn": F.col("_bn") + F.col("_n")})
    x = g.agg(F.sum("_p").alias("np"), F.sum("_n").alias("nn"), F.sum(F.col("_n") * (F.col("_cp") - F.col("_p") / 2.0)).alias("won"), F.sum(F.col("_p") * F.col("_cp") / (F.col("_cp") + F.col("_cn"))).alias("area"))
    both = (F.col("np") > 0) & (F.col("nn") > 0)
    return x.select(F.when(both, ratio(F.col("won"), F.col("np") * F.col("nn"))).alias("roc_auc"), F.when(both, ratio(F.col("area"), F.col("np"))).alias("average_precision"))


def regression(df: DataFrame, truth: str, pred: str, keys: list[str] = ()) -> DataFrame:
    """rmse, mae, r2 (1 for one row or no variance) and the number of rows; zeros for an empty table."""
    e = F.col(truth) - F.col(pred)
    x = df.groupBy(*keys).agg(F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("_sse"), F.var_pop(F.when(e.isNotNull(), F.col(truth))).alias("_v"))
    r2 = F.when(F.col("n") == 0, 0.0).when((F.col("n") <= 1) | (F.col("_v") <= 1e-9), 1.0).otherwise(1.0 - F.col("_sse") / F.nullif(F.col("n") * F.col("_v"), F.lit(0.0)))
    return x.select(*keys, "n", F.coalesce("rmse", F.lit(0.0)).alias("rmse"), F.coalesce("mae", F.lit(0.0)).alias("mae"), r2.alias("r2"))


def improvement(score: Column, baseline: Column, floor: float = 1e-6) -> Column:
    """Percent by which ``score`` is below ``baseline``."""
    return (baseline - score) / F.greatest(baseline, F.lit(floor)) * 100.0


def forecast(df: DataFrame, truth: str, pred: str, base: str, lead: str = "lead_h", station: str = "station") -> DataFrame:
    """RMSE of a forecast and of persistence, pooled, by lead and by station, in one pass."""
    square = lambda c: (F.col(truth) - F.col(c)) * (F.col(truth) - F.col(c))
    x = df.select(F.col(lead).alias("lead_h"), F.col(station).alias("station"), square(pred).alias("_p"), square(base).alias("_b"))
    g = x.groupingSets([[], ["lead_h"], ["station"]], "lead_h", "station").agg(F.sqrt(F.avg("_p")).alias("rmse"), F.sqrt(F.avg("_b")).alias("persistence_rmse"), F.count("_p").alias("n"))
    return g.withColumn("improvement_pct", improvement(F.col("rmse"), F.col("persistence_rmse")))


def blended(parts: dict[str, float]) -> Column:
    """A weighted mean of prediction columns; weights must be positive and are normalized."""
    if not parts or any(w < 0 for w in parts.values()) or sum(parts.values()) <= 0:
        raise ValueError("weights must be non-negative and not all zero")
    total = sum(parts.values())
    out = F.lit(0.0)
    for c, w in parts.items():
        out = out + F.col(c) * (w / total)
    return out


def rank_blend(base: Column, aux: Column, weight: float) -> Column:
    """Ranks that another score can only raise."""
    return F.greatest(base, (1 - weight) * base + weight * aux)


def filled(df: DataFrame, pred: str, default: float = 15.0, low: float | None = None, high: float | None = None) -> DataFrame:
    """Missing predictions get the mean prediction, ``default`` if there is none; then clipped."""
    mean = df.agg(F.avg(pred).alias("_mean"))
    return df.crossJoin(F.broadcast(mean)).withColumn(pred, clip(F.coalesce(pred, "_mean", F.lit(default)), low, high)).drop("_mean")


def verdict(a: DataFrame, b: DataFrame, keys: list[str], value: str, kind: str, limit: float) -> DataFrame:
    """One row: rows, differing, score (share of labels that differ, or RMSE), and whether it is within the limit.

    Tables with other keys are never within it.
    """
    if kind not in ("labels", "rmse"):
        raise ValueError(f"unknown kind {kind}")
    x = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_ia")).join(b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_ib")), keys, "full")
    other = ~F.col("_a").eqNullSafe(F.col("_b"))
    d = F.col("_a").cast("double") - F.col("_b").cast("double")
    score = F.avg(other.cast("double")) if kind == "labels" else F.sqrt(F.avg(d * d))
    y = x.agg(F.count(F.lit(1)).alias("rows"), F.count_if(other).alias("differing"), F.coalesce(score, F.lit(0.0)).alias("score"), F.count_if(F.col("_ia").isNull() | F.col("_ib").isNull()).alias("_odd"))
    return y.select("rows", "differing", "score", ((F.col("_odd") == 0) & (F.col("score") <= limit)).alias("within"))


def reconciled(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """Rows only in one table, rows that differ, the largest and the root mean square difference."""
    x = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_ia")).join(b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_ib")), keys, "full")
    d = F.abs(F.col("_a") - F.col("_b"))
    return x.agg(
        F.count_if(F.col("_ib").isNull()).alias("only_left"), F.count_if(F.col("_ia").isNull()).alias("only_right"), F.count_if((d > tolerance) | (F.col("_a").isNull() != F.col("_b").isNull()) & F.col("_ia").isNotNull() & F.col("_ib").isNotNull()).alias("differing"),
        F.max(d).alias("max_abs_diff"), F.sqrt(F.avg(d * d)).alias("rms_diff"),
    )
