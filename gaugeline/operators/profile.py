"""Vertical profiles: one row per (station, time, layer), boundaries above and below, what lies between."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clip, ratio
from .windows import Series, missing_run

#: Nominal depths of layers 1 to 8; deeper layers lie at ten times their number.
DEPTHS = {1: 4.18, 2: 6.87, 3: 9.83, 4: 14.87, 5: 19.15, 6: 30.21, 7: 49.05, 8: 49.35}


@dataclass(frozen=True)
class Profile:
    """Names of the columns, the bounding layers, and the layers that can stand in below."""

    key: tuple[str, ...] = ("station", "time")
    layer: str = "layer"
    value: str = "temp"
    order: tuple[str, ...] = ("row_id",)
    surface: int = 1
    bottom: int = 5
    deep: tuple[int, ...] = (6, 8)
    depths: dict[int, float] = field(default_factory=lambda: dict(DEPTHS))

    def depth(self, layer: int) -> float:
        return self.depths.get(layer, layer * 10.0)


def nominal_depths(df: DataFrame, p: Profile, depth: str) -> dict[int, float]:
    """Median depth of each layer, at most one row a layer, over the defaults."""
    rows = df.filter(F.col(depth).isNotNull()).groupBy(p.layer).agg(F.percentile(depth, 0.5).alias("d")).collect()
    return {**p.depths, **{int(r[p.layer]): float(r["d"]) for r in rows}}


def effective_depth(p: Profile, *columns: str) -> Column:
    """The first depth known, else the layer's nominal one."""
    table = F.lit(None).cast("double")
    nominal = F.col(p.layer) * 10.0
    for layer, d in p.depths.items():
        table = F.coalesce(table, F.when(F.col(p.layer) == layer, F.lit(d)))
    return F.coalesce(*[F.col(c) for c in columns], table, nominal)


def boundaries(df: DataFrame, p: Profile, extra: tuple[str, ...] = ()) -> DataFrame:
    """A row per key that has a surface or bottom value: first values of the bounding and deep layers.

    One aggregation, where separate scans of each layer would need joins; the first value is that of
    the least ``order``.
    """
    at = lambda layer, c: F.min(F.when((F.col(p.layer) == layer) & F.col(p.value).isNotNull() & F.col(c).isNotNull(), F.struct(*p.order, F.col(c).alias("_v"))))["_v"]
    columns = {"surf": at(p.surface, p.value), "bot": at(p.bottom, p.value), **{f"deep_{k}": at(k, p.value) for k in p.deep}}
    for c in extra:
        columns |= {f"surf_{c}": at(p.surface, c), f"bot_{c}": at(p.bottom, c)}
    out = df.groupBy(*p.key).agg(*[v.alias(k) for k, v in columns.items()])
    return out.filter("surf IS NOT NULL OR bot IS NOT NULL")


def shape_ratios(df: DataFrame, p: Profile, least: int = 100) -> dict[int, float]:
    """How far the bottom value lies off the straight line surface to deep layer, as a share of its span.

    The median over profiles that have all three, for deep layers with at least ``least`` of them.
    """
    b = boundaries(df, p)
    exprs = []
    for k in p.deep:
        span = F.col("surf") - F.col(f"deep_{k}")
        share = (p.depth(p.bottom) - p.depth(p.surface)) / max(p.depth(k) - p.depth(p.surface), 1.0)
        off = ratio(F.col("bot") - (F.col("surf") - share * span), F.when(F.abs(span) > 1e-6, span))
        exprs += [F.percentile(off, 0.5).alias(f"r{k}"), F.count(off).alias(f"n{k}")]
    row = b.agg(*exprs).first()
    return {k: float(row[f"r{k}"]) for k in p.deep if row[f"n{k}"] >= least}


def rebuilt_bottom(p: Profile, ratios: dict[int, float], default: float, surface: Column | None = None) -> tuple[Column, Column]:
    """The bottom value, rebuilt from the first deep layer there is, else ``default``; and whether it was observed."""
    surf = F.col("surf") if surface is None else surface
    tries = [F.col("bot")]
    for k in p.deep:
        share = (p.depth(p.bottom) - p.depth(p.surface)) / max(p.depth(k) - p.depth(p.surface), 1.0)
        deep = F.col(f"deep_{k}")
        tries.append(surf + share * (deep - surf) + ratios.get(k, 0.0) * (surf - deep))
    return F.coalesce(*tries, F.lit(default)), F.col("bot").isNotNull().cast("int")


def vertical(p: Profile, default: float, ratios: dict[int, float], depth: str = "effective_depth") -> list[dict[str, Column]]:
    """Steps of columns, each using the one before: boundary values, the interpolation, physical proxies."""
    span = max(p.depth(p.bottom) - p.depth(p.surface), 1.0)
    surf = F.coalesce("surf", F.lit(default))
    bottom, observed = rebuilt_bottom(p, ratios, default, surf)
    first = {"rel_depth_pos": clip((F.col(depth) - p.depth(p.surface)) / span, 0.0, 1.0), "surf_val": surf, "bot_val": bottom, "bot_is_observed": observed}
    s, b, r = F.col("surf_val"), F.col("bot_val"), F.col("rel_depth_pos")
    second = {
        "vertical_diff_span": s - b, "vertical_linear_interp": s + r * (b - s), "vertical_mean_boundary": (s + b) / 2.0, "vertical_gradient": (s - b) / span,
        "diff_to_surf": r * (b - s), "diff_to_bot": s + r * (b - s) - b, "stratification": F.greatest(s - b, F.lit(0.0)), "thermocline_proxy": F.abs(s - b) / span, "curvature_weight": 4.0 * r * (1.0 - r),
    }
    third = {"curved_estimate": F.col("vertical_linear_interp") - F.col("stratification") * 0.3 * F.col("curvature_weight")}
    if 6 in p.deep:
        d6 = F.coalesce("deep_6", b)
        shallow, deep = (s - b) / span, (b - d6) / max(p.depth(6) - p.depth(p.bottom), 1.0)
        third |= {
            "deep_6_val": d6, "gradient_surf_to_deep6": (s - d6) / max(p.depth(6) - p.depth(p.surface), 1.0), "grad_deep_5_6": deep, "grad_ratio_deep_shallow": deep / (F.abs(shallow) + 1e-6),
            "thermocline_sharpness": deep - shallow, "depth_rel_thermocline": F.col(depth) / max(p.depth(p.bottom), 1.0) * deep / (F.abs(deep) + F.abs(shallow) + 1e-6),
        }
    if 8 in p.deep:
        third |= {"deep_8_val": F.coalesce("deep_8", b), "gradient_surf_to_deep8": (s - F.coalesce("deep_8", b)) / max(p.depth(8) - p.depth(p.surface), 1.0)}
    return [first, second, third]


def boundary_history(df: DataFrame, s: Series, columns: list[str], offsets=(1, 2, 6), w: int = 6) -> DataFrame:
    """Lags that fall back to the current value, and a rolling mean and std (0 for one row) that end here."""
    out = {}
    for c in columns:
        out |= {f"{c}_lag{k}": F.coalesce(F.lag(c, k).over(s.window), F.col(c)) for k in offsets}
        out |= {f"{c}_roll_mean_{w}": F.coalesce(F.avg(c).over(s.until(w)), F.col(c)), f"{c}_roll_std_{w}": F.coalesce(F.stddev_samp(c).over(s.until(w)), F.lit(0.0))}
    return df.withColumns(out)


def boundary_gap(df: DataFrame, p: Profile, layer: int, station: str = "station", time: str = "time") -> DataFrame:
    """Times in a row, per station, at which ``layer`` has no value; beside every row of that time."""
    seen = df.groupBy(station, time).agg(F.max(F.when(F.col(p.layer) == layer, F.col(p.value))).alias("_v"))
    return df.join(missing_run(seen, Series((station,), (time,)), "_v", "boundary_gap").drop("_v"), [station, time], "left")


def neighbour_gaps(df: DataFrame, p: Profile) -> DataFrame:
    """Difference to the next layer above and below, where layers are adjacent in the list of all layers.

    A layer missing from a profile leaves a gap; it doesn't make the layers around it neighbours.
    """
    means = df.groupBy(*p.key, p.layer).agg(F.avg(p.value).alias("_v"))
    ordered = W.orderBy(p.layer)  # a row per layer
    ranks = means.select(p.layer).distinct().withColumn("_rank", F.row_number().over(ordered))
    ranked = means.join(F.broadcast(ranks), p.layer)
    other = ranked.select(*p.key, F.col("_rank").alias("_r"), F.col("_v").alias("_o"))
    up = other.select(*p.key, (F.col("_r") + 1).alias("_rank"), F.col("_o").alias("_above"))
    down = other.select(*p.key, (F.col("_r") - 1).alias("_rank"), F.col("_o").alias("_below"))
    gaps = ranked.join(up, [*p.key, "_rank"], "left").join(down, [*p.key, "_rank"], "left")
    gaps = gaps.select(*p.key, p.layer, (F.col("_v") - F.col("_above")).alias("grad_upper"), (F.col("_v") - F.col("_below")).alias("grad_lower"))
    return df.join(gaps, [*p.key, p.layer], "left")


def wide(df: DataFrame, p: Profile, layers: list[int], how: str = "first") -> DataFrame:
    """A column per layer: the first value by ``order``, or the mean."""
    if how == "mean":
        pick = lambda k: F.avg(F.when(F.col(p.layer) == k, F.col(p.value)))
    else:
        pick = lambda k: F.min(F.when((F.col(p.layer) == k) & F.col(p.value).isNotNull(), F.struct(*p.order, F.col(p.value).alias("_v"))))["_v"]
    return df.groupBy(*p.key).agg(*[pick(k).alias(f"layer_{k}") for k in layers])


def long(df: DataFrame, p: Profile, layers: list[int]) -> DataFrame:
    """The inverse of ``wide``; nulls make no rows."""
    return df.unpivot(list(p.key), [f"layer_{k}" for k in layers], "_name", p.value).filter(F.col(p.value).isNotNull()).withColumn(p.layer, F.substring("_name", 7, 9).cast("int")).drop("_name")
