"""Feature plugins: fitted on training rows, applied anywhere."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model, Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import grid as gr
from ..operators import profile as pr
from ..operators import statistics as st
from ..operators import windows as win
from ..operators.windows import Series

#: Rolling statistics of each preset.
PRESETS = {"light": ("mean", "std", "min", "max"), "standard": ("mean", "std", "min", "max", "median", "range"), "full": win.STATISTICS}


def _seasons(time: str) -> dict[str, tuple]:
    return {"month": (F.month(time), 12), "doy": (F.dayofyear(time), 365), "hour": (F.hour(time), 24), "dow": (F.weekday(time), 7)}


class AnomalyFeatures(Estimator):
    """Causal statistics of each value column of many series, and robust scores fitted on training.

    presets: light, standard (adds unique counts and spread ratios), full (adds MAD).  Leakage is by
    group and time: statistics end before the current row, and what is fitted sees training only.
    """

    leakage_unit = "group_time"

    def __init__(self, values: list[str], keys=("station", "layer"), time: str = "time", order=("time", "row_id"), preset: str = "standard", windows=(12, 48, 288), lags=(1, 2, 3, 6, 12), offset_keys: list[str] = (), seasonal: bool = True):
        super().__init__()
        if preset not in PRESETS:
            raise ValueError(f"preset must be one of {sorted(PRESETS)}")
        self.values, self.series, self.time, self.preset, self.windows, self.lags, self.offset_keys, self.seasonal = list(values), Series(tuple(keys), tuple(order)), time, preset, tuple(windows), tuple(lags), list(offset_keys), seasonal

    def _fit(self, train: DataFrame) -> "AnomalyFeaturesModel":
        seasons = []
        if self.seasonal:  # parts that don't vary in training say nothing
            parts = _seasons(self.time)
            row = train.agg(*[F.count_distinct(x).alias(n) for n, (x, _) in parts.items()]).first()
            seasons = [n for n in parts if row[n] > 1]
        offsets = {k: train.groupBy(k).agg(*[F.avg(v).alias(f"_o_{v}") for v in self.values]) for k in self.offset_keys}
        overall = train.agg(*[F.avg(v).alias(f"_a_{v}") for v in self.values])
        return AnomalyFeaturesModel(self, st.robust(train, self.values), seasons, offsets, overall)


class AnomalyFeaturesModel(Model):
    def __init__(self, plan: AnomalyFeatures, robust: DataFrame, seasons: list[str], offsets: dict[str, DataFrame], overall: DataFrame):
        super().__init__()
        self.plan, self.robust, self.seasons, self.offsets, self.overall = plan, robust, seasons, offsets, overall

    def _transform(self, df: DataFrame) -> DataFrame:
        p, s = self.plan, self.plan.series
        out: dict = {}
        for v in p.values:
            out |= win.lags(s, v, p.lags) | win.differences(s, v) | win.rolling(s, v, p.windows, PRESETS[p.preset]) | win.residuals(s, v, p.windows)
            if p.preset != "light":
                out |= {f"{v}_uniq_count_{w}": win.unique_count(s, v, w) for w in p.windows}
        out |= {f"{f}_{n}": c for n in self.seasons for f, c in zip(("sin", "cos"), sc.cyclic(*_seasons(p.time)[n]))}
        x = df.withColumns(out)
        for v in p.values:
            x = win.with_slopes(x, s, v, p.windows)
            x = win.run_length(x, s, v)
            if p.preset == "full":
                for w in p.windows:
                    x = win.rolling_mad(x, s, v, w)
            x = win.ema(x, s, v, p.windows)
        for v in p.values:
            x = st.robust_scores(x, self.robust.select(*[c for c in self.robust.columns if c.startswith(f"{v}_")]), v)
        for k, table in self.offsets.items():
            x = x.join(table, k, "left").crossJoin(F.broadcast(self.overall))  # one row of overall means
            x = x.withColumns({f"{v}_dev_{k}_mean": F.col(v) - F.coalesce(f"_o_{v}", f"_a_{v}") for v in p.values}).drop(*[f"_{i}_{v}" for v in p.values for i in "oa"])
        return x


@dataclass
class ProfileState:
    default: float
    depths: dict[int, float]
    ratios: dict[int, float]
    climatology: list[DataFrame] = field(default_factory=list)


class ProfileFeatures(Estimator):
    """Boundary values, an interpolation between them, climatology and physical proxies for each row.

    presets: light (interpolation and climatology), r1 (adds harmonics), r2 (adds proxies), standard, r3
    and h1 (add boundary history), full (adds interactions).
    """

    leakage_unit = "time"
    GATES = {"light": (), "r1": ("season",), "r2": ("season", "physical"), "r3": ("season", "physical", "history"), "h1": ("season", "physical", "history"), "standard": ("season", "physical", "history"), "full": ("season", "physical", "history", "extra")}

    def __init__(self, preset: str = "standard", station: str = "station", time: str = "time", layer: str = "layer", value: str = "temp", depth: str | None = "depth", order=("row_id",), deep=(6, 8), least: int = 100):
        super().__init__()
        if preset not in self.GATES:
            raise ValueError(f"preset must be one of {sorted(self.GATES)}")
        self.preset, self.station, self.time, self.value, self.depth, self.least = preset, station, time, value, depth, least
        self.profile = pr.Profile((station, time), layer, value, tuple(order), deep=tuple(deep))

    @property
    def grains(self) -> list[list[str]]:
        return [[self.station, self.profile.layer, "_month"], [self.profile.layer, "_month"], [self.profile.layer], []]

    def _fit(self, train: DataFrame) -> "ProfileFeaturesModel":
        known = train.filter(F.col(self.value).isNotNull()).withColumn("_month", F.month(self.time))
        default = known.agg(F.coalesce(F.avg(self.value), F.lit(15.0))).first()[0]
        depths = pr.nominal_depths(train, self.profile, self.depth) if self.depth and self.depth in train.columns else dict(self.profile.depths)
        self.profile = pr.Profile(self.profile.key, self.profile.layer, self.value, self.profile.order, self.profile.surface, self.profile.bottom, self.profile.deep, depths)
        return ProfileFeaturesModel(self, ProfileState(default, depths, pr.shape_ratios(known, self.profile, self.least), st.climatology(known, self.value, self.grains)))


class ProfileFeaturesModel(Model):
    def __init__(self, plan: ProfileFeatures, state: ProfileState):
        super().__init__()
        self.plan, self.state = plan, state

    def transform_with(self, df: DataFrame, observations: DataFrame) -> DataFrame:
        """Features of ``df`` whose boundary values come from ``observations``."""
        plan, p, gates = self.plan, self.plan.profile, self.plan.GATES[self.plan.preset]
        b = pr.boundaries(observations, p)
        depth = [c for c in (plan.depth, "nominal_depth") if c and c in df.columns]
        x = df.join(b, list(p.key), "left").withColumns({"effective_depth": pr.effective_depth(p, *depth), "_month": F.month(plan.time)})
        steps = pr.vertical(p, self.state.default, self.state.ratios)
        for step in steps if "physical" in gates else steps[:1]:
            x = x.withColumns(step)
        if "physical" not in gates:
            s, bt, r = F.col("surf_val"), F.col("bot_val"), F.col("rel_depth_pos")
            x = x.withColumns({"vertical_linear_interp": s + r * (bt - s), "vertical_diff_span": s - bt, "vertical_mean_boundary": (s + bt) / 2.0})
        x = st.fallback(x, self.state.climatology, plan.grains, "climatology", self.state.default)
        x = x.withColumn("climatology_diff_linear", F.col("vertical_linear_interp") - F.col("climatology"))
        if "season" in gates:
            cols = {}
            for n, (e, period) in {"hour": (F.hour(plan.time), 24.0), "doy": (F.dayofyear(plan.time), 365.25)}.items():
                cols[f"sin_{n}"], cols[f"cos_{n}"] = sc.cyclic(e, period)
            x = x.withColumns(cols)
        if "physical" in gates:
            x = x.withColumn("is_thermocline_season", F.col("_month").between(6, 10).cast("double"))
        if "history" in gates:
            x = pr.boundary_history(x, Series((plan.station,), (plan.time, p.layer, *p.order)), ["surf_val", "bot_val"])
        if "extra" in gates:
            x = x.withColumns({"depth_temp_interaction": F.col("effective_depth") * F.col("surf_val"), "climatology_ratio": (F.col("vertical_linear_interp") + 1e-5) / (F.col("climatology") + 1e-5)})
        return x.drop("_month")

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.transform_with(df, df)


class WaveFeatures(Transformer):
    """Features of case contexts: a row per case out."""

    leakage_unit = "none"

    def __init__(self, keys=("case_id", "station"), value: str = "hs", wind: str | None = "wspd", gust: str | None = "gust", height: str | None = "caph", others=("tp", "hmax", "airt", "relh"), wave_direction: str = "wvdir", wind_direction: str = "wdir", stations: list[str] = (), hours=(1, 3, 6, 12, 24, 48)):
        super().__init__()
        self.keys, self.value, self.wind, self.gust, self.height, self.others, self.directions, self.stations, self.hours = list(keys), value, wind, gust, height, tuple(others), (wave_direction, wind_direction), list(stations), tuple(hours)

    def _transform(self, df: DataFrame) -> DataFrame:
        has = lambda c: c if c and c in df.columns else None
        x = gr.range_features(df, self.keys, self.value, has(self.wind), has(self.gust), has(self.height), self.hours)
        latest = [c for c in (*self.others, *self.directions, self.gust, self.height) if has(c)]
        if latest:
            at = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("step_minute", F.col(c).alias("v"))))["v"]
            x = x.join(df.groupBy(*self.keys).agg(*[at(c).alias(f"latest_{c}") for c in latest]), self.keys)
        out = {}
        for c in self.directions:
            if has(c):
                out[f"sin_{c}"], out[f"cos_{c}"] = sc.direction(F.col(f"latest_{c}"))
        if all(map(has, self.directions)):
            out["sin_wind_wave_diff"], out["cos_wind_wave_diff"] = gr.direction_difference(F.col(f"latest_{self.directions[1]}"), F.col(f"latest_{self.directions[0]}"))
        v = F.col(f"latest_{self.value}")
        if has("hmax"):
            out["steepness"] = F.col("latest_hmax") / (v + 1e-4)
        if has("tp"):
            out["power"] = v * v * F.col("latest_tp")
        if "station" in self.keys:
            out |= sc.one_hot(F.col("station"), self.stations, "station_")
        return x.withColumns(out) if out else x
