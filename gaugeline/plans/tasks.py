"""Three tasks run from a configuration: load, check, look, split, features, train, predict, deliver."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import grid as gr
from ..operators import metrics as me
from ..operators import quality as qa
from ..operators import splits as sp
from ..operators import windows as win
from ..operators import statistics as st
from ..operators.windows import Series
from ..sources import readers, writers
from . import models
from .plugins import AnomalyFeatures, ProfileFeatures, WaveFeatures
from .tracking import Tracker

TASKS: dict[str, type["Task"]] = {}


def register(name: str):
    def add(cls):
        cls.name, TASKS[name] = name, cls
        return cls

    return add


def create(name: str, spark: SparkSession, config: dict) -> "Task":
    if name not in TASKS:
        raise KeyError(f"unknown task {name}; there are {sorted(TASKS)}")
    return TASKS[name](spark, config)


class Task(ABC):
    """The steps in order; each is one or a few lazy plans, run where a model is fitted or a file written."""

    name = "task"
    required: dict[str, list[str]] = {}

    def __init__(self, spark: SparkSession, config: dict):
        self.spark, self.config = spark, config
        self.tables: dict[str, DataFrame | None] = {}
        self.metrics: dict[str, float] = {}

    def load(self) -> None:
        paths = self.config["dataset"]
        self.tables = readers.read_all(self.spark, paths, {n for n in self.required if n in paths})

    def check(self) -> None:
        for name, columns in self.required.items():
            if self.tables.get(name) is not None:
                qa.require(self.tables[name], columns, name, filled=name == "train")

    def look(self) -> str:
        return writers.report(self.name, {f"nulls of {n}": qa.null_counts(t) for n, t in self.tables.items() if t is not None})

    @abstractmethod
    def train(self) -> None: ...

    @abstractmethod
    def predict(self) -> DataFrame: ...

    def run(self) -> DataFrame:
        self.load()
        self.check()
        if path := self.config.get("report"):
            writers.text(self.spark, path, self.look())
        self.train()
        out = self.predict()
        if root := self.config.get("experiments"):
            name, score = next(iter(self.metrics.items()), ("none", 0.0))
            Tracker(self.spark, root).save({"task_type": self.name, "model": "gbt", "metric": {"metric_name": name, "score": score}, "metrics": self.metrics, "config": {k: str(v) for k, v in self.config.items()}})
        return out


@register("anomaly_qc")
class AnomalyTask(Task):
    """Flags readings: a class probability, blended over presets, cut at a rate of positives."""

    required = {"train": ["time", "station", "layer", "temp", "label"]}

    def _context(self, df: DataFrame) -> DataFrame:
        df = df if "row_id" in df.columns else readers.with_row_id(df, [c for c in df.columns if c not in ("label", "anomaly_type")])
        df = df.withColumns({"time": F.col("time").cast("timestamp_ntz"), "series": sc.series_key("station", "layer")})
        x = st.group_spread(df, "temp", ["station", "time"])
        s = Series(("series",), ("time", "row_id"))
        x = x.withColumn("dev_resid_long", win.baseline_residual(s, "temp_dev_layers")).withColumn("temp_resid_long", win.baseline_residual(s, "temp"))
        return win.volatility_ratio(x, s, "temp")

    def train(self) -> None:
        f = self.config.get("feature", {})
        values = f.get("values", ["temp"])
        x = sp.by_row_count(self._context(self.tables["train"]), ["time", "series", "row_id"], self.config.get("validation", {}).get("test_size", 0.2))
        self.parts = []
        drop = ["label", "row_id", "id", "anomaly_type"]
        scored = None
        for preset, weight in f.get("presets", {"standard": 1.0}).items():
            plan = AnomalyFeatures(values, ("series",), preset=preset, windows=f.get("windows", (12, 48, 288)))
            plugin = plan.fit(x.filter("part = 'train'"))
            wide = plugin.transform(x)
            columns = models.feature_columns(wide, drop)
            make = lambda: models.Boosted(columns, "label", "classification", params=self.config.get("model", {}))
            fitted = make().fit(wide.filter("part = 'train'"))
            p = fitted.predict(wide.filter("part = 'valid'"), f"p_{preset}").select("row_id", "label", f"p_{preset}")
            scored = p if scored is None else scored.join(p.drop("label"), "row_id")
            self.parts.append((preset, weight, plan.fit(x).transform, make().fit(plan.fit(x).transform(x))))
        self.rate = self.config.get("rate") or x.agg(F.avg(F.col("label").cast("double"))).first()[0]
        blended = scored.withColumn("p", me.blended({f"p_{n}": w for n, w, _, _ in self.parts}))
        row = me.classification(me.flagged(blended, "p", self.rate), "label", "pred").first()
        self.metrics = {k: row[k] for k in ("f1", "precision", "recall", "macro_f1", "accuracy")} | {k: v for k, v in me.ranking(blended, "label", "p").first().asDict().items() if v is not None}

    def predict(self) -> DataFrame:
        test = self._context(self.tables["test"] if self.tables.get("test") is not None else self.tables["train"])
        out = None
        for preset, _, features, model in self.parts:
            p = model.predict(features(test), f"p_{preset}").select("row_id", f"p_{preset}")
            out = p if out is None else out.join(p, "row_id")
        out = me.flagged(out.withColumn("p", me.blended({f"p_{n}": w for n, w, _, _ in self.parts})), "p", self.rate, "label")
        return test.select(*[c for c in ("id", "station", "layer", "time", "row_id") if c in test.columns]).join(out.select("row_id", "p", "label"), "row_id")


@register("profile_reconstruction")
class ReconstructionTask(Task):
    """Fills hidden layers: what a model adds to the interpolation between the boundaries."""

    required = {"train": ["time", "station", "layer", "temp"]}

    def _ready(self, df: DataFrame) -> DataFrame:
        df = df if "row_id" in df.columns else readers.with_row_id(df, [c for c in ("station", "layer", "time") if c in df.columns])
        return df.withColumn("time", F.col("time").cast("timestamp_ntz"))

    def train(self) -> None:
        layers = self.config.get("layers", [2, 3, 4])
        v = self.config.get("validation", {})
        f = self.config.get("feature", {})
        x = sp.by_distinct_time(self._ready(self.tables["train"]), "time", v.get("test_size", 0.2))
        if rate := f.get("boundary_dropout"):
            dropped = sp.dropout(x, "time", "layer", 5, rate, f.get("boundary_dropout_seed", 42))
        else:
            dropped = x
        hide = F.col("layer").isin(layers) & (F.col("part") == "valid") & sp.random_mask(v.get("mask_ratio", 0.3), v.get("random_state", 42), "station", "layer", "time")
        masked = sp.masked(x, hide, ["temp"], "temp")
        self.plugin = ProfileFeatures(f.get("preset", "r3"), depth=f.get("depth", "depth")).fit(dropped.filter("part = 'train'"))
        rows = self.plugin.transform_with(dropped.filter("part = 'train'").filter(F.col("layer").isin(layers) & F.col("temp").isNotNull()), dropped)
        if f.get("deep_profile_weight"):
            rows = sp.rich_weights(rows, "time", "layer", [6, 7, 8], 1, f["deep_profile_weight"])
        columns = models.feature_columns(rows, ["temp", "truth", "row_id", "weight", "part"])
        direct = self.config.get("strategy", "residual") == "direct"
        self.model = models.Grouped(columns, "temp", "layer" if self.config.get("model_mode", "per_layer") == "per_layer" else None, None if direct else "vertical_linear_interp", "weight" if "weight" in rows.columns else None, self.config.get("model", {})).fit(rows)
        valid = self.model.predict(self.plugin.transform_with(masked.filter("is_masked"), masked))
        row = me.regression(valid, "truth", "prediction").first()
        base = me.regression(valid, "truth", "vertical_linear_interp").first()
        self.metrics = {"rmse": row["rmse"], "mae": row["mae"], "r2": row["r2"], "linear_rmse": base["rmse"] if base["n"] else 999.0}

    def predict(self) -> DataFrame:
        record = self._ready(self.tables["train"])
        index = self._ready(self.tables["test"]) if self.tables.get("test") is not None else record.filter(F.col("layer").isin(self.config.get("layers", [2, 3, 4])))
        out = me.filled(self.model.predict(self.plugin.transform_with(index.drop("temp"), record), "temp"), "temp", 15.0)
        return out.select("station", "layer", "time", "temp")


@register("wave_forecast")
class ForecastTask(Task):
    """Forecasts several leads of a gridded series from 48 hours of context, on top of persistence."""

    required = {"wave": ["station", "time", "hs"]}
    #: One model of all leads, one a lead, or one a lead on what persistence leaves.
    modes = ("unified", "per_horizon", "persistence_residual")

    def _grid(self) -> DataFrame:
        at = lambda df: df.withColumn("minute", gr.minute("time"))
        wave, atmos = at(self.tables["wave"]), self.tables.get("atmos")
        ends = wave.agg(F.min("minute"), F.max("minute")).first()
        full = gr.regular(wave.select("station").distinct(), ends[0], ends[1])
        tables = [gr.unique_times(wave, [c for c in wave.columns if c not in ("station", "time", "minute")], ["time"])]
        if atmos is not None:
            a = at(atmos)
            tables.append(gr.unique_times(a, [c for c in a.columns if c not in ("station", "time", "minute")], ["time"]))
        return gr.aligned(full, *tables)

    def train(self) -> None:
        leads = tuple(self.config.get("leads", gr.LEADS))
        v = self.config.get("validation", {})
        g = self._grid()
        s = Series(("station",), ("minute",))
        cases = gr.eligible(g, s, "hs", leads, threshold=self.config.get("hs_threshold", 1.5)).select("station", "minute", *[f"target_{h}h" for h in leads])
        cut = v.get("cut") or cases.agg(F.floor(F.percentile("minute", 0.8)).cast("long")).first()[0]
        split = sp.forward_split(cases, cut, v.get("end", 1 << 40), stride=v.get("dense_stride_steps", 2))
        plugin = WaveFeatures(("station", "minute"))
        self.features = lambda contexts: plugin.transform(contexts)
        ctx = gr.contexts(split.select("station", "minute"), g).withColumnRenamed("ref_minute", "minute")
        rows = self.features(ctx).join(split, ["station", "minute"]).withColumn("persistence", gr.persistence(F.col("latest_hs")))
        columns = models.feature_columns(rows, ["minute", "persistence", *[f"target_{h}h" for h in leads]])
        weight = None
        if w := self.config.get("wind_blind_weight"):
            if "wspd" in ctx.columns:
                rows = rows.join(sp.coverage_weights(ctx, ["station", "minute"], "wspd", w), ["station", "minute"])
                weight = "weight"
        mode = self.config.get("model_mode", "persistence_residual")
        if mode not in self.modes:
            raise ValueError(f"unknown model_mode {mode}; there are {self.modes}")
        base = "persistence" if mode == "persistence_residual" or self.config.get("strategy") == "residual" else None
        # a row per case and lead; a case's weight stands in each
        target = F.coalesce(*[F.when(F.col("lead_h") == h, F.col(f"target_{h}h")) for h in leads])
        long = self._leads(rows, leads).withColumn("y", target)
        train = long.filter("part = 'train'")
        make = lambda more, data: models.Grouped([*columns, *more], "y", None, base, weight, self.config.get("model", {})).fit(data)
        self.models = {None: make(["lead_h"], train)} if mode == "unified" else {h: make([], train.filter(F.col("lead_h") == h)) for h in leads}
        scored = self._forecast(long.filter("part = 'valid'"), "p").select("station", "minute", "lead_h", "y", sc.clip(F.col("p"), 0.0, None).alias("p"), "persistence")
        self.scores = me.forecast(scored, "y", "p", "persistence")
        pooled = self.scores.filter("lead_h IS NULL AND station IS NULL").first()
        self.metrics = {"rmse": pooled["rmse"] or 0.0, "persistence_rmse": pooled["persistence_rmse"] or 0.0}

    def predict(self) -> DataFrame:
        contexts = self.tables.get("context")
        if contexts is None:
            return self.scores
        x = contexts.withColumn("minute", F.col("case_id"))
        rows = WaveFeatures(("station", "minute")).transform(x).withColumn("persistence", gr.persistence(F.col("latest_hs")))
        if (official := self.tables.get("baseline")) is not None:
            gr.check_persistence(rows.select(F.col("minute").alias("case_id"), "persistence"), official)
        out = self._forecast(self._leads(rows, tuple(self.config.get("leads", gr.LEADS))), "hs_pred")
        return out.select(F.col("minute").alias("case_id"), "station", "lead_h", sc.clip(F.coalesce("hs_pred", "persistence"), 0.0, 30.0).alias("hs_pred"))

    def _leads(self, rows: DataFrame, leads: tuple[int, ...]) -> DataFrame:
        return rows.withColumn("lead_h", F.explode(F.array(*[F.lit(h) for h in leads])))

    def _forecast(self, long: DataFrame, name: str) -> DataFrame:
        """Each row's prediction, by the model of its lead or the one of all."""
        if None in self.models:
            return self.models[None].predict(long, name)
        out = None
        for h, m in self.models.items():
            p = m.predict(long.filter(F.col("lead_h") == h), name)
            out = p if out is None else out.unionByName(p)
        return out
