"""Experiment records: JSON files, one a run, and tables over them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import readers, writers

SCHEMA = (
    "experiment_id string, created_at string, task_type string, dataset_name string, model string, random_seed int, feature_preset string, feature_count int, feature_names array<string>, "
    "train_rows long, validation_rows long, training_time double, inference_time double, metric struct<metric_name:string,score:double>, metrics map<string,double>, git_commit string, tags array<string>, user_note string, config map<string,string>"
)
#: Parts of metric names for which less is better.
LOWER = ("rmse", "mae", "mse", "loss", "error")


def lower_is_better(name: Column) -> Column:
    out = F.lit(False)
    for part in LOWER:
        out = out | F.lower(name).contains(part)
    return out


def signed(name: Column, score: Column) -> Column:
    """Sorts the best first, whichever way the metric goes."""
    return F.when(lower_is_better(name), score).otherwise(-score)


def ranked(df: DataFrame, name: str = "metric_name", score: str = "score", tie: str = "experiment_id") -> DataFrame:
    """Ranks from 1 within each metric, best first."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(name).orderBy(signed(F.col(name), F.col(score)).asc_nulls_last(), tie)).cast("long"))


def following(df: DataFrame, ids: str, prefix: str, width: int = 3) -> DataFrame:
    """next_id, last: the prefix and one more than the largest number that follows it (1 if none does), at least ``width`` digits; that largest number.  One row."""
    last = F.max(F.regexp_extract(ids, rf"^{prefix}(\d+)$", 1).try_cast("int"))
    return df.agg(F.concat(F.lit(prefix), F.format_string(f"%0{width}d", F.coalesce(last, F.lit(0)) + 1)).alias("next_id"), last.alias("last"))


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """key, left, right where two tables of (key, left) and (key, right) don't agree."""
    return left.join(right, "key", "full").filter(~F.col("left").eqNullSafe(F.col("right")))


class Tracker:
    """Records below ``root``.  One run at a time is active between ``start`` and ``finish``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.active = spark, root.rstrip("/"), None

    def all(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return readers.empty(self.spark, SCHEMA)
        return readers.records(self.spark, self.root, SCHEMA).filter("experiment_id IS NOT NULL")

    def next_id(self, today: dt.date | None = None) -> str:
        return following(self.all(), "experiment_id", f"EXP_{(today or dt.datetime.now(dt.timezone.utc).date()):%Y%m%d}_").first()[0]

    def save(self, record: dict) -> str:
        record = {"experiment_id": record.get("experiment_id") or self.next_id(), "created_at": record.get("created_at") or dt.datetime.now(dt.timezone.utc).isoformat(), **{k: v for k, v in record.items() if k not in ("experiment_id", "created_at")}}
        writers.record(self.spark, f"{self.root}/{record['experiment_id']}/metadata.json", record)
        return record["experiment_id"]

    def start(self, task_type: str, dataset_name: str, model: str, **fields) -> str:
        """A record without a metric yet; its id."""
        if self.active:
            raise RuntimeError(f"{self.active} is active; finish it first")
        names = list(fields.get("feature_names") or [])
        self.active = self.save({**fields, "task_type": task_type, "dataset_name": dataset_name, "model": model, "feature_names": names, "feature_count": len(names)})
        self.save_leaderboard()
        return self.active

    def finish(self, metric_name: str, score: float, experiment_id: str | None = None, **fields) -> dict:
        """The active run's record, or the named one's, with its metric and whatever else is given."""
        at = experiment_id or self.active
        if not at:
            raise RuntimeError("no run is active")
        record = self.load(at) | {k: v for k, v in fields.items() if v is not None}
        record |= {"metric": {"metric_name": metric_name, "score": float(score)}, "feature_count": len(record.get("feature_names") or [])}
        self.save(record)
        writers.text(self.spark, f"{self.root}/{at}/report.md", "\n".join([f"# {at}", "", *[f"* {k}: {v}" for k, v in sorted(record.items()) if v is not None], ""]))
        self.save_leaderboard()
        self.active = None
        return record

    def load(self, experiment_id: str) -> dict:
        rows = self.all().filter(F.col("experiment_id") == experiment_id).collect()
        if not rows:
            raise KeyError(experiment_id)
        return rows[0].asDict(recursive=True)

    def find(self, metric: str | None = None, above: float | None = None, below: float | None = None, tags: tuple[str, ...] = (), **equal: str) -> DataFrame:
        """Records by metric name, by score over or under a bound, by tags that all are there, and by equal columns."""
        out = self.all()
        if metric is not None:
            out = out.filter(F.col("metric.metric_name") == metric)
        if above is not None:
            out = out.filter(F.col("metric.score") > above)
        if below is not None:
            out = out.filter(F.col("metric.score") < below)
        for tag in tags:
            out = out.filter(F.array_contains("tags", tag))
        for column, value in equal.items():
            out = out.filter(F.col(column) == value)
        return out

    def best(self, metric: str | None = None) -> DataFrame:
        x = self.all().select("*", "metric.*").filter("score IS NOT NULL")
        x = x.filter(F.col("metric_name") == metric) if metric else x
        return ranked(x).filter("rank = 1").drop("rank", "metric_name", "score")

    def latest(self) -> DataFrame:
        return self.all().orderBy(F.desc("created_at"), F.desc("experiment_id")).limit(1)

    def leaderboard(self) -> DataFrame:
        x = ranked(self.all().select("experiment_id", "metric.metric_name", "metric.score", "created_at", "model", "feature_preset"))
        shown = F.concat_ws(":", "metric_name", F.col("score").cast("string"))
        return x.select(F.col("experiment_id").alias("Experiment"), shown.alias("Metric"), F.col("created_at").alias("Date"), F.col("model").alias("Model"), F.col("feature_preset").alias("Preset"), F.col("rank").alias("Rank"))

    def save_leaderboard(self) -> None:
        """One CSV file in the folder ``leaderboard``, best first."""
        x = self.leaderboard()
        writers.delivery(x, f"{self.root}/leaderboard", x.columns, ["Rank", "Experiment"])

    def compare(self, a: str, b: str) -> DataFrame:
        """key, left, right: settings and metrics in which two runs differ."""
        side = lambda i, name: self.all().filter(F.col("experiment_id") == i).select(F.explode(F.map_concat(F.coalesce("config", F.create_map().cast("map<string,string>")), F.coalesce(F.transform_values("metrics", lambda k, v: v.cast("string")), F.create_map().cast("map<string,string>")))).alias("key", name))
        return differing(side(a, "left"), side(b, "right"))
