"""Gradient-boosted trees on panel features: residuals on a baseline, one model per group, ensembles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hash_uniform
from ..sources import readers, writers


def feature_columns(df: DataFrame, drop: list[str], *others: DataFrame) -> list[str]:
    """Numeric columns that all tables have, in the order of the first."""
    shared = set.intersection(*[set(o.columns) for o in (df, *others)])
    return [n for n, t in df.dtypes if n not in drop and n in shared and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]


@dataclass
class Boosted:
    """A regressor or a classifier; null features get the training median and, beside it, a flag."""

    features: list[str]
    target: str
    task: str = "regression"
    weight: str | None = None
    params: dict = field(default_factory=dict)
    seeds: tuple[int, ...] = (42,)
    models: list[PipelineModel] = field(default_factory=list)

    def _ready(self, df: DataFrame) -> DataFrame:
        x = df.withColumns({f"_d_{c}": F.col(c).cast("double") for c in self.features})
        return x.withColumns({f"_n_{c}": F.col(c).isNull().cast("double") for c in self.features})

    def fit(self, df: DataFrame) -> "Boosted":
        df = df.filter(F.col(self.target).isNotNull())
        known = df.agg(*[F.count(c).alias(c) for c in self.features]).first()
        self.features = [c for c in self.features if known[c]]  # a column without a value says nothing
        x = self._ready(df).withColumn(self.target, F.col(self.target).cast("double"))
        ins = [f"_d_{c}" for c in self.features]
        stages = [Imputer(strategy="median", inputCols=ins, outputCols=[f"_f_{c}" for c in self.features]), VectorAssembler(inputCols=[f"_f_{c}" for c in self.features] + [f"_n_{c}" for c in self.features], outputCol="_x")]
        kind = GBTRegressor if self.task == "regression" else GBTClassifier
        self.models = []
        for seed in self.seeds:
            tree = kind(featuresCol="_x", labelCol=self.target, seed=seed, **{"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8} | self.params)
            if self.weight:
                tree = tree.setWeightCol(self.weight)
            self.models.append(Pipeline(stages=[*stages, tree]).fit(x))
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Adds the mean over seeds: a value, or the probability of class 1."""
        keep, parts = df.columns, []
        x = self._ready(df)
        for i, model in enumerate(self.models):
            x = model.transform(x)
            p = F.col("prediction") if self.task == "regression" else F.get(vector_to_array("probability"), F.lit(1))
            x = x.withColumn(f"_p{i}", p).drop("prediction", "probability", "rawPrediction", "_x", *[f"_f_{c}" for c in self.features])
            parts.append(F.col(f"_p{i}"))
        return x.select(*[c for c in keep if c != name], (sum(parts, F.lit(0.0)) / len(parts)).alias(name))

    def save(self, path: str) -> None:
        """The models, their schema, and a manifest of the files' hashes."""
        spark = SparkSession.active()
        for i, m in enumerate(self.models):
            m.write().overwrite().save(f"{path}/models/seed-{i}")
        writers.record(spark, f"{path}/schema.json", {"features": self.features, "target": self.target, "task": self.task, "seeds": list(self.seeds)})
        writers.record(spark, f"{path}/manifest.json", {r["name"]: r["sha256"] for r in readers.file_hashes(spark, f"{path}/models", "part-*").collect()})

    def load(self, path: str) -> "Boosted":
        """Raises if a file is missing or changed, or if the models were made for another target or task."""
        spark = SparkSession.active()
        schema, manifest = readers.record(spark, f"{path}/schema.json"), readers.record(spark, f"{path}/manifest.json")
        if changed := readers.verified(spark, f"{path}/models", manifest):
            raise ValueError(f"{path}: missing or changed files: {changed}")
        if (schema["target"], schema["task"]) != (self.target, self.task):
            raise ValueError(f"{path} holds a {schema['task']} model of {schema['target']}")
        self.features, self.seeds = schema["features"], tuple(schema["seeds"])
        self.models = [PipelineModel.load(f"{path}/models/seed-{i}") for i in range(len(self.seeds))]
        return self


#: The most groups that get a model each.
MOST_GROUPS = 200


def residual(df: DataFrame, target: str, baseline: str, name: str = "_residual") -> DataFrame:
    return df.withColumn(name, F.col(target) - F.col(baseline))


@dataclass
class Grouped:
    """A model per value of a column, or one for all; on the target or on what a baseline leaves.

    Values not met in training, and null, get the model of all rows, which is fitted too.  A column of
    more than ``MOST_GROUPS`` values raises: each is a model to be fitted.
    """

    features: list[str]
    target: str
    group: str | None = None
    baseline: str | None = None
    weight: str | None = None
    params: dict = field(default_factory=dict)
    seeds: tuple[int, ...] = (42,)
    models: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "Grouped":
        x = residual(df, self.target, self.baseline) if self.baseline else df.withColumn("_residual", F.col(self.target))
        make = lambda: Boosted(self.features, "_residual", "regression", self.weight, self.params, self.seeds)
        values = []
        if self.group:
            groups = x.select(self.group).filter(F.col(self.group).isNotNull()).distinct()
            values = sorted(r[0] for r in groups.limit(MOST_GROUPS + 1).collect())
            if len(values) > MOST_GROUPS:
                raise ValueError(f"{self.group} has more than {MOST_GROUPS} values, which is the most that get a model each")
        self.models = {None: make().fit(x)} | {v: make().fit(x.filter(F.col(self.group) == v)) for v in values}
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        values = [v for v in self.models if v is not None]
        other = df.filter(~F.coalesce(F.col(self.group).isin(values), F.lit(False))) if values else df
        out = self.models[None].predict(other, name)
        for v in values:
            out = out.unionByName(self.models[v].predict(df.filter(F.col(self.group) == v), name))
        return out.withColumn(name, F.col(name) + F.col(self.baseline)) if self.baseline else out


def out_of_fold(df: DataFrame, make, keys: list[str], folds: int = 5, seed: int = 42, name: str = "oof") -> DataFrame:
    """Predictions for each row by a model that hasn't seen its fold; folds are a hash of the keys."""
    x = df.withColumn("_fold", F.floor(hash_uniform(seed, *keys) * folds).cast("int"))
    out = None
    for k in range(folds):
        part = make().fit(x.filter(F.col("_fold") != k)).predict(x.filter(F.col("_fold") == k), name)
        out = part if out is None else out.unionByName(part)
    return out.drop("_fold")


def pseudo_labelled(train: DataFrame, scored: DataFrame, score: str, label: str, low: float, high: float, also: Column | None = None) -> DataFrame:
    """Training rows and confidently scored ones, which take the label their score speaks for.

    ``also`` is what positives have to meet beside their score, such as a step's least size.
    """
    positive = F.col(score) >= high
    sure = scored.filter((F.col(score) <= low) | (positive if also is None else positive & also)).withColumn(label, (F.col(score) >= high).cast("int"))
    return train.unionByName(sure.select(*[c for c in sure.columns if c in train.columns]), allowMissingColumns=True)
