"""Reading tables: by suffix, with a schema, with NaN as null and a row id where order matters."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import nan_to_null


def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None, required: bool = True) -> DataFrame | None:
    """CSV (with a header) or Parquet by suffix; None for an optional table that isn't there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        if required:
            raise FileNotFoundError(path)
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if path.rstrip("/").endswith(".csv"):
        reader = reader.option("header", True)
        df = reader.csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    else:
        df = reader.parquet(path)
    return nan_to_null(df)


def read_all(spark: SparkSession, paths: dict[str, str], required: set[str] = frozenset(), schemas: dict | None = None) -> dict[str, DataFrame | None]:
    return {name: read(spark, path, (schemas or {}).get(name), name in required) for name, path in paths.items()}


def with_row_id(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """A surrogate for input order: by the given columns' values, or by place in the files.

    Rows that share the values are numbered among each other, in the order of all columns, so that no
    two rows share a row_id.  The place in the files rises but isn't consecutive.
    """
    if order:
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order])
        digest = lambda x: F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")
        alike = W.partitionBy("_text").orderBy(*[c for c, t in df.dtypes if not t.startswith("map")])
        x = df.withColumn("_text", text).withColumn("_nth", F.row_number().over(alike))
        return x.withColumn("row_id", F.when(F.col("_nth") == 1, digest(F.col("_text"))).otherwise(digest(F.concat_ws("|", "_text", "_nth")))).drop("_text", "_nth")
    return df.withColumn("row_id", F.monotonically_increasing_id())


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def times(spark: SparkSession, start: str, end: str, step: str = "10 minutes") -> DataFrame:
    """A regular grid of wall-clock times, both ends included."""
    return spark.sql(f"SELECT explode(sequence(TIMESTAMP_NTZ '{start}', TIMESTAMP_NTZ '{end}', INTERVAL {step})) AS time")


def records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON records, one file each, below ``folder``; files that aren't records are left out."""
    df = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("mode", "PERMISSIVE").json(folder)
    return df.filter("_corrupt_record IS NULL").drop("_corrupt_record")


def record(spark: SparkSession, path: str) -> dict:
    """One JSON file as a dictionary."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def npy(spark: SparkSession, path: str) -> DataFrame:
    """name, position, value of NumPy files of vectors: a file is a task's."""
    import pandas as pd

    def load(frames):
        import io

        import numpy as np

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                if x.ndim != 1:
                    raise ValueError(f"{name} has {x.ndim} dimensions")
                yield pd.DataFrame({"name": name.rpartition("/")[2], "position": np.arange(len(x)), "value": x.astype(float)})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(path)
    return files.select("path", "content").mapInPandas(load, "name string, position long, value double")


def file_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """name and sha256 of each file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, folder: str, manifest: dict[str, str]) -> list[str]:
    """Names of the manifest's files that are missing or changed."""
    found = {r["name"]: r["sha256"] for r in file_hashes(spark, folder).filter(F.col("name").isin(list(manifest))).collect()}
    return sorted(n for n, h in manifest.items() if found.get(n) != h)
