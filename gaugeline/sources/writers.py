"""Writing results: exchange tables, one-file deliveries, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exchange(df: DataFrame, path: str, columns: list[str], partition: str | None = None) -> None:
    out = df.select(*columns).write.mode("overwrite")
    (out.partitionBy(partition) if partition else out).parquet(path)


def delivery(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """One CSV file with fixed columns in a fixed order, for results that people take away."""
    df.select(*columns, *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)]).coalesce(1).sortWithinPartitions(*[f"_{i}" for i in range(len(order))]).drop(*[f"_{i}" for i in range(len(order))]).write.mode("overwrite").option("header", True).csv(path)


def keyed(sample: DataFrame, predictions: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The sample's rows with their predictions; keys must be unique and all be predicted."""
    for name, df in (("sample", sample), ("predictions", predictions)):
        twice = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"{name}: a key occurs more than once: {twice[0].asDict()}")
    out = sample.drop(value).join(predictions.select(*keys, value), keys, "left")
    missing = out.filter(F.col(value).isNull()).count()
    if missing:
        raise ValueError(f"{missing} rows have no prediction")
    return out


def text(spark: SparkSession, path: str, content: str) -> None:
    """A small text file, through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def record(spark: SparkSession, path: str, value: dict) -> None:
    text(spark, path, json.dumps(value, ensure_ascii=False, indent=1, sort_keys=True))


def report(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """Markdown of small tables (aggregates), at most ``most`` rows each; it says where there are more."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows[:most]]
        out += ["", f"The first {most} rows; there are more.", ""] if len(rows) > most else [""]
    return "\n".join(out)
