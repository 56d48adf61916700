"""What the training-data operators share: tables, words, and the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles

#: Java regular expression of a run of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, a null one being empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def row_key(doc_id: str | Column = "doc_id") -> Column:
    """``known``: doc_id, or a number below all others where there is none."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63))).alias("known")


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, mark (of the text, so that rows which share a doc_id part) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of("text")).alias("mark"), "text")


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; the blanks put around make the first and last part empty."""
    return (F.size(F.split(F.concat(F.lit(" "), text, F.lit(" ")), SPACE, -1)) - 2).cast("long")


def words(text: Column) -> Column:
    parts = F.split(F.concat(F.lit(" "), text, F.lit(" ")), SPACE, -1)
    return F.slice(parts, F.lit(2), F.size(parts) - 2)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, seen by the driver and all executors.

    The session's setting is read; only where it is unset (tests in local mode) a folder is made.
    The folder is removed when the driver's JVM ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_already.isDefined():
            root = set_already.get()
        elif spark.sparkContext.master.startswith("local["):
            root = "file://" + tempfile.mkdtemp(prefix="gaugeline-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{root.rstrip('/')}/gaugeline-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The rows written to the shared folder and read again: lineage is cut, lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/t"
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(written: DataFrame) -> None:
    """Deletes a table that ``materialize`` wrote, once all that came of it is written itself."""
    spark = written.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(written.written_at)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bucketed(df: DataFrame, keys: list[str], codec: str = "zstd") -> DataFrame:
    """As ``materialize``, in buckets of the keys: joins on them shuffle the other side only."""
    name = f"gaugeline_{uuid.uuid4().hex}"
    rows = df.write.format("parquet").option("compression", codec).option("path", f"{shared_dir(df.sparkSession)}/t")
    rows.bucketBy(partitions(df), *keys).saveAsTable(name)
    return df.sparkSession.table(name)


def filesystem(uri: str):
    """An Arrow file system and the path in it, for binary files that Python code reads or writes."""
    import pyarrow.fs as pafs

    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.normpath("/" + uri[5:].lstrip("/"))
    return pafs.FileSystem.from_uri(uri)


def release_memory() -> None:
    """Gives freed memory back: Python workers outlive their tasks, beside stages that need the memory."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow, after each task of which the worker gives its memory back."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            shingles.forget()
            release_memory()

    return df.mapInArrow(task, schema)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def lookup(rows: DataFrame, side: DataFrame, on: list[str], how: str = "left", most: int = 100_000) -> DataFrame:
    """``rows`` joined with ``side``, a table already written whose row count is read from its footers.

    Up to ``most`` rows it is broadcast; beyond, it is a shuffled join whose hot keys AQE splits.
    """
    return rows.join(F.broadcast(side) if side.limit(most + 1).count() <= most else side, on, how)
