"""Documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again, and returns the columns
of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import line_templates, mixing, near_duplicates, packing, quality_rules
from gaugeline.llm.common import materialize, table

#: From this similarity in percent on, documents are near duplicates.
SIMILAR = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    return quality_rules.kept(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first; emptied documents go.

    Documents that the next stage takes for copies as a whole are left to it.
    """
    return line_templates.cleaned(docs, SIMILAR).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays, in one row."""
    return near_duplicates.one_of_each(docs, SIMILAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and offset."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("line_templates", lines), ("near_duplicates", near_dedup), ("mixing", mix), ("packing", pack)]

#: A learned list, sketches and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
