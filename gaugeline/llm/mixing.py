"""Mixing sources to target weights by capped water-filling (operator 5).

Sources get shares of a word budget by weight; a source stops at ``max_epochs`` times its own size
and what it can't take is shared out anew by weight among the others, until none is above its cap.
Documents are then repeated whole, and a seeded sample of each source once more for the fraction.

Everything is DataFrame operations.  Null texts have size 0; a null source is a source of its own,
the last in order; repeated rows are separate rows, and of rows with one doc_id (or none) and one size as
many go into the fraction as bring it nearest; an empty table gives an empty result; columns
other than the named ones are carried along by ``mix`` under a struct, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lookup, materialize, table, text_of, word_count

#: 2**52, for a uniform number from 13 hexadecimal digits.
UNIT = 1 << 52


def uniform(seed: int, key: str) -> Column:
    """In [0, 1), from the row's own key: reruns, retries and other partitionings agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(UNIT))


def fill(sizes: DataFrame, budget: tuple[int, int] = (3, 2), max_epochs: int = 2) -> DataFrame:
    """``sizes`` (source, weight, source_size) with ``target``.

    The budget is ``budget[0] / budget[1]`` of all sizes.  In order of cap over weight, the sources
    before some place are at their caps and those after it share the rest by weight; the place is
    where the level so computed no longer exceeds the next source's cap.  All sums are of integers,
    so the result doesn't depend on the order of addition.  There is a row per source, so the
    windows over all rows see a table of sources, never of documents.
    """
    num, den = budget
    cap = F.col("source_size") * max_epochs
    order = W.orderBy((cap / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    x = sizes.select("source", "weight", "source_size", cap.alias("cap")).withColumns({
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "total": F.sum("source_size").over(every),
    })
    # den * level * weights, if all before this source are at their caps and none from here on
    x = x.withColumn("rest", F.lit(num) * F.col("total") - F.lit(den) * F.col("capped"))
    x = x.withColumn("free", F.col("rest").cast("double") * F.col("weight") <= F.lit(float(den)) * F.col("cap") * F.col("weights"))
    first = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.coalesce("source", F.lit("\U0010ffff")).alias("s"), F.col("rest"), F.col("weights")))).over(every)
    x = x.withColumn("first", first)
    level = F.col("weight") * F.col("first.rest") / (F.lit(den) * F.col("first.weights"))
    return x.select("source", "weight", "source_size", F.when(F.col("first").isNull() | (F.col("rest") > F.col("first.rest")), F.col("cap").cast("double")).otherwise(F.least(level, F.col("cap").cast("double"))).alias("target"))


def mix(docs: DataFrame, weights=None, budget: tuple[int, int] = (3, 2), max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """Adds size, source_size, target, repeats (whole and fractional repetitions of the document).

    docs: doc_id, text, source and any others.  weights: a Column over ``place`` (the source's place
    in code point order from 0, null last), by default 5, 2, 1 repeating.

    The fraction is met by a seeded random order: documents up to a place in it are taken once more.
    The place is found from word counts in ~sqrt(n) slices of that order and one sort of a single
    slice per source, so no source, however hot, is ever brought together.
    """
    spark = docs.sparkSession
    slim = materialize(docs.select("doc_id", "source", word_count(text_of("text")).alias("size"), uniform(seed, "doc_id").alias("u")))
    whole = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source
    w = weights if weights is not None else F.element_at(F.array(F.lit(5), F.lit(2), F.lit(1)), (F.col("place") % 3 + 1).cast("int"))
    sized = whole.withColumn("place", place).withColumn("weight", w.cast("long"))
    filled = fill(sized, budget, max_epochs).join(sized.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.try_divide(F.col("target"), F.col("source_size"))
    filled = materialize(filled.select("*", F.coalesce(F.floor(rate), F.lit(0)).cast("long").alias("times"), F.ceil(F.sqrt(F.col("n"))).cast("long").alias("slices")).select("*", (F.col("target") - F.col("times") * F.col("source_size")).alias("extra"), F.coalesce("source", F.lit("")).alias("k"), F.col("source").isNull().alias("k0")).drop("source", "n"))
    keys = ["k", "k0"]
    known = slim.select("doc_id", "size", "u", F.coalesce("source", F.lit("")).alias("k"), F.col("source").isNull().alias("k0"))
    sliced = lookup(known, filled, keys, "inner").withColumn("slice", F.floor(F.col("u") * F.col("slices")))
    # the slice in which the running number of words passes the fraction's words
    per = sliced.groupBy(*keys, "slice").agg(F.sum("size").alias("words"), F.max("extra").alias("extra"))
    run = W.partitionBy(*keys).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    edge = materialize(per.filter((F.col("before") < F.col("extra")) & (F.col("before") + F.col("words") >= F.col("extra"))).groupBy(*keys).agg(F.min(F.struct("slice", "before")).alias("e")).select(*keys, F.col("e.slice").alias("edge"), F.col("e.before").alias("before")))
    inside = lookup(sliced, edge, keys, "inner").filter(F.col("slice") == F.col("edge"))
    # rows of one doc_id and size are one unit, however many they are
    units = inside.groupBy(*keys, "u", "doc_id", "size", "before", "extra").agg(F.count(F.lit(1)).alias("rows"))
    order = W.partitionBy(*keys).orderBy("u", "doc_id", "size")
    earlier = F.coalesce(F.sum(F.col("size") * F.col("rows")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # the n-th row of a unit is within if taking it leaves the total nearer the fraction's words:
    # at + n * size - size / 2 <= extra, in whole numbers
    room = F.floor(F.col("extra") * 2).cast("long") - F.lit(2) * (F.col("before") + earlier)
    most = F.when(room < 0, 0).when(F.col("size") == 0, F.col("rows")).otherwise(F.expr("(room div size + 1) div 2"))
    units = units.withColumn("room", room).withColumn("within", F.least(F.col("rows"), most)).filter("within > 0")
    last = materialize(units.groupBy(*keys).agg(F.max(F.struct("u", "doc_id", "size", "rows", "within")).alias("last")))
    bounds = materialize(filled.join(edge, keys, "left").join(last, keys, "left").withColumnRenamed("times", "t0"))
    rest = [c for c in docs.columns if c not in ("doc_id", "source")]
    carried = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("k"), F.col("source").isNull().alias("k0"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    carried = carried.withColumn("size", word_count(text_of("row.text"))).withColumn("u", uniform(seed, "doc_id"))
    out = lookup(carried, bounds, keys, "left")
    at, slice_ = F.struct("u", "doc_id", "size"), F.floor(F.col("u") * F.col("slices"))
    end = F.struct("last.u", "last.doc_id", "last.size")
    known = F.coalesce(F.col("last").isNotNull() & (slice_ == F.col("edge")), F.lit(False))
    more = F.when(slice_ < F.col("edge"), 1).when(known & (at <= end), 1).otherwise(0)
    if not bounds.filter("last.within < last.rows").isEmpty():
        out = _parted(out.withColumn("split", known & at.eqNullSafe(end) & (F.col("last.within") < F.col("last.rows"))), keys)
        more = F.when(F.col("nth").isNotNull(), (F.col("nth") <= F.col("last.within")).cast("int")).otherwise(more)
    return out.select("doc_id", F.when(~F.col("k0"), F.col("k")).alias("source"), "row", "size", "source_size", "target", (F.col("t0") + more).cast("long").alias("repeats"))


def _parted(out: DataFrame, keys: list[str]) -> DataFrame:
    """Adds nth, which numbers each source's rows that are ``split``; null for all others.

    Such rows are alike but may be a large part of the table.  They are written with the task they
    came from, numbered within it, and the tasks' counts are summed.
    """
    split = materialize(out.filter("split").withColumns({"task": F.spark_partition_id(), "number": F.monotonically_increasing_id()}))
    tasks = split.groupBy(*keys, "task").agg(F.count(F.lit(1)).alias("rows"))
    run = W.partitionBy(*keys).orderBy("task").rowsBetween(W.unboundedPreceding, -1)  # a row per task
    tasks = materialize(tasks.select(*keys, "task", F.coalesce(F.sum("rows").over(run), F.lit(0)).alias("ahead")))
    nth = F.row_number().over(W.partitionBy(*keys, "task").orderBy("number"))
    numbered = lookup(split, tasks, [*keys, "task"], "inner").withColumn("nth", F.col("ahead") + nth)
    return out.filter("NOT split").withColumn("nth", F.lit(None).cast("long")).unionByName(numbered.drop("task", "number", "ahead"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    mixed = mix(docs, **options)
    row = {c: F.col("row").getField(c) for c in docs.columns if c not in ("doc_id", "source")}
    columns = [row[c].alias(c) if c in row else F.col(c) for c in docs.columns]
    return mixed.filter("repeats > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("repeats").cast("int")))).select(*columns)


#: The same in DuckDB, with each source's documents sorted as a whole.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
c AS (SELECT *, source_size * 2 AS cap, (source_size * 2)::DOUBLE / weight AS ratio FROM w),
o AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weights, sum(source_size) OVER () AS total
      FROM c WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, CAST(3 * total - 2 * capped AS BIGINT) AS rest FROM o),
f AS (SELECT rest AS level_rest, CAST(weights AS BIGINT) AS level_weights FROM r WHERE rest::DOUBLE * weight <= 2.0 * cap * weights ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN level_rest IS NULL OR rest > level_rest THEN cap::DOUBLE
        ELSE least((weight * level_rest)::DOUBLE / (2 * level_weights)::DOUBLE, cap::DOUBLE) END AS target FROM r LEFT JOIN f ON true),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS times FROM t),
g AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.times, e.target - e.times * e.source_size AS extra,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (times + CASE WHEN extra > 0 AND run - size / 2.0::DOUBLE <= extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM g
"""
