"""Places and quantiles in the order of a whole table, without a window over all of its rows.

Rows are counted by value, so a value that very many rows share is one row.  The values are cut at
approximate quantiles into slices; the slices' sums are added up, a row per slice; and each slice is
put in order by itself.  Nulls come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Values of a slice, about; the most slices.
SLICE, MOST = 100_000, 400


def number(df: DataFrame, c: str) -> Column:
    """A number that never falls as the column rises; it need not tell all values apart."""
    kind, x = dict(df.dtypes)[c], F.col(c)
    if kind.startswith("timestamp"):
        return F.datediff(F.to_date(x), F.lit("1970-01-01").cast("date")) * 86_400.0 + F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x)
    if kind == "date":
        return F.datediff(x, F.lit("1970-01-01").cast("date")).cast("double")
    if kind in ("string", "binary"):  # the first bytes
        return F.conv(F.rpad(F.hex(F.substring(x.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return x.cast("double")


def sliced(g: DataFrame, c: str, slice_: int = SLICE) -> DataFrame:
    """Adds ``_slice``, which rises with the column, by cuts of which the driver sees ``MOST`` at most."""
    n = max(1, min(MOST, -(-g.count() // slice_)))
    if n == 1:
        return g.withColumn("_slice", F.lit(0))
    x = number(g, c)
    cuts = sorted(set(g.agg(F.percentile_approx(x, [i / n for i in range(1, n)], 10_000)).first()[0] or []))
    place = F.size(F.filter(F.array(*[F.lit(v) for v in cuts]), lambda v: v <= x)) if cuts else F.lit(0)
    return g.withColumn("_slice", F.when(x.isNull(), -1).otherwise(place))


def ahead(g: DataFrame, c: str, sums: dict[str, str], down: bool = False, slice_: int = SLICE) -> DataFrame:
    """Adds to a table with a row per value of ``c`` the sums (new column: summed column) of all values before."""
    keep = g.columns
    g = sliced(g, c, slice_)
    side = F.desc if down else F.asc
    run = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    per = g.groupBy("_slice").agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    before = per.select("_slice", *[F.coalesce(F.sum(n).over(run(W.orderBy(side("_slice")))), F.lit(0)).alias(f"_before_{n}") for n in sums])  # a row per slice
    inside = run(W.partitionBy("_slice").orderBy(side(c)))
    x = g.join(F.broadcast(before), "_slice")
    return x.select(*keep, *[(F.col(f"_before_{n}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(n) for n, v in sums.items()])


def percentiles(df: DataFrame, x: str | Column, shares: dict[str, float], slice_: int = SLICE) -> DataFrame:
    """Exact percentiles of all rows (linear interpolation), as one row; null without a value."""
    values = df.select((F.col(x) if isinstance(x, str) else x).cast("double").alias("_v")).filter("_v IS NOT NULL")
    g = values.groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    placed = ahead(g, "_v", {"_at": "_n"}, slice_=slice_).crossJoin(F.broadcast(g.agg(F.sum("_n").alias("_all"))))  # one row
    position = {name: (F.col("_all") - 1) * F.lit(float(q)) for name, q in shares.items()}
    value = lambda k: F.max(F.when((F.col("_at") <= k) & (k < F.col("_at") + F.col("_n")), F.col("_v")))
    row = placed.agg(F.max("_all").alias("_all"), *[value(end(p)).alias(f"_{side}_{n}") for n, p in position.items() for side, end in (("low", F.floor), ("high", F.ceil))])
    between = lambda n, p: (F.ceil(p) - p) * F.col(f"_low_{n}") + (p - F.floor(p)) * F.col(f"_high_{n}")
    return row.select(*[F.when(F.floor(p) == F.ceil(p), F.col(f"_low_{n}")).otherwise(between(n, p)).alias(n) for n, p in position.items()])


def shares(df: DataFrame, c: str, name: str) -> DataFrame:
    """Adds the average rank of ties over the number of values, unlike PERCENT_RANK; null for a null."""
    g = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
    placed = ahead(g, c, {"_at": "_n"}).crossJoin(F.broadcast(g.agg(F.sum("_n").alias("_all"))))  # one row
    ranked = placed.select(c, ((F.col("_at") + 1 + (F.col("_n") - 1) / 2.0) / F.col("_all")).alias(name))
    return df.join(ranked, c, "left").select(*df.columns, name)


def nth(df: DataFrame, columns: list[str], k: int, slice_: int = SLICE) -> list:
    """The values of the ``k``-th row, from 1, in an order without ties.

    Column after column: the value among whose rows the place is, then the place among those.
    """
    found, rows, kinds = [], df.select(*columns), dict(df.dtypes)
    for c in columns:
        placed = ahead(rows.groupBy(c).agg(F.count(F.lit(1)).alias("_n")), c, {"_at": "_n"}, slice_=max(slice_, 1000))
        row = placed.filter((F.col("_at") < k) & (F.col("_at") + F.col("_n") >= k)).first()
        found.append(row[c])
        k -= row["_at"]
        rows = rows.filter(F.col(c).eqNullSafe(F.lit(row[c]).cast(kinds[c])))
    return found
