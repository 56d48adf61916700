"""Near-duplicate documents by SetSketch (operator 2).

1. Each document's shingle set gives a key (its digest) and a sketch; documents of one key are a class,
   and only a class's representative, its least doc_id, goes on.
2. Representatives that share a band value meet in its bucket.  Every member is paired with one pivot
   alone, the member that meets most others, which in a group of copies is the text they came from.
3. Pairs whose likelihood allows the similarity are verified on their full sets; links make components.
4. Buckets that still hold several components are compared in blocks of bounded size, but only across
   components; what the likelihood and a sharper sketch of eight times the registers allow is verified.
   No pair that shares a bucket goes unexamined.
5. A component's id is its least doc_id.

Similarity is tested as ``100 * both >= percent * either`` on distinct shingles.  Texts with a
similarity of 0.85 (36 bands of 7) share a bucket with probability 1 - 1e-6, of 0.8 (42 of 6) with
1 - 3e-6.  The likelihood's bound is five standard errors below the similarity: by the normal
approximation it drops about 3e-7 of links at exactly that similarity; the sharper sketch's bound drops as many.

Nulls and texts without words have an empty set and link with nothing.  Rows that share a doc_id and
the set fall together; rows that share a doc_id but not the set are linked apart.  A null doc_id takes part; its
component_id is null if no numbered document is in its component.  An empty table gives an empty result.
Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import setsketch as sk
from .common import lookup, map_arrow, marked, materialize, partitions, row_key, table, text_of
from .shingles import shingle_sets, slices

PERCENT, BLOCK = 85, 500
#: Nodes of rows without a doc_id, or whose doc_id stands beside several sets, are numbered from here.
UNKNOWN = 1 << 62


def _node(doc_id, key: bytes) -> int:
    return doc_id if doc_id is not None else UNKNOWN | int.from_bytes(key[:8], "big") >> 2


def _key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _least(percent: int, width: int = 2) -> int:
    """Sets smaller than this have the similarity with equal sets only."""
    n = 1
    while 100 * n < percent * (n + 1):
        n += 1
    return n


def sketched(docs: DataFrame, percent: int = PERCENT, width: int = 5) -> DataFrame:
    """doc_id, mark (of the text), node, n_shingles, key, sketch (null for sets too small to be near any other)."""
    least = _least(percent)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, b, part in slices(batch.column("text"), 1 << 21):
                sets = list(shingle_sets(part, width))
                keys = [_key(s) if len(s) else None for s in sets]
                wide = [i for i, s in enumerate(sets) if len(s) >= least]
                made = sk.sketches([sets[i] for i in wide]) if wide else None
                sketch = [None] * len(sets)
                for row, i in enumerate(wide):
                    sketch[i] = made[row].tobytes()
                nodes = [_node(d, k or b"none") for d, k in zip(ids[a:b], keys)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), batch.column("mark").slice(a, b - a), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sketch, pa.binary())], names=["doc_id", "mark", "node", "n_shingles", "key", "sketch"])

    return map_arrow(marked(docs), run, "doc_id long, mark long, node long, n_shingles long, key binary, sketch binary")


def banded(nodes: DataFrame, rows: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, sk.M)
                node = np.repeat(batch.column("node").to_numpy(), sk.M // rows)
                yield pa.RecordBatch.from_arrays([pa.array(sk.bands(sketch, rows).ravel()), pa.array(node)], names=["bucket", "node"])

    return map_arrow(nodes.select("node", "sketch"), run, "bucket long, node long")


def likely(pairs: DataFrame, known: DataFrame, bound: float) -> DataFrame:
    """Pairs (a, b) whose sketches allow the similarity."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, sk.M) for c in ("sketch_a", "sketch_b"))
                keep = sk.at_least(x, y, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), bound)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    for side in "ab":
        pairs = pairs.join(known.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}"), F.col("n_shingles").alias(f"n_{side}")), side)
    return map_arrow(pairs, run, "a long, b long")


def sets_of(texts: DataFrame, width: int = 5) -> DataFrame:
    """node and the full set of its text, once; rows that share a node have equal sets."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, part in slices(batch.column("text"), 1 << 21):
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array([s.tobytes() for s in shingle_sets(part, width)], pa.binary())], names=["node", "set"])

    return map_arrow(texts.select("node", "text"), run, "node long, set binary").dropDuplicates(["node"])


def texts_of(docs: DataFrame, every: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text of the documents in ``nodes``."""
    places = every.join(nodes, "node", "left_semi").dropDuplicates(["node"]).select("node", row_key(), "mark")
    return marked(docs).select(row_key(), "mark", "text").join(places, ["known", "mark"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose full sets have the similarity."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    for side in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("set").alias(f"set_{side}")), side)
    return map_arrow(pairs, run, "a long, b long")


def sharpened(sets: DataFrame) -> DataFrame:
    """node and the sharp sketch of its set, some sets at a time."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, sizes = 0, np.cumsum([len(s.as_buffer()) // 8 for s in batch.column("set")])
            while a < batch.num_rows:
                b = int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + (1 << 16), side="right"))
                b = min(max(a + 1, b), a + 256, batch.num_rows)
                made = sk.sharp([np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column("set").slice(a, b - a)])
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array([m.tobytes() for m in made], pa.binary())], names=["node", "sharp"])
                a = b

    return map_arrow(sets.select("node", "set"), run, "node long, sharp binary")


def across(members: DataFrame, bound: float, width: int, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Likely pairs of different components within buckets, each pair in the first bucket it shares.

    A bucket of up to ``block`` members is one group.  A larger one is dealt into blocks, and any two
    of them are a group: groups hold at most twice ``block`` members, however large the bucket.
    ``width`` is the number of a band's registers.
    """

    def compare(band, rows):
        node, comp, n, part = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(4))
        sketch = np.frombuffer(b"".join(r[4] for r in rows), np.uint16).reshape(-1, sk.M)
        sharp = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(len(rows), -1)
        one = len({r[3] for r in rows}) == 1
        if (comp == comp[0]).all():
            return
        for i in range(len(rows) - 1):
            j = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
            j = j[100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])]
            if not one:  # pairs within a block are another group's
                j = j[part[j] != part[i]]
            if not len(j):
                continue
            j = j[sk.sharply(sharp[i], sharp[j], percent / 100)]
            if not len(j):
                continue
            j = j[sk.at_least(sketch[i], sketch[j], n[i], n[j], bound)]
            if not len(j):
                continue
            same = (sketch[j] == sketch[i]).reshape(len(j), -1, width).all(axis=2)
            for k in j[same.argmax(axis=1) & sk.LOW == band].tolist():
                yield min(int(node[i]), int(node[k])), max(int(node[i]), int(node[k]))

    def run(batches):
        import pyarrow as pa

        now, rows = None, []
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("bucket", "x", "y", "node", "comp", "n_shingles", "part", "sketch", "sharp")]
            for bucket, x, y, *row in zip(*columns):
                if (bucket, x, y) != now:
                    if rows:
                        found += compare(now[0] & sk.LOW, rows)
                    now, rows = (bucket, x, y), []
                rows.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])
        found = list(compare(now[0] & sk.LOW, rows)) if rows else []
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    parts = F.ceil(F.col("size") / F.lit(block)).cast("int")
    rows = members.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.when(parts == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), parts - 1))))
    rows = rows.withColumns({"x": F.least("part", "other"), "y": F.greatest("part", "other")})
    rows = rows.select("bucket", "x", "y", "node", "comp", "n_shingles", "part", "sketch", "sharp")
    rows = rows.repartition(partitions(members), "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "node")
    return map_arrow(rows, run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, comp: the least node that links lead to.  ``links`` (a, b) is a written table.

    Labels are lowered over links and then along themselves, each round a written table, until none
    changes; the work of a round is in proportion to the links.
    """
    edges = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).withColumnRenamed("a", "node"))
    while True:
        lower = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("low"))
        lower = labels.join(lower.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("was"), F.least("comp", "low").alias("comp"))
        lower = materialize(lower)
        jump = lower.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        after = materialize(lower.join(jump, "comp").select("node", "was", F.least("comp", "next").alias("comp")))
        labels = after.select("node", "comp")
        if after.filter("was <> comp").isEmpty():
            return labels


def grouped(docs: DataFrame, percent: int = PERCENT, width: int = 5, block: int = BLOCK) -> DataFrame:
    """doc_id, mark, node, n_shingles, comp and least (the component's least node and doc_id); a row per row of ``docs``."""
    similarity = percent / 100
    bound, rows = similarity - 5 * (similarity * (1 - similarity) / sk.M) ** 0.5, sk.rows_of_a_band(similarity)
    every = materialize(sketched(docs, percent, width))
    several = every.filter("doc_id IS NOT NULL AND key IS NOT NULL").groupBy("doc_id").agg(F.min(F.xxhash64("key")).alias("k0"), F.max(F.xxhash64("key")).alias("k1"))
    several = materialize(several.filter("k0 <> k1").select("doc_id", F.lit(True).alias("several")))
    parted = not several.isEmpty()
    if parted:
        own = F.shiftrightunsigned(F.xxhash64("doc_id", "key"), 2).bitwiseOR(F.lit(UNKNOWN))
        every = materialize(lookup(every, several, ["doc_id"]).withColumn("node", F.when(F.col("several") & F.col("key").isNotNull(), own).otherwise(F.col("node"))).drop("several"))
    copies = materialize(every.filter("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("class")).filter("n > 1").drop("n"))
    classed = materialize(lookup(every, copies, ["key"]).withColumn("class", F.coalesce("class", "node")))
    heads = classed.filter("sketch IS NOT NULL AND node = class").select("node", "n_shingles", "sketch")
    # most buckets hold one member and end here: one shuffle, and only the others are written
    inside = W.partitionBy("bucket")
    members = materialize(banded(heads, rows).withColumn("size", F.count(F.lit(1)).over(inside)).filter("size > 1"))
    meets = W.partitionBy("node")  # as many rows as there are bands
    members = materialize(members.withColumn("meets", F.sum("size").over(meets)))
    known = materialize(heads.join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))
    pivots = materialize(members.groupBy("bucket").agg(F.max(F.struct(F.col("meets"), (-F.col("node")).alias("node"))).alias("p")).select("bucket", (-F.col("p.node")).alias("pivot")))
    pairs = members.join(pivots, "bucket").filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    pairs = materialize(likely(pairs.distinct(), known, bound))
    links = materialize(verified(pairs, materialize(sets_of(texts_of(docs, every, nodes_of(pairs)), width)), percent))
    labels = components(links)
    # buckets whose members aren't all one component yet
    named = materialize(members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    open_ = materialize(named.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("bucket"))
    rest = named.join(open_, "bucket").select("bucket", "size", "node", "comp")
    sets = materialize(sets_of(texts_of(docs, every, rest.select("node").distinct()), width))
    sharp = materialize(sharpened(sets))
    more = materialize(across(rest.join(known, "node").join(sharp, "node"), bound, rows, percent, block))
    more = materialize(verified(more, sets, percent))
    labels = components(materialize(links.union(more)))
    out = lookup(classed.drop("sketch", "key"), labels.select(F.col("node").alias("class"), "comp"), ["class"])
    out = out.select("doc_id", "mark", "node", "n_shingles", F.coalesce("comp", "class").alias("comp"))
    if not parted:
        return out.withColumn("least", F.when(F.col("comp") < UNKNOWN, F.col("comp")))
    out = materialize(out)
    return lookup(out, materialize(out.filter("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("least"))), ["comp"])


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = 5, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; a row per row of ``docs``."""
    out = grouped(docs, percent, width, block)
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, percent: int = PERCENT, width: int = 5) -> DataFrame:
    """``docs`` with one row of each component: that of its least node, which is the least doc_id.

    Of rows that share the node the one with the least hash of its text stays, of equal rows any.
    Rows whose text has no words stay.
    """
    found = materialize(grouped(docs, percent, width).filter("n_shingles > 0").select("doc_id", "mark", "node", "comp"))
    first = found.filter("node = comp")
    twice = materialize(first.groupBy("comp").agg(F.count(F.lit(1)).alias("rows"), F.min("mark").alias("least")).filter("rows > 1").drop("rows"))
    shared = lookup(first, twice, ["comp"], "inner")
    gone = found.filter("node <> comp").select(row_key(), "mark").union(shared.filter("mark <> least").select(row_key(), "mark"))
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    carried = carried.select("row", row_key(F.col("row.doc_id")), F.xxhash64(text_of("row.text")).alias("mark"))
    left = lookup(carried, materialize(gone.distinct()), ["known", "mark"], "left_anti")
    equal = materialize(shared.filter("mark = least").groupBy(row_key(), "mark").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows"))
    if not equal.isEmpty():
        left = lookup(left, equal, ["known", "mark"], "left_anti").unionByName(lookup(left, equal, ["known", "mark"], "left_semi").dropDuplicates(["known", "mark"]))
    return left.select("row.*")


def nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
