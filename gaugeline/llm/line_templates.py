"""Lines that recur across documents, found by a log-template tree (operator 8).

A line is a record: its words are its tokens, and a token with a digit is a variable field.  The tree
has a fixed depth: a line goes down by its number of tokens and its first ``DEPTH`` tokens to a leaf.
In a leaf, lines that agree in at least ``SIMILAR`` of their tokens share a template, whose other
places are variable fields, whatever their length.

A template found in at least ``DOCUMENTS`` documents, or two if it has ``LONG`` tokens or more, is
recurring: its lines are dropped in all documents but the one with the least doc_id, so that the text
itself isn't lost.  Lines of fewer than ``LEAST`` tokens, and those of which most tokens are variable,
are never dropped.

Templates don't depend on how a leaf is dealt.  A leaf's lines pass through a task one by one, which
holds the templates alone, and a line looks at templates with which it has a block of tokens in common.
A leaf with more than ``CROWD`` different lines is dealt by chains of such blocks, as lines of different
chains can't share a template.  Counts are summed before they are shuffled, and lines meet templates
in a join whose hot keys AQE splits.

Then passages that recur inside lines go (``passages``).  A line of which nothing is left counts as dropped.

``copies`` leaves whole documents to near-duplicate detection: a document that has the similarity with
an earlier one, with which it shares most anchors of passages, counts as that document, and only what
goes from that one goes from it.  Without it every document counts.

Null and empty texts have no lines and stay as they are.  A row is known by its doc_id and its text, so
what goes from it is its own lines only: rows that repeat both are decided alike, rows that share a
doc_id but not the text are cut apart, and all rows of the first doc_id keep the template's lines.
A null doc_id is never the first; if all are null, nothing of the template is dropped.  An empty table
gives an empty result.  Other columns are carried along.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import near_duplicates, passages
from .common import bucketed, discard, lookup, map_arrow, marked, materialize, partitions, row_key, table, text_of
from .near_duplicates import components
from .shingles import U, _power, _BACK, _BASE, laid_out, mixed, slices, with_digit, word_hashes

DEPTH, LEAST, DOCUMENTS, SIMILAR, CROWD = 3, 3, 3, 0.8, 2000
#: Lines of so many words don't meet by chance: two documents make them recurring.
LONG = 50
#: Tokens are compared by 16 bits of their hashes: they agree by chance once in 65,536 times.
TOKEN = np.dtype("<u2")
#: The value of a variable field.
FIELD = 0x5BD1E995
LINES = "doc_id long, mark long, line int, tokens int, leaf long, signature long, first boolean, values binary"


def parsed(docs: DataFrame, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """A row per line that may be dropped; ``values`` are the tokens of a text's different lines as 16-bit hashes."""

    def leading(values, starts, counts, k):
        out = counts.astype(U) * U(0xA0761D6478BD642F)
        for i in range(k):
            has = np.flatnonzero(counts > i)
            out[has] += values[starts[has] + i] * (mixed(np.array([i + 1], U))[0] | U(1))
        return mixed(out)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, marks = batch.column("doc_id"), batch.column("mark")
            for a, b, texts in slices(batch.column("text"), 1 << 21):
                raw, offsets = laid_out(texts)
                values, begins, _ = word_hashes(raw, offsets, lower=False)
                field = with_digit(raw, begins)
                values[field] = U(FIELD)
                lines = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(raw == 10) + 1]))
                line = np.searchsorted(lines, begins, side="right") - 1
                counts = np.bincount(line, minlength=len(lines))
                fields = np.bincount(line, weights=field, minlength=len(lines))
                starts = np.cumsum(counts) - counts
                doc = np.searchsorted(offsets[:-1], lines, side="right") - 1
                nth = np.arange(len(lines)) - np.searchsorted(lines, offsets[:-1])[doc]
                keep = np.flatnonzero((counts >= least) & (2 * fields <= counts))
                sums = np.concatenate([np.zeros(1, U), np.cumsum(values * _power("up", _BASE, len(values)))])
                starts, counts, doc, nth = starts[keep], counts[keep], doc[keep], nth[keep]
                signature = mixed((sums[starts + counts] - sums[starts]) * _power("down", _BACK, len(values) + 1)[starts] + counts.astype(U))
                _, at = np.unique(np.stack([doc.astype(U), signature]), axis=1, return_index=True) if len(keep) else (None, [])
                first = np.zeros(len(keep), dtype=bool)
                first[at] = True
                narrow = values.astype(TOKEN)
                brief = [narrow[s : s + n].tobytes() if f else None for s, n, f in zip(starts.tolist(), counts.tolist(), first.tolist())]
                columns = [*(c.slice(a, b - a).take(pa.array(doc)) for c in (ids, marks)), nth.astype(np.int32), counts.astype(np.int32), leading(values, starts, counts, depth).view(np.int64), signature.view(np.int64), first]
                yield pa.RecordBatch.from_arrays([*columns[:2], *map(pa.array, columns[2:]), pa.array(brief, pa.binary())], names=[c.split()[0] for c in LINES.split(", ")])

    return map_arrow(marked(docs), run, LINES)


def blocks(n: int, similar: float = SIMILAR, depth: int = DEPTH) -> list[tuple[int, int]]:
    """Parts of the tokens after the leaf's, one more than there may be different tokens.

    Lines that agree in enough of ``n`` tokens agree in all of at least one part.
    """
    parts = n - int(np.ceil(similar * n)) + 1
    edges = [min(depth, n) + (n - min(depth, n)) * i // parts for i in range(parts + 1)]
    return list(zip(edges, edges[1:]))


class Templates:
    """The templates of a leaf, to which lines of ``n`` tokens are added in order of documents.

    A line joins the template with most equal tokens, if enough are, and makes the others variable.
    A template's fixed tokens are its first line's, so the blocks of that line find it.
    """

    def __init__(self, n: int, similar: float = SIMILAR):
        self.least, self.blocks, self.names, self.found = similar * n, blocks(n, similar), [], {}
        self.tokens, self.fixed = np.zeros((4, n), TOKEN), np.zeros((4, n), dtype=bool)

    def add(self, signature: int, values: bytes) -> int:
        """The signature of the line whose template it is."""
        value = np.frombuffer(values, TOKEN)
        keys = [(a, values[2 * a : 2 * b]) for a, b in self.blocks]
        near = sorted({t for k in keys for t in self.found.get(k, ())})
        if near:
            equal = ((self.tokens[near] == value) & self.fixed[near]).sum(axis=1)
            best = int(equal.argmax())
            if equal[best] >= self.least:
                self.fixed[near[best]] &= self.tokens[near[best]] == value
                return self.names[near[best]]
        t = len(self.names)
        if t == len(self.tokens):
            self.tokens, self.fixed = (np.concatenate([x, np.zeros_like(x)]) for x in (self.tokens, self.fixed))
        self.tokens[t], self.fixed[t] = value, True
        self.names.append(signature)
        for k in keys:
            self.found.setdefault(k, []).append(t)
        return signature


def chains(crowded: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """node, comp: lines (by signature) that blocks of equal tokens connect; others can't share a template."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            keys, names = [], []
            for leaf, signature, values in zip(*(batch.column(c).to_pylist() for c in ("leaf", "signature", "values"))):
                for a, b in blocks(len(values) // 2, similar):
                    key = hashlib.blake2b(leaf.to_bytes(8, "little", signed=True) + a.to_bytes(4, "little") + values[2 * a : 2 * b], digest_size=8)
                    keys.append(int.from_bytes(key.digest(), "little", signed=True))
                    names.append(signature)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.int64())], names=["block", "b"])

    met = materialize(map_arrow(crowded.select("leaf", "signature", "values"), run, "block long, b long"))
    heads = met.groupBy("block").agg(F.min("b").alias("a"), F.max("b").alias("last")).filter("a <> last").select("block", "a")
    return components(materialize(met.join(heads, "block").filter("a <> b").select("a", "b").distinct()))


def templates(several: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """signature, template of lines (leaf, part, signature, documents, values)."""

    def run(batches):
        import pyarrow as pa

        now, leaf = None, None
        for batch in batches:
            signatures, names = batch.column("signature").to_pylist(), []
            for key, part, signature, values in zip(batch.column("leaf").to_pylist(), batch.column("part").to_pylist(), signatures, batch.column("values").to_pylist()):
                if (key, part) != now:
                    now, leaf = (key, part), Templates(len(values) // 2, similar)
                names.append(leaf.add(signature, values))
            yield pa.RecordBatch.from_arrays([pa.array(signatures, pa.int64()), pa.array(names, pa.int64())], names=["signature", "template"])

    rows = several.select("leaf", "part", "signature", "documents", "values").repartition(partitions(several), "leaf", "part")
    return map_arrow(rows.sortWithinPartitions("leaf", "part", F.desc("documents"), "signature"), run, "signature long, template long")


def recurring(lines: DataFrame, documents: int = DOCUMENTS, long_: int = LONG, similar: float = SIMILAR, crowd: int = CROWD) -> DataFrame:
    """signature, first_doc of the lines of recurring templates; ``lines`` are those of documents that count."""
    firsts = lines.filter("first")
    seen = materialize(firsts.groupBy("signature", "leaf", "tokens").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc")))
    # leaves in which there is something to merge
    leaves = materialize(seen.groupBy("leaf").agg(F.count(F.lit(1)).alias("crowd")).filter("crowd > 1"))
    several = materialize(lookup(seen, leaves, ["leaf"], "inner"))
    # only their tokens are shuffled; they follow from the signature
    values = materialize(firsts.select("signature", "values").dropDuplicates(["signature"]).join(several.select("signature").hint("shuffle_hash"), "signature", "left_semi"))
    several = materialize(several.join(values, "signature"))
    crowded = several.filter(F.col("crowd") > crowd)
    if crowded.isEmpty():
        several = several.withColumn("part", F.lit(0).cast("long"))
    else:
        linked = chains(crowded, similar).select(F.col("node").alias("signature"), F.col("comp").alias("part"))
        several = lookup(several, linked, ["signature"]).withColumn("part", F.when(F.col("crowd") > crowd, F.coalesce("part", "signature")).otherwise(F.lit(0)))
    named = materialize(templates(several, similar))
    # templates of more than one line; all others keep the counts they have
    wide = materialize(named.groupBy("template").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("template"))
    grouped = materialize(lookup(named, wide, ["template"], "left_semi"))
    marked = lookup(seen.select("signature", "tokens", "documents", "first_doc"), grouped, ["signature"])
    enough = F.col("documents") >= F.when(F.col("tokens") >= long_, F.least(F.lit(documents), F.lit(2))).otherwise(F.lit(documents))
    alone = marked.filter("template IS NULL").filter(enough).select("signature", "first_doc")
    shared = materialize(marked.filter("template IS NOT NULL"))
    many = shared.groupBy("template", "tokens").agg(F.sum("documents").alias("documents"), F.min("first_doc").alias("first")).filter(enough)
    both = alone.union(lookup(shared.drop("documents", "tokens"), materialize(many.select("template", "first")), ["template"], "inner").select("signature", F.col("first").alias("first_doc")))
    return materialize(both.filter("first_doc IS NOT NULL"))


def without(text: Column, dropped: Column) -> Column:
    """The text without the lines whose numbers are given; texts that stay whole don't go to Python."""

    @F.pandas_udf("string")
    def cut(texts, numbers):
        import pandas as pd

        out = []
        for t, d in zip(texts, numbers):
            if d is None:
                out.append(None)
                continue
            gone = set(d.tolist())
            out.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
        return pd.Series(out, dtype=object)

    return F.when(dropped.isNull(), text).otherwise(cut(F.when(dropped.isNotNull(), F.coalesce(text, F.lit(""))), dropped))


def leaders(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id and the least doc_id of the documents it is linked with; only those that aren't their own."""
    best = materialize(passages.shared_most(docs))
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(near_duplicates.nodes_of(best), "node", "left_semi")
    sets = materialize(near_duplicates.sets_of(texts))
    links = materialize(near_duplicates.verified(best, sets, percent))
    return materialize(components(links).filter("node <> comp").select(F.col("node").alias("doc_id"), F.col("comp").alias("leader")))


def drop_recurring(docs: DataFrame, documents: int = DOCUMENTS, crowd: int = CROWD, copies: int | None = None) -> DataFrame:
    """``docs`` with ``text`` cut, under a struct ``row``, and n_lines and n_dropped.

    doc_id is beside the struct, so that no column name can clash.  ``copies`` is a similarity in percent.
    """
    every = materialize(parsed(docs))
    led = leaders(docs, copies) if copies else None
    lines = passages.counted(every, led)
    gone = lines.select("doc_id", "mark", "line", "signature", "who").join(recurring(lines.filter("NOT copy"), documents, crowd=crowd).hint("merge"), "signature")
    gone = gone.filter(~F.col("who").eqNullSafe(F.col("first_doc")))
    gone = materialize(gone.groupBy(row_key(), "mark").agg(F.collect_set("line").alias("dropped")))
    discard(every)
    rest = [c for c in docs.columns if c != "doc_id"]
    carried = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    carried = carried.withColumns({"known": row_key(), "mark": F.xxhash64(text_of("row.text"))})
    # a shuffled join at every size: what is dropped grows with the texts
    out = carried.join(gone.hint("shuffle_hash"), ["known", "mark"], "left")
    out = out.select("doc_id", "known", "mark", F.col("row").withField("text", without(F.col("row.text"), F.col("dropped"))).alias("row"), _lines("row.text").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))
    out = bucketed(out, ["known", "mark"])
    spans = passages.recurring(out.select(F.col("doc_id").cast("long"), "known", "mark", F.col("row.text").alias("text")), min(documents, 2), led)
    out = out.join(spans.hint("shuffle_hash"), ["known", "mark"], "left")
    out = out.withColumn("left", passages.without(F.col("row.text"), F.col("windows")))
    emptied = F.when(F.col("windows").isNull(), F.lit(0)).otherwise(_lines("row.text") - _lines("left"))
    return out.select("doc_id", F.col("row").withField("text", F.col("left")).alias("row"), "n_lines", (F.col("n_dropped") + emptied).alias("n_dropped"))


def _lines(text: str) -> Column:
    """Lines with a word."""
    return F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D][^\n]*")).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_recurring(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.col("row.text").alias("text"))


def cleaned(docs: DataFrame, copies: int | None = None) -> DataFrame:
    """The columns of ``docs``; documents of which no line is left are gone."""
    out = drop_recurring(docs, copies=copies).filter("n_dropped = 0 OR n_dropped < n_lines")
    return out.select(*["doc_id" if c == "doc_id" else F.col("row").getField(c).alias(c) for c in docs.columns])
