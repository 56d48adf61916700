"""Passages that recur across documents, inside lines or over several of them (operator 8).

A passage is a run of ``RUN`` words or more, words with a digit being equal; a run of which most words
have digits is none.  Each run of exactly ``RUN`` words is a window.  Its least hash of ``GRAM`` words
is its anchor, so equal windows have equal anchors, and only windows whose anchor is found in enough
documents are counted: none is missed.  A window found in at least ``documents`` documents goes from
all but the one with the least doc_id.

Rows are known by doc_id and mark, see ``common.marked``.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lookup, map_arrow, marked, materialize, row_key
from .shingles import U, _power, _BACK, _BASE, laid_out, mixed, slices, with_digit, word_hashes

RUN, GRAM = 50, 12
#: The value of a word with a digit.
FIELD = 0x5BD1E995
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def windows(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow string array: each window's text, first word in it, anchor and hash, in order."""
    raw, offsets = laid_out(texts)
    values, begins, _ = word_hashes(raw, offsets, lower=False)
    field = with_digit(raw, begins)
    values[field] = U(FIELD)
    n = len(values)
    m = n - RUN + 1
    if m <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U),) * 2
    doc = np.searchsorted(offsets, begins, side="right") - 1
    sums = np.concatenate([np.zeros(1, U), np.cumsum(values * _power("up", _BASE, n))])
    back = _power("down", _BACK, n + 1)
    least = mixed((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
    width = 1
    while 2 * width <= RUN - GRAM + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = RUN - GRAM + 1 - width
    least = np.minimum(least[:m], least[rest : rest + m])
    whole = mixed((sums[RUN:] - sums[:-RUN]) * back[:m] + U(RUN))
    fields = np.concatenate([[0], np.cumsum(field)])
    at = np.flatnonzero((doc[:m] == doc[RUN - 1 :]) & (2 * (fields[RUN:] - fields[:-RUN]) <= RUN))
    return doc[at], at - np.searchsorted(doc, doc[at]), least[at], whole[at]


def _once(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Where a text has a value for the first time."""
    order = np.lexsort((value, doc))  # stable
    d, v = doc[order], value[order]
    first = np.ones(len(d), dtype=bool)
    first[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return order[first]


def anchors(docs: DataFrame) -> DataFrame:
    """A row per document and different anchor.  docs: doc_id, mark, text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, texts in slices(batch.column("text"), 1 << 21):
                doc, _, anchor, _ = windows(texts)
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])])) if len(doc) else np.zeros(0, np.int64)
                new = new[_once(doc[new], anchor[new])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a).take(pa.array(doc[new])) for c in ("doc_id", "mark")), pa.array(anchor[new].view(np.int64))], names=["doc_id", "mark", "anchor"])

    return map_arrow(docs.select("doc_id", "mark", "text"), run, "doc_id long, mark long, anchor long")


def met(docs: DataFrame) -> DataFrame:
    """The windows of documents that have one of the ``anchors`` beside the text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            wanted = batch.column("anchors")
            for a, b, texts in slices(batch.column("text"), 1 << 21):
                doc, at, anchor, whole = windows(texts)
                lists = wanted.slice(a, b - a)
                edges = np.searchsorted(doc, np.arange(b - a + 1))
                keep = np.zeros(len(doc), dtype=bool)
                for i in range(b - a):
                    s, e = edges[i], edges[i + 1]
                    if s < e:
                        keep[s:e] = np.isin(anchor[s:e].view(np.int64), lists[i].values.to_numpy())
                doc, at, whole = doc[keep], at[keep], whole[keep]
                first = np.zeros(len(doc), dtype=bool)
                first[_once(doc, whole)] = True
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a).take(pa.array(doc)) for c in ("doc_id", "mark")), pa.array(at.astype(np.int32)), pa.array(whole.view(np.int64)), pa.array(first)], names=["doc_id", "mark", "at", "whole", "first"])

    return map_arrow(docs.select("doc_id", "mark", "text", "anchors"), run, "doc_id long, mark long, at int, whole long, first boolean")


def counted(rows: DataFrame, led: DataFrame | None) -> DataFrame:
    """Adds who (the document that a row's counts as) and copy (whether that is another one)."""
    if led is None:
        return rows.withColumns({"who": F.col("doc_id"), "copy": F.lit(False)})
    return lookup(rows, led, ["doc_id"]).withColumns({"who": F.coalesce("leader", "doc_id"), "copy": F.col("leader").isNotNull()}).drop("leader")


def shared_most(docs: DataFrame, share: float = 0.25) -> DataFrame:
    """(a, b): for each doc_id b the first document a of most of its anchors, if of ``share`` of them at least."""
    found = materialize(anchors(marked(docs.filter("doc_id IS NOT NULL"))))
    first = materialize(found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last")).filter("a <> last").select("anchor", "a"))
    met_ = lookup(found, first, ["anchor"], "inner").filter("doc_id <> a").groupBy("doc_id", "a").agg(F.count(F.lit(1)).alias("n"))
    best = materialize(met_.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("most")).select(F.col("doc_id").alias("b"), F.col("most.n").alias("n"), (-F.col("most.a")).alias("a")))
    sizes = lookup(found.select(F.col("doc_id").alias("b")), best.select("b"), ["b"], "left_semi").groupBy("b").agg(F.count(F.lit(1)).alias("size"))
    return best.join(sizes, "b").filter(F.col("n") >= share * F.col("size")).select("a", "b")


def recurring(docs: DataFrame, documents: int, led: DataFrame | None = None) -> DataFrame:
    """known, mark and the windows to drop, by their first words' numbers.

    ``docs`` (doc_id, known, mark, text) is written in buckets of known and mark.  Joins are shuffled
    ones at every size: what is looked up grows with the texts.
    """
    found = materialize(anchors(docs))
    common = materialize(counted(found, led).filter("NOT copy").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= documents).select("anchor"))
    lists = found.join(common.hint("merge"), "anchor")
    lists = materialize(lists.groupBy(row_key(), "mark").agg(F.collect_set("anchor").alias("anchors")))
    discard(found)
    seen = counted(materialize(met(docs.join(lists.hint("shuffle_hash"), ["known", "mark"]))), led)
    # partial counts make a passage that stands in very many documents one row a task
    wanted = materialize(seen.filter("first AND NOT copy").groupBy("whole").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).filter(F.col("n") >= documents).filter("first_doc IS NOT NULL").drop("n"))
    gone = seen.join(wanted.hint("merge"), "whole").filter(~F.col("who").eqNullSafe(F.col("first_doc")))
    return materialize(gone.groupBy(row_key(), "mark").agg(F.collect_set("at").alias("windows")))


def cut(text: str, starts) -> str:
    """The text without the windows that start at the words of these numbers.

    What is left before and after a passage stays on one line only if it was on one.
    """
    spans = [m.span() for m in WORD.finditer(text)]
    gone = np.zeros(len(spans) + 1, dtype=np.int64)
    for s in starts:
        if s + RUN <= len(spans):
            gone[s] += 1
            gone[s + RUN] -= 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(gone)[:-1] > 0, [0]]).astype(int)))
    out, at = [], 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        start, end = spans[a][0], spans[b - 1][1]
        left = spans[a - 1][1] if a else 0
        right = spans[b][0] if b < len(spans) else len(text)
        before, after = text[left:start], text[end:right]
        if not a:
            joint = before
        elif b == len(spans):
            joint = after
        else:
            joint = before if "\n" in before else after if "\n" in after else "\n" if "\n" in text[start:end] else before
        out += [text[at:left], joint]
        at = right
    return "".join(out) + text[at:]


def without(text: Column, starts: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts, numbers):
        import pandas as pd

        return pd.Series([None if d is None else cut(t, d.tolist()) for t, d in zip(texts, numbers)], dtype=object)

    # texts that stay whole don't go to Python
    return F.when(starts.isNull(), text).otherwise(run(F.when(starts.isNotNull(), F.coalesce(text, F.lit(""))), starts))
