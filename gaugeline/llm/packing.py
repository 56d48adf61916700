"""Best-fit packing by linear grouping (operator 9).

Documents become pieces of at most ``capacity`` tokens.  How many pieces there are of each length is
all the planner needs, at most ``capacity`` numbers, whatever the size of the corpus:

1. lengths over ``small`` are split, in order, into groups of equal numbers of pieces and rounded up
   to the longest of their group;
2. the few rounded sizes are packed by the configuration program (how many sequences hold which
   multiset of sizes), solved with column generation and rounded down;
3. actual pieces take the rounded places, the longest first, which leaves room in the sequences;
4. what is left of the large pieces and all small ones go, longest first, each to the sequence with
   the least room that suffices.

Sequences alike are handled together as runs, so the plan is small, too.  A piece finds its sequence
by its length and its rank among pieces of that length.

Null and empty texts are a single end id; an empty table gives an empty result; repeated rows are
separate documents; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, materialize, table
from .shingles import slices
from .tokens import SLICE, encoding

CAPACITY, END, GROUPS, SMALL, ROUNDS = 1024, 2, 96, 100, 600
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A piece's number in its task, by which pieces of equal documents part.
NUMBER = "number long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """A row per piece; of a document that is cut, the first piece may be shorter."""

    def cut(batches):
        import pyarrow as pa

        made = 0
        with encoding(path) as enc:
            for batch in batches:
                for i, j, texts in slices(batch.column("text"), SLICE // 4):
                    ids, bounds = enc.encode_column(texts, end)
                    rows = [[], [], [], [], []]
                    for doc, a, b in zip(batch.column("doc_id")[i:j].to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                        at, k = a, 0
                        while at < b:
                            size = (b - at) % capacity or capacity
                            for column, value in zip(rows, (doc, k, at - a, size, zlib.crc32(ids[at : at + size]))):
                                column.append(value)
                            at, k = at + size, k + 1
                    rows.append(range(made, made := made + len(rows[0])))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), *[pa.int64()] * 4))], names=["doc_id", "piece", "start", "length", "ids_crc32", "number"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), cut, f"{PIECE}, {NUMBER}")


def grouped(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths and their counts, longest first, in groups of about equal numbers of pieces."""
    share = -(-sum(counts.values()) // groups) if counts else 1
    out, here, room = [], [], share
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            k = min(n, room)
            here.append((length, k))
            n, room = n - k, room - k
            if not room:
                out, here, room = [*out, here], [], share
    return [*out, here] if here else out


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Fractional numbers of sequences for configurations that cover ``need`` with few sequences."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse, x = np.diag(1 / np.diag(basis)), need / np.diag(basis)
    for _ in range(rounds):
        price = np.ones(k) @ inverse
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for g in np.argsort(-price / sizes):
            s, y = int(sizes[g]), price[g]
            if y <= 1e-12:
                continue
            for a in range(s, capacity + 1, s):
                b = min(a + s, capacity + 1)
                better = best[a - s : b - s] + y
                win = better > best[a:b] + 1e-12
                best[a:b][win] = better[win]
                last[a:b][win] = g
        column, c = np.zeros(k), int(best.argmax())
        while last[c] >= 0:
            column[last[c]] += 1
            c -= int(sizes[last[c]])
        if price @ column <= 1 + 1e-7:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    return [(basis[:, j].astype(int), float(x[j])) for j in range(k)]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Places for runs of pieces: (length, first rank, number, pieces per sequence, first sequence, offset).

    The second value is the number of sequences.
    """
    used: dict[int, int] = defaultdict(int)  # pieces of each length that have a place
    places: list[tuple[int, int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room: first sequence, number
    made = 0

    def put(length: int, number: int, per: int, first: int, offset: int) -> None:
        places.append((length, used[length], number, per, first, offset))
        used[length] += number

    if counts.get(capacity):
        put(capacity, counts[capacity], 1, 0, 0)
        made = counts[capacity]
    large = grouped({n: c for n, c in counts.items() if small < n < capacity and c}, groups)
    if large:
        sizes = np.array([g[0][0] for g in large])
        queues = [list(reversed(g)) for g in large]
        for column, times in sorted(configurations(sizes, np.array([float(sum(c for _, c in g)) for g in large]), capacity), key=lambda p: -p[1]):
            times = int(times + 1e-6)
            slots = [g for g in np.flatnonzero(column) for _ in range(column[g])]
            times = min([times, *(sum(c for _, c in queues[g]) // int(column[g]) for g in set(slots))])
            if not times or not slots:
                continue
            filled = []
            for g in slots:
                left, here = times, []
                while left:
                    length, c = queues[g].pop()
                    if c > left:
                        queues[g].append((length, c - left))
                        c = left
                    here.append((length, c))
                    left -= c
                filled.append(here)
            edges = sorted({0, *(int(e) for f in filled for e in np.cumsum([c for _, c in f]))})
            for a, b in zip(edges, edges[1:]):
                offset = 0
                for f in filled:
                    at = 0
                    for length, c in f:
                        at += c
                        if a < at:
                            break
                    put(length, b - a, 1, made + a, offset)
                    offset += length
                runs[capacity - offset].append((made + a, b - a))
            made += times
    rooms = sorted(runs)
    heap = list(rooms)

    def push(room: int, first: int, number: int) -> None:
        if room and number:
            if not runs[room]:
                heapq.heappush(heap, room)
            runs[room].append((first, number))

    heapq.heapify(heap)
    for length in sorted(counts, reverse=True):
        left = counts[length] - used[length]
        short = []  # rooms too small for this length
        while left:
            while heap and (heap[0] < length or not runs[heap[0]]):
                room = heapq.heappop(heap)
                if runs[room]:
                    short.append(room)
            if heap:
                room = heap[0]
                first, number = runs[room].pop()
            else:
                room, first, number = capacity, made, -(-left // (capacity // length))
                made += number
            per = room // length
            full = min(number, left // per)
            if full:
                put(length, full * per, per, first, capacity - room)
                push(room - per * length, first, full)
                left -= full * per
            if left and full < number:  # fewer than a sequence can hold
                put(length, left, left, first + full, capacity - room)
                push(room - left * length, first + full, 1)
                full, left = full + 1, 0
            push(room, first + full, number - full)
        for room in short:
            heapq.heappush(heap, room)
    return places, made


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, groups: int = GROUPS, small: int = SMALL, path: str | None = None) -> DataFrame:
    """The pieces with sequence_id and offset.

    A rank within a length comes from counts by (length, slice of a hash): no length, however common,
    and no document, however often repeated, is ranked in one task, and what the driver gets is a
    number for each length.
    """
    cut = materialize(pieces(docs, capacity, end, path))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places, _ = plan(counts, capacity, groups, small)
    slices = min(4096, max(32, sum(counts.values()) // 20_000))
    sliced = cut.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "number"), F.lit(slices)).cast("int"))
    tally = sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    run = W.partitionBy("length").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    tally = tally.select("length", "slice", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    order = W.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32", "number")
    ranked = sliced.withColumn("nth", F.row_number().over(order)).join(tally, ["length", "slice"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))
    arrays = np.array(sorted(places), dtype=np.int64).reshape(-1, 6)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            order = np.lexsort((rank, length))
            # of the places of a length, the last that begins at or before the rank
            key = (arrays[:, 0] << 44) + arrays[:, 1]
            at = np.empty(len(order), dtype=np.int64)
            at[order] = np.searchsorted(key, ((length << 44) + rank)[order], side="right") - 1
            p = arrays[at]
            nth = rank - p[:, 1]
            columns = [*batch.columns[:5], pa.array(p[:, 4] + nth // p[:, 3]), pa.array(p[:, 5] + nth % p[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_arrow(ranked, place, PIECE + ", sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
