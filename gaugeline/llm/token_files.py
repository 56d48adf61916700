"""Token files: a zstandard frame per document under one trained dictionary (operator 6).

A corpus is a folder with ``dictionary-<sha256>.zdict`` and shard files in ascending doc_id order.
A shard, all numbers little-endian::

    8 bytes   b"GLTOKEN1"
    32 bytes  sha256 of the dictionary (zeros: none)
    frames    a document's ids, unsigned 16- or 32-bit, compressed by itself
    index     per document: doc_id int64, known uint8, offset uint64, size uint32, ids uint32
    40 bytes  index offset, documents, ids, bytes of an id, each uint64; b"GLTOKEN1"

so a short document is read with two small reads, wherever it is.

The dictionary is trained on a bounded sample: some ``sample`` documents of up to ``longest``
characters, picked by a hash of doc_id; it changes sizes only, never contents.  With fewer than
``least`` documents in the sample there is none.

Null and empty texts are a single end id.  Null doc_ids come first.  Repeated rows are separate
documents, and rows of one doc_id stand in any order.  An empty table makes no shards and an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import filesystem, map_arrow, materialize, shared_dir, table
from .shingles import slices
from .tokens import SLICE, encoder, encoding

MAGIC, END = b"GLTOKEN1", 2
INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("offset", "<u8"), ("size", "<u4"), ("ids", "<u4")])
TAIL = struct.Struct("<QQQQ8s")
#: Documents of a shard, about; the most shards.
SHARD, MOST = 2_000, 100_000
#: Where null ids stand among the others.
LOWEST = -(1 << 63)


def train(docs: DataFrame, rows: int, sample: int = 1500, longest: int = 20_000, least: int = 50, size: int = 65_536, path: str | None = None) -> bytes:
    """The dictionary, of serialized id arrays of a sample whose size doesn't depend on the table's."""
    import zstandard

    share = min(1.0, sample / max(rows, 1))
    picked = docs.filter(F.length("text") <= longest).filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = [r["text"] for r in picked.select("text").limit(2 * sample).collect()]
    if len(texts) < least:
        return b""
    width = "<u2" if encoder(path).size <= 65_536 else "<u4"
    arrays = [np.frombuffer(x, "<u4").astype(width).tobytes() for x in encoder(path).encode(sorted(texts))]
    try:
        return zstandard.train_dictionary(size, arrays, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


def shards_of(ids: np.ndarray, bounds: np.ndarray, number: int) -> np.ndarray:
    """The shard of each document; ``number`` is that of the first in its task.

    An id that ``bounds`` has r times takes r shards in turn, so an id that many rows share isn't one file.
    """
    low, high = np.searchsorted(bounds, ids, side="left"), np.searchsorted(bounds, ids, side="right")
    return np.where(high > low, low + 1 + (number + np.arange(len(ids))) % np.maximum(high - low, 1), low).astype(np.int32)


def compressed(docs: DataFrame, dictionary: bytes, bounds: list[int], end: int = END, path: str | None = None, level: int = 3) -> DataFrame:
    """doc_id, shard, ids, frame."""

    def encode(batches):
        import pyarrow as pa
        import zstandard

        number, cuts = 0, np.array(bounds, dtype=np.int64)
        with encoding(path) as enc:
            wide = enc.size > 65_536
            known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
            if known:
                known.precompute_compress(level)
            zstd = zstandard.ZstdCompressor(level=level, dict_data=known) if known else zstandard.ZstdCompressor(level=level)
            for batch in batches:
                for i, j, texts in slices(batch.column("text"), SLICE):
                    ids, at = enc.encode_column(texts, end)
                    doc = batch.column("doc_id").slice(i, j - i)
                    shard = shards_of(doc.fill_null(LOWEST).to_numpy(zero_copy_only=False), cuts, number)
                    number += j - i
                    ids = ids if wide else ids.astype("<u2")
                    frames = [zstd.compress(ids[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]
                    yield pa.RecordBatch.from_arrays([doc, pa.array(shard, pa.int32()), pa.array(np.diff(at)), pa.array(frames, pa.binary())], names=["doc_id", "shard", "ids", "frame"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), encode, "doc_id long, shard int, ids long, frame binary")


class ShardWriter:
    """Writes under a name of its own and moves the finished file: a task run twice does no harm."""

    def __init__(self, folder: str, shard: int, dictionary_hash: bytes, width: int):
        self.fs, path = filesystem(folder)
        self.final, self.draft = f"{path}/shard-{shard:08d}.gltok", f"{path}/.shard-{shard:08d}-{uuid.uuid4().hex}"
        self.out, self.shard, self.width, self.rows, self.at, self.ids = self.fs.open_output_stream(self.draft), shard, width, [], 40, 0
        self.out.write(MAGIC + dictionary_hash)

    def add(self, doc_id: int | None, ids: int, frame: bytes) -> None:
        self.out.write(frame)
        self.rows.append((doc_id or 0, doc_id is not None, self.at, len(frame), ids))
        self.at, self.ids = self.at + len(frame), self.ids + ids

    def close(self) -> tuple[int, str, int, int]:
        self.out.write(np.array(self.rows, dtype=INDEX).tobytes())
        self.out.write(TAIL.pack(self.at, len(self.rows), self.ids, self.width, MAGIC))
        self.out.close()
        self.fs.move(self.draft, self.final)
        return self.shard, self.final, len(self.rows), self.ids


class ShardReader:
    """Reads any document of a shard by its place or its id."""

    def __init__(self, fs, path: str, dictionary: bytes = b""):
        import zstandard

        self.file = fs.open_input_file(path)
        if self.file.read(8) != MAGIC:
            raise ValueError(f"{path} is no token file")
        said = self.file.read(32)
        if said != (hashlib.sha256(dictionary).digest() if dictionary else bytes(32)):
            raise ValueError(f"{path} was written under another dictionary")
        self.file.seek(self.file.size() - TAIL.size)
        at, documents, self.ids, self.width, magic = TAIL.unpack(self.file.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is cut off")
        self.file.seek(at)
        self.index = np.frombuffer(self.file.read(documents * INDEX.itemsize), INDEX)
        self.zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def document(self, place: int) -> np.ndarray:
        row = self.index[place]
        self.file.seek(int(row["offset"]))
        raw = self.zstd.decompress(self.file.read(int(row["size"])), max_output_size=int(row["ids"]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")

    def find(self, doc_id: int) -> np.ndarray | None:
        first = int(np.count_nonzero(self.index["known"] == 0))
        place = first + int(np.searchsorted(self.index["doc_id"][first:], doc_id))
        return self.document(place) if place < len(self.index) and self.index[place]["doc_id"] == doc_id else None


def write(docs: DataFrame, folder: str, end: int = END, path: str | None = None) -> tuple[DataFrame, bytes]:
    """Writes the files; gives (shard, path, documents, ids, start) a shard, and the dictionary.

    Shards are ranges of doc_id cut at approximate quantiles, several for an id that many rows share.
    Frames, not texts, are shuffled, each shard to a task of its own.
    """
    rows = docs.count()
    shards = max(1, min(MOST, max(32, -(-rows // SHARD)), rows))
    known = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    bounds = sorted(docs.agg(F.percentile_approx(known, [i / shards for i in range(1, shards)] or [0.5], 100_000)).first()[0] or [])
    dictionary = train(docs, rows, path=path)
    digest = hashlib.sha256(dictionary).digest() if dictionary else bytes(32)
    fs, place = filesystem(folder)
    fs.create_dir(place)
    with fs.open_output_stream(f"{place}/dictionary-{digest.hex()}.zdict") as out:
        out.write(dictionary)
    width = 4 if encoder(path).size > 65_536 else 2

    def save(batches):
        import pyarrow as pa

        writer, done = None, []
        for batch in batches:
            for doc, shard, ids, frame in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "shard", "ids", "frame"))):
                if writer is None or writer.shard != shard:
                    done += [writer.close()] if writer else []
                    writer = ShardWriter(folder, shard, digest, width)
                writer.add(doc, ids, frame)
        done += [writer.close()] if writer else []
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["shard", "path", "documents", "ids"])

    spread = compressed(docs, dictionary, bounds, end, path).repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "doc_id", "ids", "frame")
    made = materialize(map_arrow(spread, save, "shard int, path string, documents long, ids long"))
    run = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # a row per file
    return made.withColumn("start", F.coalesce(F.sum("ids").over(run), F.lit(0))), dictionary


def read(shards: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def load(batches):
        import pyarrow as pa

        fs, _ = filesystem(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                shard = ShardReader(fs, path, dictionary)
                counts = shard.index["ids"].astype(np.int64)
                starts = start + np.cumsum(counts) - counts
                for a in range(0, len(counts), 2000):
                    b = min(a + 2000, len(counts))
                    sums = [zlib.crc32(shard.document(i).astype("<u4").tobytes()) for i in range(a, b)]
                    doc = pa.array(shard.index["doc_id"][a:b].astype(np.int64), mask=shard.index["known"][a:b] == 0)
                    yield pa.RecordBatch.from_arrays([doc, pa.array(starts[a:b]), pa.array(counts[a:b]), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(shards.select("path", "start").repartition(n), load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens"
    shards, dictionary = write(table(spark, sf_dir, "documents"), folder)
    return read(shards, folder, dictionary)
