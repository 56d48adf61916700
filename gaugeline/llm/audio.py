"""Audio features of a media column (operator 7).

``to_wav`` stores bytes as 8-bit mono PCM in a RIFF file, which is lossless.  ``features`` reads such
files back: a polyphase filter resamples them, overlapped Hann frames give log-mel energies, frames
whose energy passes an upper threshold open a segment that lasts until it falls below a lower one,
and the frames are cut into tensors of one fixed shape with time spans, as an Arrow stream whose
column has the fixed-shape tensor type.

The query writes the media column to the shared folder and computes features from what it reads
there.  Samples at 12 kHz become 8 kHz, two filter phases by turns.

A file is computed by itself and long ones block by block, always at the same places, so equal files
give equal values and memory doesn't grow with a file beyond its samples and its features.

Null and empty texts are one block of blanks; an empty table gives an empty result; repeated rows are
computed alike; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialize, table

RATE, TARGET = 12_000, 8_000
FRAME, HOP, MELS, WINDOW = 256, 128, 40, 32
TAPS, UPPER, LOWER = 16, 3.0, 1.0
UNIT = 192
#: Frames computed at a time.
BLOCK = 8192
MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, segments array<struct<start:double,end:double>>, tensors binary"


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of 8-bit mono samples; its data chunk is padded to an even length."""
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + len(data), b"WAVE") + head + data


def samples(media) -> tuple[memoryview, int]:
    """The payload of a file that ``wav`` wrote, and its rate."""
    media, at, rate = memoryview(media), 12, 0
    if bytes(media[:4]) != b"RIFF" or bytes(media[8:12]) != b"WAVE":
        raise ValueError("no RIFF file of samples")
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("a RIFF file without samples")


def low_pass(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """Phases of a windowed sinc: row p holds the taps that an output of phase p sees."""
    wide = max(up, down)
    n = 2 * taps * wide // up * up
    t = (np.arange(n) - n / 2 + 0.5) / wide
    h = np.sinc(t) * np.hanning(n)
    h = h / h.sum() * up
    return np.stack([h[p::up][::-1] for p in range(up)]).astype(np.float32)


def resampled(x: np.ndarray, up: int, down: int, phases: np.ndarray) -> np.ndarray:
    """Output m is the inner product of the taps of phase ``m * down % up`` with the inputs around it."""
    k = phases.shape[1]
    padded = np.concatenate([np.zeros(k // 2, np.float32), x, np.zeros(k // 2 + 1, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, k)
    out = np.empty(-(-len(x) * up // down), np.float32)
    for first in range(min(up, len(out))):
        at = np.arange(first, len(out), up) * down // up
        out[first::up] = windows[at[0] : at[-1] + 1 : down] @ phases[first * down % up]
    return out


def mel_bank(rate: int = TARGET, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.arange(frame // 2 + 1) * rate / frame
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(x: np.ndarray, bank: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies and the energy in decibels of each frame."""
    n = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.concatenate([x, np.zeros((n - 1) * HOP + FRAME - len(x), np.float32)]) if len(x) < (n - 1) * HOP + FRAME else x
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]
    mels, power = np.empty((n, bank.shape[1]), np.float32), np.empty(n, np.float32)
    for a in range(0, n, BLOCK):
        part = frames[a : a + BLOCK] * window
        spectrum = np.fft.rfft(part)
        energy = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mels[a : a + BLOCK] = np.log10(np.maximum(energy @ bank, 1e-10))
        power[a : a + BLOCK] = 10 * np.log10(np.maximum(np.einsum("ij,ij->i", part, part), 1e-10))
    return mels, power


def hysteresis(power: np.ndarray, upper: float = UPPER, lower: float = LOWER) -> np.ndarray:
    """Runs of frames, as rows (first, end): over median + upper opens, under median + lower closes."""
    level = np.median(power)
    mark = np.where(power > level + upper, 1, np.where(power < level + lower, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.concatenate([[False], (last >= 0) & (mark[last] == 1), [False]])
    return np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)


class Extractor:
    """The tables that every file needs, made once."""

    def __init__(self, target: int = TARGET):
        import pyarrow as pa

        self.target = target
        self.bank, self.hann = mel_bank(target), np.hanning(FRAME).astype(np.float32)
        self.filters: dict[tuple[int, int], np.ndarray] = {}
        self.type = pa.fixed_shape_tensor(pa.float32(), (WINDOW, MELS), dim_names=["frame", "mel"])
        self.schema = pa.schema([("start", pa.float64()), ("end", pa.float64()), ("log_mel", self.type)])

    def __call__(self, payload, rate: int) -> tuple[np.ndarray, list[dict], bytes]:
        """Log-mel rows, segments in seconds, and the tensors as an Arrow stream."""
        import pyarrow as pa

        common = np.gcd(rate, self.target)
        up, down = int(self.target // common), int(rate // common)
        if (up, down) not in self.filters:
            self.filters[up, down] = low_pass(up, down)
        x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
        mels, power = log_mel(resampled(x, up, down, self.filters[up, down]), self.bank, self.hann)
        second = lambda frame: float(frame) * HOP / self.target
        segments = [{"start": second(a), "end": second(b)} for a, b in hysteresis(power)]
        n = -(-len(mels) // WINDOW)
        filled = np.zeros((n * WINDOW, MELS), np.float32)
        filled[: len(mels)] = mels
        starts = np.arange(n) * WINDOW * HOP / self.target
        ends = np.minimum(starts + WINDOW * HOP / self.target, len(mels) * HOP / self.target)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(filled.ravel()), WINDOW * MELS)
        batch = pa.record_batch([pa.array(starts), pa.array(ends), pa.ExtensionArray.from_storage(self.type, flat)], schema=self.schema)
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, self.schema) as out:
            out.write_batch(batch)
        return mels, segments, sink.getvalue()


def to_wav(docs: DataFrame, unit: int = UNIT, rate: int = RATE) -> DataFrame:
    """doc_id, n_bytes and the media column: each text's UTF-8, blanks up to a multiple of ``unit``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts, a = batch.column("doc_id"), batch.column("text"), 0
            sizes, media, held = [], [], 0
            for i, text in enumerate(texts):
                raw = (text.as_py() or "").encode()
                media.append(wav(raw + b" " * ((-len(raw)) % unit if raw else unit), rate))
                sizes.append(len(raw))
                held += len(media[-1])
                if held > 4 << 20 or i + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays([ids[a : i + 1], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
                    sizes, media, held, a = [], [], 0, i + 1

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, MEDIA)


def features(media: DataFrame, target: int = TARGET) -> DataFrame:
    """What the stored files hold and their features; ``tensors`` is an Arrow stream."""

    def run(batches):
        import pyarrow as pa

        extract = Extractor(target)
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "segments", "tensors"]
        long, text = pa.int64(), pa.string()
        types = [long, long, long, text, long, long, text, long, pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())])), pa.binary()]
        for batch in batches:
            rows, held = [], 0
            for doc, n, stored in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media")):
                stored = stored.as_buffer()
                payload, rate = samples(stored)
                mels, segments, tensors = extract(payload, rate)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), len(mels), segments, tensors))
                held += len(tensors)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return map_arrow(media.select("doc_id", "n_bytes", "media"), run, FEATURES)


def read_tensors(stream: bytes):
    """The Arrow table of time spans and fixed-shape tensors."""
    import pyarrow as pa

    return pa.ipc.open_stream(stream).read_all()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(to_wav(table(spark, sf_dir, "documents")))
    out = features(stored)
    feature = F.concat_ws(":", "frames", F.size("segments"), F.sha2(F.concat(F.col("tensors"), F.to_json("segments").cast("binary")), 256))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
