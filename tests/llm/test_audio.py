import hashlib
import zlib

import numpy as np

from gaugeline.llm import audio

from .cases import documents, prose, saved


def test_stored_samples_read_back(spark, tmp_path):
    docs = documents(spark, [(8000, "é" * 200_000), (8001, prose(1, 96))])
    got = audio.query(spark, saved(docs, tmp_path)).collect()
    want = []
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.append((r["doc_id"], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), 44 + len(payload), hashlib.sha256(audio.wav(payload)).hexdigest()))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        assert by.setdefault(r["payload_sha256"], r["feature"]) == r["feature"]
    assert len(set(by.values())) == len(by)


def test_resampling_keeps_a_tone_and_removes_what_would_fold():
    t = np.arange(16_000) / 16_000
    phases = audio.low_pass(1, 2)
    kept = audio.resampled(np.sin(2 * np.pi * 500 * t).astype(np.float32), 1, 2, phases)[200:-200]
    gone = audio.resampled(np.sin(2 * np.pi * 6500 * t).astype(np.float32), 1, 2, phases)[200:-200]
    assert abs(kept.std() - np.sqrt(0.5)) < 0.01 and gone.std() < 0.02
    spectrum = np.abs(np.fft.rfft(audio.resampled(np.sin(2 * np.pi * 440 * t).astype(np.float32), 1, 2, phases)))
    assert spectrum.argmax() == 440
    other = audio.resampled(np.sin(2 * np.pi * 440 * t).astype(np.float32), 3, 4, audio.low_pass(3, 4))
    assert len(other) == 12_000 and np.abs(np.fft.rfft(other)).argmax() == 440


def test_frames_equal_a_plain_transform_and_tones_land_in_their_band():
    r = np.random.default_rng(3)
    x = r.normal(size=2000).astype(np.float32)
    mels, power = audio.log_mel(x, audio.mel_bank(), np.hanning(audio.FRAME).astype(np.float32))
    padded = np.concatenate([x, np.zeros(audio.FRAME)])
    for i in (0, 3, len(mels) - 1):
        part = padded[i * audio.HOP : i * audio.HOP + audio.FRAME] * np.hanning(audio.FRAME)
        want = np.log10(np.maximum(np.abs(np.fft.rfft(part)) ** 2 @ audio.mel_bank(), 1e-10))
        assert np.allclose(mels[i], want, atol=1e-3)


def test_hysteresis():
    power = np.array([0, 0, 0, 0, 0, 4, 2, 2, 0, 2, 2, 5, 0, 0], dtype=np.float32)
    assert audio.hysteresis(power).tolist() == [[5, 8], [11, 12]]


def test_tensors_have_one_shape_and_time_spans(spark):
    docs = spark.createDataFrame([(1, prose(1, 3000)), (2, "short")], "doc_id long, text string")
    for r in audio.features(audio.to_wav(docs)).collect():
        read = audio.read_tensors(bytes(r["tensors"]))
        tensors = read["log_mel"].combine_chunks()
        tensors = tensors.chunk(0) if hasattr(tensors, "chunk") else tensors
        assert tensors.to_numpy_ndarray().shape == (-(-r["frames"] // audio.WINDOW), audio.WINDOW, audio.MELS)
        assert read["end"].to_pylist()[-1] == r["frames"] * audio.HOP / audio.TARGET
    assert audio.features(audio.to_wav(docs.limit(0))).count() == 0
