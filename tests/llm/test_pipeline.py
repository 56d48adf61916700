import zlib

import numpy as np

import corpus_pipeline as cp
from gaugeline.llm.tokens import Encoder

from .cases import documents, prose, saved
from .test_lines import brute as brute_lines
from .test_near import brute as brute_near
from .test_quality import brute as brute_counts


def test_stages_equal_brute_force_one_after_another(spark, tmp_path):
    base = prose(1, 120)
    shared = prose(2, 60).replace("1", "i")
    extra = [(2000 + i, "\n".join([prose(900 + i, 70), shared, prose(9000 + i, 40)])) for i in range(8)] + [(2500, shared)]
    extra += [(3000 + i, prose(60, 300) + f" end{i}") for i in range(2)] + [(4000 + i, base) for i in range(4)]
    extra += [(5000 + i, " ".join(w + "$$$" for w in prose(500 + i, 80).split())) for i in range(40)]
    docs = documents(spark, extra)
    path = saved(docs, tmp_path)
    spark.createDataFrame([(d, int(d < 5000), 0) for d, _ in extra] + [(100 + i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{path}/documents.parquet").select(columns)
    steps = [docs]
    for name, stage in cp.STAGES:
        steps.append(cp.materialize(stage(spark, steps[-1], path)))
    assert all(s.columns == columns for s in steps[1:-1])
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    quality, lines, near, mixed = map(pairs, steps[1:5])
    passed = [(d, t) for d, t in pairs(docs) if not brute_counts(t)[-1]]
    assert set(quality) <= set(passed)
    assert {d for d, _ in passed} - {d for d, _ in quality} <= {d for d in range(5000, 5100)}
    assert not {d for d, _ in quality if d and d >= 5000}
    want = []
    leaders = {d: c for d, _, c, _ in brute_near(quality, 80) if d is not None and c != d}
    assert len(leaders) > 3
    for (d, t), (_, gone) in zip(quality, brute_lines(quality, leaders=leaders)):
        left = [x for i, x in enumerate((t or "").split("\n")) if i not in gone]
        if not gone or any(x.strip() for x in left):
            want.append((d, "\n".join(left) if gone else t))
    assert sorted(lines, key=str) == sorted(want, key=str) and len(want) < len(quality)
    stay = {d for d, _, c, kept in brute_near(lines, 80) if kept}
    assert sorted(near, key=str) == sorted({(d, t) for d, t in lines if d in stay}, key=str) and len(near) < len(lines)
    assert set(mixed) <= set(near) and len(mixed) > len(near)
    encoder = Encoder()
    ids = {}
    for d, t in mixed:
        ids.setdefault((d, zlib.crc32(encoder.direct(t or "") + np.array([2], "<u4").tobytes())), 0)
        ids[(d, zlib.crc32(encoder.direct(t or "") + np.array([2], "<u4").tobytes()))] += 1
    packed = steps[-1].collect()
    assert sum(r["piece"] == 0 for r in packed) == len(mixed)
    one = {}
    for r in packed:
        if r["start"] == 0 and (r["doc_id"], r["ids_crc32"]) in ids:
            one[r["doc_id"], r["ids_crc32"]] = one.get((r["doc_id"], r["ids_crc32"]), 0) + 1
    assert all(ids[k] == n for k, n in one.items()) and one
    assert cp.run(spark, path).count() == len(packed)


def test_an_empty_table_goes_through(spark, tmp_path):
    path = saved(documents(spark).limit(0), tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert cp.run(spark, path).count() == 0
