import re
from collections import Counter

import numpy as np

from gaugeline.llm import quality_rules as q

from .cases import documents, prose, saved

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def rows():
    out = [(2000 + i, prose(4000 + i, 60 + i)) for i in range(150)]
    out += [(3000 + i, " ".join(w + "$$$" for w in prose(5000 + i, 60 + i).split())) for i in range(60)]
    out += [(4000 + i, prose(6000 + i, 60 + i).upper()) for i in range(60)]
    return out + [(5000, "a b c a b c d e f\nx y\nx y\n\nx y"), (5001, "the same words again and again " * 400), (5002, " ".join(f"w{i % 900}" for i in range(3600))), (5003, "a a a a"), (5004, "a a a")]


def test_counts_equal_brute_force_and_junk_goes(spark, tmp_path, monkeypatch):
    docs = documents(spark, rows())
    path = saved(docs, tmp_path)
    labels = spark.createDataFrame([(d, int(d < 3000), 0) for d, _ in rows()[:270] if d % 2] + [(2001, None, 0), (None, 1, 0), (3001, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    want = sorted(((r["doc_id"], *brute(r["text"])) for r in docs.collect()), key=str)
    for scan in (q.SCAN, 0):
        monkeypatch.setattr(q, "SCAN", scan)
        got = q.query(spark, path).collect()
        assert sorted((tuple(r)[:7] for r in got), key=str) == want
    by = {r["doc_id"]: r for r in got}
    assert not any(r["kept"] for r in got if r["base_failed"])
    held_out = [d for d, _ in rows()[:270] if d % 2 == 0 and not by[d]["base_failed"]]
    right = sum(by[d]["kept"] == (d < 3000) for d in held_out) / len(held_out)
    assert right >= 0.95
    read = spark.read.parquet(f"{path}/documents.parquet")
    assert q.kept(read, labels).columns == read.columns


def test_without_labels_only_the_base_rejects(spark, tmp_path):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r["kept"], r["base_failed"]) for r in q.judged(docs, none).collect()} <= {(True, False), (False, True)}
    assert q.judged(docs.limit(0), none).count() == 0


def test_a_list_is_ordered_pruned_and_precise():
    r = np.random.default_rng(0)
    x = r.random((3000, len(q.RATIOS)))
    y = ((x[:, 0] > 0.8) | ((x[:, 2] > 0.7) & (x[:, 4] <= 0.3))).astype(int)
    rules = q.learn(x, y)
    names = {n: i for i, (n, _, _) in enumerate(q.RATIOS)}
    bad = np.zeros(len(x), dtype=bool)
    for rule in rules:
        bad |= q._covers([(names[n], s, t) for n, s, t in rule], x)
    assert (bad == (y == 1)).mean() > 0.97
    assert len(rules[0]) <= q.CONDITIONS
