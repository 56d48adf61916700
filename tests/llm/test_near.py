import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeline.llm import near_duplicates as nd
from gaugeline.llm import setsketch as sk
from gaugeline.llm.shingles import shingle_sets

from .cases import documents, saved

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent=85):
    """rows: (doc_id, text); the contract by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((((d, len(sets[i]), c := d if not sets[i] else least.get(root(i)), d == c)) for i, (d, _) in enumerate(rows)), key=str)


def edited(words, r, share):
    return [r.choice(["zig", "zag", "zog"]) + str(r.randint(0, 999)) if r.random() < share else w for w in words]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aAbB é\n\t\x0b\x1c", max_size=60), min_size=1, max_size=5))
def test_sets_hold_the_distinct_shingles(texts):
    assert [len(s) for s in shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]


def test_a_set_gives_the_same_hashes_in_any_company():
    texts = ["one two three", "", "A b c d e f g", "  x  ", "A b c d e f g"]
    together = list(shingle_sets(pa.array(texts)))
    for t, s in zip(texts, together):
        assert list(next(iter(shingle_sets(pa.array([t]))))) == list(s)


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(5)
    x = r.integers(0, 2**63, 700, dtype=np.uint64)
    a, b = x[:400], x[100:]
    one = sk.sketches([a, b, np.unique(np.concatenate([a, b]))])
    assert (sk.merge(one[0], one[1]) == one[2]).all()
    alone = sk.sketches([a])
    assert (alone[0] == one[0]).all()
    near = sum(bool(sk.at_least(*sk.sketches([x[i : i + 300], x[i + 20 : i + 320]]), 300, 300, 0.76)) for i in range(100))
    assert near == 100  # similarity 0.875


def test_sharp_sketches_part_similarities():
    r = np.random.default_rng(9)
    x = r.integers(0, 2**63, 40_000, dtype=np.uint64)
    for n in (100, 1000, 20_000):
        # distinct elements in common over all: 0.85 and 0.75
        near, far = round(n * 0.15 / 1.85), round(n * 0.25 / 1.75)
        for k in range(20):
            sets = [x[k : k + n], x[k + near : k + near + n], x[k + far : k + far + n]]
            a, b, c = sk.sharp(sets)
            assert sk.sharply(a, b, 0.85) and not sk.sharply(a, c, 0.85)
            assert (sk.sharp(sets[:1])[0] == a).all() and len(a) == sk.SHARP // 4
    assert sk.sharply(sk.sharp([x[:5]])[0], sk.sharp([x[:5], x[:9]]), 0.85).tolist() == [True, False]


def test_classes_links_and_components_equal_brute_force(spark, tmp_path):
    r = random.Random(11)
    rows, doc = [], 1000
    for group in range(12):
        base = [r.choice("the of in a to re st ou".split()) + str(r.randint(0, 3000)) for _ in range(r.choice([6, 7, 9, 40, 150, 400]))]
        chain = base
        for k in range(r.choice([2, 6, 25])):
            rows.append((doc, " ".join(edited(base, r, r.choice([0, 0, 0.01, 0.02, 0.05])))))
            chain = edited(chain, r, 0.015)  # links by steps only
            rows.append((doc + 1, "  ".join(chain).upper() if k % 2 else "\n".join(chain)))
            doc += 2
    r.shuffle(rows)
    df = documents(spark, rows, n=30)
    path = saved(df, tmp_path)
    want = brute([(x["doc_id"], x["text"]) for x in df.select("doc_id", "text").collect()])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for block in (1000, 4):
        assert sorted(map(tuple, nd.near_duplicates(docs, block=block).collect()), key=str) == want
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def exact_components(rows, percent=85):
    """doc_id -> least doc_id of its component, by an exact join on the rarest shingles of each set."""
    sets = {d: shingles(t) for d, t in rows}
    often = Counter(x for v in sets.values() for x in v)
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            root[d] = root[root[d]]
            d = root[d]
        return d

    first, found = {}, defaultdict(list)
    for d in sorted(sets, key=lambda d: (len(sets[d]), d)):
        x = sets[d]
        if x in first:
            root[top(d)] = top(first[x])
        elif x:
            first[x] = d
            # sets of the similarity have one of so many rarest shingles in common
            rarest = sorted(x, key=lambda v: (often[v], v))[: len(x) - -(-percent * len(x) // 100) + 1]
            for e in {e for v in rarest for e in found[v] if 100 * len(sets[e]) >= percent * len(x)}:
                both = len(x & sets[e])
                if 100 * both >= percent * (len(x) + len(sets[e]) - both):
                    root[top(d)] = top(e)
            for v in rarest:
                found[v].append(d)
    least = {}
    for d in sorted(sets):
        least.setdefault(top(d), d)
    return {d: least[top(d)] for d in sets}


def test_components_of_a_whole_table_equal_an_exact_join(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    want = exact_components([tuple(r) for r in docs.collect()])
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(docs).collect()}
    assert len(got) == len(want) and sum(d != c for d, c in want.items()) > 100
    assert [d for d in want if want[d] != got[d]] == []


def test_one_row_of_each_group_stays(spark):
    r = random.Random(3)
    text = [" ".join(r.choice("abcdefgh") + r.choice("ijklmnop") for _ in range(60)) for _ in range(5)]
    rows = [(5, text[0]), (5, text[0]), (6, text[0]), (None, text[0] + " end"), (None, text[1]), (None, text[1]), (None, text[1] + " end"), (8, text[2]), (8, text[3]), (3, text[3] + " end"), (9, None), (9, None), (None, " ")]
    docs = spark.createDataFrame([(d, t, "x", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, mark string, known int")
    left = nd.one_of_each(docs, 80)
    assert left.columns == docs.columns
    got = [(x["doc_id"], x["text"]) for x in left.collect()]
    assert [t for d, t in got if d == 5] == [text[0]]
    assert len([t for d, t in got if d is None and (t or "").startswith(text[1])]) == 1
    assert [(d, t) for d, t in got if d in (3, 8)] in ([(8, text[2]), (3, rows[9][1])], [(3, rows[9][1]), (8, text[2])])
    comps = sorted((x["doc_id"], x["component_id"], x["kept"]) for x in nd.near_duplicates(docs, 80).filter("doc_id IN (3, 5, 6, 8)").collect())
    assert comps == [(3, 3, True), (5, 5, True), (5, 5, True), (6, 5, False), (8, 3, False), (8, 8, True)]
    assert len([t for _, t in got if not (t or "").strip()]) == 3
