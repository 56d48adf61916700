import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gaugeline.llm import packing, token_files
from gaugeline.llm.tokens import Encoder, vocabulary

from .cases import ODD, documents, prose, saved

ENCODER = Encoder(remembered=200)
#: As the library loads it, without any setting.
UNTOUCHED = Tokenizer.from_file(vocabulary())


def direct(text):
    return UNTOUCHED.encode(text or "", add_special_tokens=False).ids


def test_strings_of_added_tokens_have_their_ids():
    texts = ["see <|endoftext|> now", "<|endoftext|>", "a<|endoftext|><|endoftext|>b c", "see <|endof text|> now"]
    assert [50256 in np.frombuffer(raw, "<u4") for raw in ENCODER.encode(texts)] == [True, True, True, False]
    assert [np.frombuffer(raw, "<u4").tolist() for raw in ENCODER.encode(texts)] == [direct(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet=" \n\ta.'sé 1,", max_size=40), st.sampled_from(ODD)), max_size=6))
def test_remembered_chunks_give_the_tokenizers_ids(texts):
    for raw, text in zip(ENCODER.encode(texts), texts):
        assert np.frombuffer(raw, "<u4").tolist() == direct(text)


def in_order(got, rows):
    """Every document's ids are where they should be; rows of one doc_id may stand in any order."""
    low = lambda d: (d is not None, d or 0)
    crc = lambda ids: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    got = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])][: len(got)]
    assert [low(r[0]) for r in got] == sorted(low(r[0]) for r in got)
    assert sorted((low(r[0]), *r[2:]) for r in got) == sorted((low(d), *crc(ids)) for d, ids in rows)


def test_token_files_read_back(spark, tmp_path):
    docs = documents(spark)
    got = [tuple(r) for r in token_files.query(spark, saved(docs, tmp_path)).collect()]
    in_order(got, [(r["doc_id"], direct(r["text"]) + [2]) for r in docs.collect()])


def test_rows_that_share_an_id_take_several_shards(spark, tmp_path):
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, prose(i, 5)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = f"file://{tmp_path}/files"
    shards, dictionary = token_files.write(docs, folder)
    assert max(r["documents"] for r in shards.collect()) <= 40
    in_order([tuple(r) for r in token_files.read(shards, folder, dictionary).collect()], [(d, direct(t) + [2]) for d, t in rows])


def test_a_short_document_is_found_in_its_shard(spark, tmp_path):
    docs = documents(spark, [(10_000 + i, prose(i, 40)) for i in range(300)])
    shards, dictionary = token_files.write(docs, f"file://{tmp_path}/files")
    assert dictionary
    for shard in shards.collect()[:3]:
        fs, _ = token_files.filesystem(f"file://{tmp_path}/files")
        reader = token_files.ShardReader(fs, shard["path"], dictionary)
        for doc in [int(x["doc_id"]) for x in reader.index if x["known"]][:5]:
            text = docs.filter(f"doc_id = {doc}").first()["text"]
            assert reader.find(doc).tolist() == direct(text) + [2]


def test_empty_tables(spark, tmp_path):
    path = saved(documents(spark).limit(0), tmp_path)
    assert token_files.query(spark, path).count() == 0
    assert packing.query(spark, path).count() == 0


def test_packing_is_whole_gapless_and_close_to_the_bound(spark, tmp_path):
    docs = documents(spark, [(10_000 + i, prose(i, 30 + i % 400)) for i in range(400)])
    got = packing.query(spark, saved(docs, tmp_path)).collect()
    want = {}
    for r in docs.collect():
        ids = direct(r["text"]) + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            key = (r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
            want[key] = want.get(key, 0) + 1
    have = {}
    sequences = {}
    for r in got:
        have[tuple(r)[:5]] = have.get(tuple(r)[:5], 0) + 1
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert have == want
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.1 * sum(r["length"] for r in got) / 1024 + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20), st.integers(1, 12), st.integers(0, 20))
def test_plans_place_every_piece_once(counts, groups, small):
    places, made = packing.plan(counts, 64, groups, small)
    seen, filled = {n: [] for n in counts}, {}
    for length, rank, number, per, first, offset in places:
        seen[length] += range(rank, rank + number)
        for j in range(number):
            filled.setdefault(first + j // per, []).append((offset + j % per * length, length))
    assert all(sorted(seen[n]) == list(range(c)) for n, c in counts.items())
    assert sorted(filled) == list(range(made))
    for x in filled.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 64
