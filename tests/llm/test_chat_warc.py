import gzip
import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from gaugeline.llm import chat, warc
from gaugeline.llm.common import filesystem

from .cases import ODD, prose


@given(st.one_of(st.text(), st.text(alphabet="\\</turn> #Asistan:"), st.lists(st.sampled_from([*chat.CONTROL, "\\", "a", ">", "\0"])).map("".join)))
def test_escapes_are_reversible_and_leave_no_control_string(text):
    for more in ("", ">"):
        out = chat.escape(text, more)
        assert chat.unescape(out) == text
        assert not any(c in out for c in chat.CONTROL)


def test_conversations_read_back(spark, tmp_path):
    rows = [(i % 7, i // 7, ["user", "assistant", "system", None][i % 4], t) for i, t in enumerate([*ODD, *chat.CONTROL, "</turn> <turn user>\\", prose(3, 4000), *ODD])]
    rows += [(50, 1, "assistant", "same"), (50, 1, "assistant", "same"), (50, None, "user", "first"), (None, 0, "assistant", "lost"), (51, 0, "odd>role </turn>", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS ids", "1 AS position")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.query(spark, str(tmp_path)).collect()}
    said = r"\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    low = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for c, n, role, text in sorted(rows, key=lambda r: (low(r[1]), (r[2] is not None, r[2] or ""), hashlib.sha256((r[3] or "").encode()).hexdigest())):
        groups.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    one = chat.assemble(df.filter("conv_id = 51")).first()
    assert chat.render(one["input_ids"]) == "<turn odd\\>role <\\/turn\\>>x</turn>\n"
    assert chat.query(spark, str(tmp_path)).filter("conv_id = 51").first()["formatted_chars"] == len(chat.render(one["input_ids"]))


def pages(spark):
    big, other = "<p>é漢🙂</p>" * 100, "WARC/1.1\r\n\r\n" * 120
    rows = [(i, f"http://a/{i}", h) for i, h in enumerate([big, big, "small", "small", other, None, "", other + "\r\n\r\n", big, "x" * 999, "x" * 999, "y" * 1000, "y" * 1000])]
    rows += [(30, "http://a/ b\r\nWARC-Type: evil", "odd url"), (31, None, "no url"), (None, "u", "z" * 2000), (5_000, "u", "z" * 2000), (5_000, "u", "z" * 2000), (None, "u", "w" * 3000), (None, "u", "w" * 3000), (None, None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "'y' AS first", "1 AS bytes")


def test_archives_read_back(spark, tmp_path):
    import duckdb

    pages(spark).write.parquet(f"{tmp_path}/pages.parquet")
    pages(spark).limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    low = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    got = sorted(map(tuple, warc.query(spark, str(tmp_path)).collect()), key=low)
    assert got == sorted(duckdb.sql(warc.SQL).fetchall(), key=low)
    assert warc.query(spark, f"{tmp_path}/none").count() == 0


def test_filters_reach_the_reader_and_payloads_are_passed_over(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    warc.write(pages(spark), folder)
    read = warc.read(spark, folder)
    assert read.filter("record_type = 'revisit'").count() == 4
    assert {r["payload"] for r in read.filter(f"record_id = '{warc.URN}0'").collect()} == {None}
    assert [bytes(r["payload"]) for r in read.filter(f"record_id IN ('{warc.URN}8')").collect()] == [("<p>é漢🙂</p>" * 100).encode()]
    assert warc.read(spark, folder, payload=False).filter("payload IS NOT NULL").count() == 0
    reader = warc.WarcReader({"path": folder})
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")])) == [] and reader.wanted
    assert filesystem(folder)[1] == f"{tmp_path}/archives"


def archive(*records):
    out = b""
    for lines, block in records:
        out += b"WARC/1.0\r\n" + b"".join(x + b"\r\n" for x in lines) + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    return out


def test_archives_of_other_makers(spark, tmp_path):
    one = archive(([b"warc-type: warcinfo", b"WARC-Record-ID: <urn:a>"], b"software: x"))
    two = archive(
        ([b"WARC-TYPE: response", b"warc-record-id: <urn:b>", b"Content-Type: application/http;", b" msgtype=response", b"WARC-Target-URI: http://\xff/"], b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nWARC/1.0\r\n\r\nbody"),
        ([b"WARC-Type: response", b"WARC-Record-ID: <urn:c>", b"Content-Type: text/dns"], b"no http here"),
        ([b"WARC-Type: resource", b"WARC-Record-ID: <urn:d>", b"Content-Type: application/http"], b""),
    )
    for name, data in (("plain.warc", one + two), ("one.warc.gz", gzip.compress(one + two)), ("members.warc.gz", gzip.compress(one) + gzip.compress(two))):
        folder = tmp_path / name.replace(".", "-")
        folder.mkdir()
        (folder / name).write_bytes(data)
        got = {r["record_id"]: r for r in warc.read(spark, f"file://{folder}").collect()}
        assert {k: r["payload"] and bytes(r["payload"]) for k, r in got.items()} == {"urn:a": None, "urn:b": b"WARC/1.0\r\n\r\nbody", "urn:c": b"no http here", "urn:d": b""}
        assert got["urn:b"]["target_uri"] == "http://\ufffd/"
        assert warc.read(spark, f"file://{folder}", payload=False).filter("record_type = 'response'").count() == 2


@pytest.mark.parametrize("lost", [1, 4, 8, 30])
def test_archives_that_are_cut_off_raise(tmp_path, lost):
    data = archive(([b"WARC-Type: response", b"WARC-Record-ID: <urn:b>"], b"0123456789"))
    (tmp_path / "a.warc").write_bytes(data[:-lost])
    for payload in (True, False):
        with pytest.raises(ValueError, match="cut off"):
            list(warc.records(f"file://{tmp_path}", f"{tmp_path}/a.warc", payload))
