"""Every query of the engine against its DuckDB equivalent on the smallest driver tables, where they are present."""

import math
import os

import duckdb
import pytest

from gaugeline.plans import catalog, tracking

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    number = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else repr(round(float(v), 9) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(columns), sorted(tuple(number(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    want = duck.sql(catalog.SQL[name])
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("keys", [[999_998], [999_999], [1_199_999, 5, None], [2_147_483_646], [None], []], ids=str)
def test_next_id_equals_its_sql_beyond_six_digits_and_without_keys(spark, tmp_path, keys):
    con = duckdb.connect()
    con.sql("CREATE TABLE part (p_partkey BIGINT)")
    con.sql(f"INSERT INTO part SELECT unnest({keys}::BIGINT[])".replace("None", "NULL"))
    con.sql(f"COPY part TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    df = catalog.QUERIES["next_id"](spark, str(tmp_path))
    assert (df.columns, [tuple(r) for r in df.collect()]) == (["next_id"], con.sql(catalog.SQL["next_id"]).fetchall())


def test_the_operator_of_next_id_cuts_no_number(spark):
    ids = spark.createDataFrame([("EXP_20240101_1199999",), ("EXP_20240101_120000",), ("EXP_20240102_9999999",), (None,)], "id string")
    for width in (3, 6):
        assert tracking.following(ids, "id", "EXP_20240101_", width).first()["next_id"] == "EXP_20240101_1200000"
    assert tracking.following(ids.limit(0), "id", "EXP_20240101_").first()["next_id"] == "EXP_20240101_001"
