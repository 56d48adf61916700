import duckdb
import pytest

from gaugeline.llm import mixing

from .cases import documents, prose, saved


def rows_of(df):
    low = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    return sorted(map(tuple, df), key=low)


def both(spark, docs, path):
    saved(docs, path)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    got = mixing.query(spark, str(path))
    want = duckdb.sql(mixing.SQL)
    assert sorted(got.columns) == sorted(want.columns)
    return rows_of(got.select(*want.columns).collect()), rows_of(want.fetchall())


def test_mix_equals_its_sql(spark, tmp_path):
    got, want = both(spark, documents(spark, [(10_000 + i, prose(i, 3 + i % 90)) for i in range(300)]), tmp_path)
    assert got == want
    assert mixing.query(spark, saved(documents(spark).limit(0), tmp_path / "none")).count() == 0


@pytest.mark.parametrize("shared", [9, None])
@pytest.mark.parametrize("different", [False, True])
def test_rows_that_share_an_id_are_taken_one_by_one(spark, tmp_path, shared, different):
    rows = [(shared, prose(i if different else 1, 10), "en", "a", 0) for i in range(300)]
    rows += [(1000 + i, prose(i, 40), "en", "b", 0) for i in range(100)] + [(5000 + i, prose(i, 7), None, None, 0) for i in range(40)]
    docs = spark.createDataFrame(rows, documents(spark).schema).repartition(5)
    got, want = both(spark, docs, tmp_path)
    assert got == want
    targets = {}
    for _, _, source_size, target, taken in got:
        targets.setdefault((source_size, target), []).append(taken)
    assert all(abs(sum(t) - target) <= 20 for (_, target), t in targets.items())
    again = mixing.repeated(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert again.count() == sum(taken // size for _, size, _, _, taken in got if size)
