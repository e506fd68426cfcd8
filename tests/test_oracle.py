"""Every query that has SQL gives what DuckDB makes of that SQL."""

import __spark_entry__
import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)  # a null may come as NaN
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in row) for row in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_agrees_with_sql(spark, sf_dir, sql, name):
    found, wanted = __spark_entry__.queries()[name](spark, sf_dir).toPandas(), sql.execute(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).columns == ["pair_id", "seq1", "seq2", "low_complexity"]
