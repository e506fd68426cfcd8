"""The queries of the text operators that SQL can express give what DuckDB makes of that SQL."""

import duckdb
import pytest

from readloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    wanted = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    found = queries.queries()[name](spark, sf_dir)
    assert sorted(found.columns) == sorted(columns)
    key = lambda row: tuple((x is None, x) for x in row)
    assert sorted(map(tuple, found.select(*columns).collect()), key=key) == sorted(wanted.fetchall(), key=key)
