"""The registered queries against their SQL, run by DuckDB over whole tables."""

import duckdb
import pytest

from tessera.llm.queries import oracle_sql, queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    want = db.sql(oracle_sql()[name])
    got = queries()[name](spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda found, columns: sorted((dict(zip(columns, r, strict=True)) for r in found), key=lambda r: [r[c] for c in ("doc_id", "query_id", "rank") if c in r])
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)
