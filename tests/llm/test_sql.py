"""The queries that SQL can express against their SQL."""

from __future__ import annotations

import duckdb
import pytest

from vesselspark.llm.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_agrees(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{D}/{table}.parquet')")
    df = QUERIES[name](spark, D)
    names = sorted(df.columns)
    cursor = con.execute(ORACLE_SQL[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(columns) == names
    want = sorted(repr(tuple(r[columns.index(n)] for n in names)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == want and want
