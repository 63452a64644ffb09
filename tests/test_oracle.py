"""Every registered query of the core library against its SQL on the small tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from vesselspark.plans import file_queries, more_queries, source_queries, track_queries  # noqa: F401  register their queries
from vesselspark.plans.queries import QUERIES, SQL

D = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return con


def key(row):
    return tuple((x is None, "" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x)) for x in row)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, D)
    names = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=key)
    assert name in SQL, "every query of the core has its SQL"
    cursor = duck.execute(SQL[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(columns) == names
    want = sorted((tuple(r[columns.index(n)] for n in names) for r in cursor.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and math.isclose(x, float(y), rel_tol=1e-9, abs_tol=1e-9), (a, b)
