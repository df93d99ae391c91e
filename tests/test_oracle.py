"""Every registered engine query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from treeflow import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cell(x):
    return "nan" if isinstance(x, float) and x != x else repr(float(x)) if hasattr(x, "as_tuple") else repr(x)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in queries.ORACLE_SQL:
        rel = duck.sql(queries.ORACLE_SQL[name])
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        want = sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())
        as_float = lambda rows: [tuple(x if x in ("nan",) or not x.replace(".", "").replace("-", "").replace("e", "").isdigit() else repr(float(x)) for x in r) for r in rows]
        assert sorted(as_float(got)) == sorted(as_float(want))
