"""Every query with SQL gives the rows that DuckDB gives for that SQL."""

import duckdb
import pytest

from kindred.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def told(value):
    return round(float(value), 9) if isinstance(value, float) or hasattr(value, "as_tuple") else value


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir)
    want = duck.sql(queries.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    places = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(told(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(told(r[k]) for k in places) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
