"""Every query that has SQL gives the SQL's rows on the small tables; the others run and keep their schema."""

import os

import duckdb
import pytest

from evidentia.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(v) -> str:
    return "-" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)


def rows(names: list[str], found) -> list:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(shown(r[i]) for i in order) for r in found)


def spark_rows(df) -> list:
    return rows(df.columns, df.collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert spark_rows(got) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_alike_twice(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == spark_rows(QUERIES[name](spark, SF))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
