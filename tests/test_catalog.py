import datetime as dt
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from tidelog import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    return str(x) if isinstance(x, (dt.date, dt.datetime)) else float(x) if isinstance(x, Decimal) else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, oracle, name):
    out = catalog.QUERIES[name](spark, SF)
    cursor = oracle.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(out.columns)
    expected = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(r[n]) for n in names) for r in out.collect()), key=repr)
    assert got == expected and (got or name in ("split_plan",))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
