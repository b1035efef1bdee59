"""Every catalogued query against its SQL, compared as the driver does: columns by name, rows without order."""

import math

import duckdb
import pytest

from tidewire.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def cell(x):
    return (x is None, "" if x is None else f"{x:.9g}" if isinstance(x, float) and not math.isnan(x) else str(x))


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in got.collect()]
    assert rows
    if name in catalog.ORACLE_SQL:
        cursor = duck.execute(catalog.ORACLE_SQL[name])
        columns = [d[0] for d in cursor.description]
        assert table(got.columns, rows) == table(columns, cursor.fetchall())
