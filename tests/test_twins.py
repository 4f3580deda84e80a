"""Every registered query against its SQL twin."""

import math
from decimal import Decimal

import duckdb
import pytest

from opsframe import catalog
from opsframe.catalog.registry import TABLES

FOLDER = "/root/testdata/sf0.001"
ORACLES = catalog.oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def value(v):
    if isinstance(v, Decimal):
        return float(v)
    return None if isinstance(v, float) and math.isnan(v) else v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(name, spark, duck):
    df = catalog.QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    twin = duck.execute(ORACLES[name])
    columns = [d[0] for d in twin.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, rows) == canonical(columns, twin.fetchall())
