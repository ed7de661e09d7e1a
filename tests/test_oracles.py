"""Every registered query against its SQL on the test tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from tidewalk import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 12) + 0.0
    return x


def rows(table, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in table)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    found = got.collect()
    if name not in registry.ORACLES:
        assert found
        return
    cursor = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(columns) == sorted(got.columns)
    a, b = rows(found, got.columns), rows(want, columns)
    assert len(a) == len(b)
    assert [x for x, y in zip(a, b, strict=True) if x != y][:3] == [y for x, y in zip(a, b, strict=True) if x != y][:3]
    assert found, "no rows"
