"""Every registered query with SQL against DuckDB on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallyweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = registry.queries()[name](spark, SF).toArrow().to_pylist()
    rel = duck.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    want = sorted(tuple(plain(v) for _, v in sorted(zip(cols, r, strict=True))) for r in rel.fetchall())
    got = sorted(tuple(plain(v) for _, v in sorted(r.items())) for r in found)
    assert not found or sorted(found[0]) == sorted(cols)
    assert got == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 25
