"""Every registered query of the library against its SQL twin, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from caselens.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def key(v):
    return str([key(x) for x in v]) if isinstance(v, list) else repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    result = con.execute(registry.oracle_sql()[name])
    columns = [x[0] for x in result.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted([key(r[c]) for c in order] for r in df.collect())
    want = sorted([key(r[columns.index(c)]) for c in order] for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(NAMES)))
def test_other_queries_give_rows(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["grp", "n", "rate", "tier"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
