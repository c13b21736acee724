"""Every query agrees with its DuckDB equivalent on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from logweave.plans import catalog

DATA = os.environ.get("LOGWEAVE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def text(v):
    if v is None or str(v) in ("nan", "<NA>", "NaT"):
        return "none"
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(text(v) for v in r) for r in frame[names].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    assert rows(got) == rows(duck.execute(catalog.oracle_sql()[name]).df())


def test_entry(spark):
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
