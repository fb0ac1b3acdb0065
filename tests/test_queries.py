import os

import duckdb
import pytest

import __spark_entry__ as entry

CORE = sorted(entry.oracle_sql())


def shown(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in os.listdir(data):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{data}/{t}'")
    return c


@pytest.mark.parametrize("name", CORE)
def test_matches_sql(spark, duck, data, name):
    df = entry.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(str([shown(r[c]) for c in cols]) for r in df.collect())
    rel = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert got == sorted(str([shown(r[names.index(c)]) for c in cols]) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry_is_sound():
    assert set(entry.oracle_sql()) <= set(entry.queries())
