"""Every registered query of the engine against its DuckDB twin, on whole small tables."""

import math

import pytest

from evigraph.plans import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    names = sorted(df.columns)
    mine = sorted(repr([plain(v) for v in r]) for r in df.select(*[f"`{c}`" for c in names]).collect())
    twin = duck.sql(ORACLE_SQL[name])
    assert sorted(twin.columns) == names
    at = [twin.columns.index(c) for c in names]
    assert mine == sorted(repr([plain(r[k]) for k in at]) for r in twin.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, small, name):
    """Other tests compare their operators with brute force; here each must give rows of the whole tables."""
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark, small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
