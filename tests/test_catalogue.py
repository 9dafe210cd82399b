"""Every query of the catalogue against its SQL on DuckDB."""

import math

import duckdb
import pytest

from reelspan.plans import catalogue


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in ("documents", "events", "embeddings"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) and not math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, small, db, name):
    df = catalogue.QUERIES[name](spark, small)
    result = db.sql(catalogue.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    theirs = sorted((tuple(map(plain, r)) for r in result.fetchall()), key=repr)
    assert ours == theirs and ours


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_has_rows(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_entry_module(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_interval_joins_are_never_cartesian(spark, small):
    for name in ("clip_transcript", "context_semi", "remap_transcript", "point_in_range", "nearest_marker"):
        plan = catalogue.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
