"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from quillgraph.plans import catalogue, more, readers  # noqa: F401

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for n in NAMES:
        con.sql(f"create view {n} as select * from '{tables}/{n}.parquet'")
    return con


def plain(rows):
    return sorted(str([round(v, 6) if isinstance(v, float) else str(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, tables, duck, name):
    got = catalogue.QUERIES[name](spark, tables)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    assert plain(tuple(r) for r in got.collect()) == plain([r[i] for i in order] for r in want.fetchall())


def test_streamed_sessions_are_the_closed_ones(spark, tables):
    from pyspark.sql import functions as F

    batch = catalogue.gap_sessions(spark, tables).count()
    streamed = catalogue.stream_sessions(spark, tables)
    assert 0.9 * batch < streamed.count() <= batch
    assert streamed.agg(F.min("n")).first()[0] >= 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(e.queries())
