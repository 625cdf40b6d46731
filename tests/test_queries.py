"""Every registered engine query against its SQL twin, on the smallest tables."""

import os

import pytest

from ledgermill.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _text(x):
    if x is None or x != x:
        return "~"
    return str(x) if isinstance(x, (str, bool)) else f"{float(x):.6f}"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    mine = sorted(tuple(_text(r[c]) for c in columns) for r in got.collect())
    rel = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(_text(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    assert mine == theirs


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
