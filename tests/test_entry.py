"""The registered queries of the library against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from facetry import queries as own

SQL = own.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query(spark, duck, sf_dir, name):
    df = own.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted(repr([norm(r[names.index(c)]) for c in columns]) for r in result.fetchall())
    assert sorted(repr([norm(r[c]) for c in columns]) for r in df.collect()) == want


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert [r["cnt"] for r in rows] == sorted((r["cnt"] for r in rows), reverse=True) and len(rows) == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_and_columns_reach_the_scan(spark, sf_dir, capsys):
    own.queries()["facet"](spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(o_totalprice" in plan and "o_custkey" not in plan and "Python" not in plan


def test_owner_windows_are_limited_early(spark, sf_dir, capsys):
    own.queries()["owner_topk"](spark, sf_dir).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
