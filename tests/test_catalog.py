"""Registered queries against their SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from graphmill.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()
NAMES = sorted(SQL)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    theirs = sorted((tuple(map(plain, r)) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=key)
    assert [tuple(map(str, r)) for r in ours] == [tuple(map(str, r)) for r in theirs]


def test_every_query_has_a_name_of_its_own():
    from graphmill.plans.catalog import MODULES

    names = [n for m in MODULES for n in m.QUERIES]
    assert len(names) == len(set(names))


def test_trust_marks_are_counted_in_the_roll_up(spark, sf_dir):
    """Claims are joined once and scores meet the orders, so line items are not shuffled again by subject."""
    df = catalog.queries()["composition_trust_show_all"](spark, sf_dir)
    tree = df._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in tree.splitlines() if "Join " in line]) == 3
    assert df.columns == ["food", "chem", "n_fdc", "n_dmd", "n_lit", "median", "n_low"]
