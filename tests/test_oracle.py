"""Every registered query against its SQL twin, on the small tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from kindred.catalog import REGISTRY
from tools import compare

SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in REGISTRY}


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, sf_dir, con):
    df = entry.queries()[name](spark, sf_dir)
    assert compare.diff(compare.spark_frame(df), compare.oracle_frame(con, SQL[name])) is None
    assert compare.types_differ(df, con, SQL[name]) == []


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_inventory_row_has_a_query():
    sections = {"s": 9, "f": 17, "j": 13, "a": 10, "w": 9, "k": 5, "u": 7, "x": 21, "t": 8, "v": 4, "p": 8}
    have = {name[:3] for name in entry.queries()}
    missing = [f"{s}{i:02d}" for s, n in sections.items() for i in range(1, n + 1) if f"{s}{i:02d}" not in have]
    assert missing == []
