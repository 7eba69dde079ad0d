from __future__ import annotations

import duckdb
import pytest

from kindred.llm import licenses, queries
from tests.llm.conftest import SF, wide


def same(spark, rows, **options):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(con.execute("SELECT doc_id, license_id, containment FROM (" + licenses.oracle(**options) + ")").fetchall(), key=repr)
    got = sorted((tuple(r) for r in licenses.scan(wide(spark, rows), **options).collect()), key=repr)
    assert got == want
    return got


def test_query_equals_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op10_license_scan"]).fetchall())
    rows = queries.op10_license_scan(spark, SF)
    assert sorted((r.doc_id, r.license_id, r.containment) for r in rows.collect()) == want and want
    plan = rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("before", [0, 3, 200, 1500])
def test_whole_and_edited_notices(spark, before):
    filler = " ".join(f"word{i}" for i in range(before))
    rows = [(i, f"{filler} {text} {filler}") for i, text in enumerate(licenses.TEMPLATES.values())]
    got = same(spark, rows)
    names = list(licenses.TEMPLATES)
    assert {(i, names[i]) for i in range(len(names))} <= {(d, n) for d, n, c in got if c == 1}
    words = licenses.TEMPLATES["MIT"].split()
    few = " ".join(w if i not in (30, 31, 90) else "changed" for i, w in enumerate(words))
    many = " ".join(w if i % 8 else "changed" for i, w in enumerate(words))
    found = {(d, n) for d, n, _ in same(spark, [(1, f"{filler} {few}"), (2, f"{filler} {many}")])}
    assert (1, "MIT") in found and (2, "MIT") not in found


def test_edges(spark, edge, none):
    assert licenses.scan(edge).count() == 0 and licenses.scan(none).count() == 0
    assert licenses.scan(edge, templates={}).count() == 0 and licenses.scan(edge, templates={"short": "one two"}).count() == 0
    line = "released   UNDER the\nMIT-license!"
    assert same(spark, [(1, line), (1, line), (None, line), (2, None), (3, ""), (4, line * 50)]) == [
        (1, "MIT-line", 1.0), (4, "MIT-line", 1.0), (None, "MIT-line", 1.0)]
    own = {"a": "alpha beta gamma delta epsilon zeta", "b": "it's alpha beta gamma delta epsilon"}
    assert {n for _, n, _ in same(spark, [(1, "x alpha beta gamma delta epsilon zeta y")], templates=own)} == {"a"}


def test_licenses_of_a_family_are_told_apart(spark):
    gnu = ["GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"]
    commons = ["CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"]
    rows = [(i, "This is free software: you can redistribute it and/or modify it " + licenses.TEMPLATES[n]
             + ", or (at your option) any later version.") for i, n in enumerate(gnu)]
    rows += [(10 + i, "Notes. " + licenses.TEMPLATES[n] + " More notes.") for i, n in enumerate(commons)]
    assert {(d, n) for d, n, _ in same(spark, rows)} == {*enumerate(gnu), *enumerate(commons, 10)}
