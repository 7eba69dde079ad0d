from __future__ import annotations

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
# Column names that the operators use inside must do no harm on the way in.
CLASHES = ("row", "block", "data", "bits", "hash", "slots", "score", "label", "ids", "window", "word", "core", "held_out")
EDGE_ROWS = [
    (1, None), (2, ""), (None, "a text without an id"), (3, "the same row"), (3, "the same row"), (4, " \n\t "),
    (5, "x"), (6, "naïve Ünïcode 😀 text " * 3), (7, "the same row"), (None, None), (8, "long words and more " * 20_000),
    (9, "one" * 50_000), (10, "\x00\x1c\x85 odd   marks"),
]


@pytest.fixture(scope="session")
def docs():
    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with the operators' own names."""
    return wide(spark, EDGE_ROWS)


@pytest.fixture(scope="session")
def none(spark):
    return wide(spark, [])


def wide(spark, rows):
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(*r, *CLASHES) for r in rows], schema)
