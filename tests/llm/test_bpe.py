from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import tiktoken

from kindred.llm import bpe, queries
from tests.llm.conftest import EDGE_ROWS, SF


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("all", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(),
                             special_tokens={}).encode_ordinary


def test_query_equals_library(spark, docs, reference):
    got = {r.doc_id: r for r in queries.op3_byte_bpe(spark, SF).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = reference(text or "")
        row = got[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_edges_and_empty(spark, edge, none, reference):
    got = sorted(((r.doc_id, list(r.ids), bytes(r.bytes)) for r in bpe.decode(bpe.encode(edge)).collect()), key=repr)
    assert got == sorted(((d, reference(t or ""), (t or "").encode()) for d, t in EDGE_ROWS), key=repr)
    assert bpe.decode(bpe.encode(none)).count() == 0


@pytest.mark.parametrize("chunk, overlap", [(64, 4), (257, 32)])
def test_chunks_meet(spark, docs, reference, chunk, overlap):
    extra = [(-1, "don't  we're\n\n  I'll " * 300), (-2, "z" * 5000), (-3, "  " * 2000 + "end"), (-4, "12 34,56 " * 400)]
    rows = [*docs[:60], *extra]
    got = {r.doc_id: r.ids for r in bpe.encode(
        spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk, overlap=overlap).collect()}
    assert got == {d: reference(t or "") for d, t in rows}


def test_chunks_without_a_common_boundary_become_one(spark):
    # Marks run on over line ends here, so that a cut inside a run has no boundary in common with the next chunk.
    pattern = r" ?[^\s\p{L}]+[\r\n]*|\p{L}+|\s+"
    rows = [(1, "#" * 700 + "\n" * 10), (2, "#" * 150 + "\n" * 10 + "then words " * 40 + "=" * 300 + "\n\n\n\n"), (3, "a b " * 100),
            (4, ("." * 100 + "\n" * 6) * 8 + "end")]
    plain = bpe.Encoder(None, pattern)
    got = {r.doc_id: r.ids for r in bpe.encode(
        spark.createDataFrame(rows, "doc_id long, text string"), pattern=pattern, chunk=64, overlap=4).collect()}
    assert got == {d: plain.ids(t) for d, t in rows}


def test_chunks_cover_the_text_and_overlap():
    text = "word and more " * 500
    parts = list(bpe.cut(text, 100, 20))
    assert parts[0][0] == 0 and parts[-1][1] == len(text) and parts[-1][2] == -1
    assert all(b[0] == a[2] and b[0] + 20 <= a[1] for a, b in zip(parts, parts[1:], strict=False))
    assert list(bpe.cut("q" * 1000, 100, 20)) == [(0, 1000, -1)]
