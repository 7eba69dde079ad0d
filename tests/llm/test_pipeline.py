from __future__ import annotations

import hashlib

import duckdb
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from kindred.llm import bpe, secrets, toxicity
from kindred.llm.common import share, table
from tests.llm.conftest import EDGE_ROWS, SF
from tests.llm.test_simhash import plain_fingerprint, groups


def test_run_equals_the_stages_done_plainly(spark, docs):
    frame, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.train(frame, labels.where(share(F.col("doc_id"), 4) != 2))
    scores = toxicity.scores(model, [t or "" for _, t in docs])
    kept = [d for d, s in zip(docs, scores, strict=True) if s < toxicity.THRESHOLD]
    marks = {d: plain_fingerprint(t or "") for d, t in kept}
    ids = sorted(marks)
    roots = groups(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (marks[a] ^ marks[b]).bit_count() <= 3])
    kept = [(d, t) for d, t in kept if roots[d] == d]
    items = [r[0] for r in duckdb.connect().execute(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    kept = [(d, t) for d, t in kept if not any(i in (t or "") for i in items)]
    ranks = tiktoken.Encoding("all", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})
    want = []
    for d, t in kept:
        out, end = "", 0
        for a, b, _ in secrets.find_spans(t or ""):
            if a >= end:
                out += (t or "")[end:a] + "[secret removed]"
            end = max(end, b)
        out += (t or "")[end:]
        found = ranks.encode_ordinary(out)
        want.append((d, len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest(),
                     hashlib.sha256(out.encode()).hexdigest()))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted(want) and 100 < len(got) < len(docs)


def test_stages_keep_columns_and_take_any_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    for rows in ([], [(d, t, None, "s", None, "r") for d, t in EDGE_ROWS]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
            assert out.count() <= len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


def test_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in names} and "pipeline" in names
