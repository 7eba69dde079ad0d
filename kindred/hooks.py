"""Places where a caller plugs in a model: batch functions run by Spark over Arrow batches.

Each hook has a default made of JVM expressions (or, for vectors, one numpy scatter per batch), so
every job runs without a model.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import default_introduction, enrich_tags, mask_pii
from kindred.schemas import INTRO_MAX_CHARS, VECTOR_DIM

# Task functions travel with their code, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH = 1024
# Slots of tokens that a task remembers.
KNOWN_TOKENS = 1 << 20
TOKEN_BREAK = r"[\s\p{Punct}]+"
SCORE_COLUMNS = ("hate", "harassment", "violence", "sexual")


def _ddl(df: DataFrame, *extra: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + list(extra))


def _replacing(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    names = batch.schema.names + [c for c in columns if c not in batch.schema.names]
    return pa.RecordBatch.from_arrays(
        [columns[n] if n in columns else batch.column(n) for n in names], names=names)


def embed(
    df: DataFrame,
    text: str = "embedding_text",
    batch_fn: Callable[[list[str]], np.ndarray] | None = None,
    dim: int = VECTOR_DIM,
) -> DataFrame:
    """Add ``vector``: ``batch_fn(texts) -> (n, dim)`` array, or hashed tokens scaled to length 1."""
    if batch_fn is None:
        return _hashed_vectors(df, text, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                vectors = np.asarray(batch_fn(part.column(text).to_pylist()), dtype=np.float32)
                yield _replacing(part, vector=_list_array(vectors))

    return df.mapInArrow(run, _ddl(df, "vector array<float>"))


def token_slot(token: str, dim: int) -> int:
    """A token's slot: the first 28 bits of its md5, modulo ``dim``."""
    return int(hashlib.md5(token.encode(), usedforsecurity=False).hexdigest()[:7], 16) % dim


def _list_array(rows: np.ndarray) -> pa.Array:
    n, dim = rows.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).reshape(-1), type=pa.float32()))


def _hashed_vectors(df: DataFrame, text: str, dim: int) -> DataFrame:
    """Tokens are cut in the JVM; a task hashes each distinct token once, counts buckets and scales. The text itself
    stays with the JVM unless the caller's frame has it."""
    tokens = F.array_remove(F.split(F.lower(F.col(text)), TOKEN_BREAK), "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                lists = part.column("_tokens")
                sizes = np.asarray(lists.value_lengths().fill_null(0))
                coded = lists.flatten().dictionary_encode()
                if len(known) > KNOWN_TOKENS:
                    known.clear()
                slots = np.array([known[t] if t in known else known.setdefault(t, token_slot(t, dim))
                                  for t in coded.dictionary.to_pylist()], np.int64)
                row = np.repeat(np.arange(part.num_rows), sizes)
                counts = np.bincount(row * dim + slots[np.asarray(coded.indices)], minlength=part.num_rows * dim)
                rows = counts.reshape(part.num_rows, dim).astype(np.float64)
                length = np.sqrt(np.einsum("ij,ij->i", rows, rows))
                length[length == 0] = 1.0
                out = _replacing(part, vector=_list_array((rows / length[:, None]).astype(np.float32)))
                yield out.select([n for n in out.schema.names if n != "_tokens"])

    return df.withColumn("_tokens", tokens).mapInArrow(run, _ddl(df, "vector array<float>"))


def clean_profiles(
    df: DataFrame, batch_fn: Callable[[list[str], list[list[str]]], list[tuple[str, list[str], bool]]] | None = None,
) -> DataFrame:
    """Add sanitized_bio, enriched_tags, pii_removed from ``bio`` and ``interest_tags``, and ``model_failed``.

    A row on which ``batch_fn`` fails takes the default results; rows around it are not affected.
    """
    masked = mask_pii(F.col("bio"))
    tags = enrich_tags(F.col("bio"), F.col("interest_tags"))
    if batch_fn is None:
        return (df.withColumn("sanitized_bio", masked).withColumn("enriched_tags", tags)
                .withColumn("pii_removed", F.col("sanitized_bio") != F.col("bio"))
                .withColumn("model_failed", F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = by_row(batch_fn, lambda r: (str(r[0]), [str(t) for t in r[1]], bool(r[2])),
                             batch.column("bio").to_pylist(), batch.column("interest_tags").to_pylist())
            yield _replacing(
                batch,
                _bio=pa.array([r[0] if r else None for r in results], type=pa.string()),
                _tags=pa.array([r[1] if r else None for r in results], type=pa.list_(pa.string())),
                _found=pa.array([r[2] if r else None for r in results], type=pa.bool_()))

    hooked = df.mapInArrow(run, _ddl(df, "_bio string", "_tags array<string>", "_found boolean"))
    return (hooked.withColumn("sanitized_bio", F.coalesce("_bio", masked))
            .withColumn("enriched_tags", F.coalesce("_tags", tags))
            .withColumn("pii_removed", F.coalesce("_found", masked != F.col("bio")))
            .withColumn("model_failed", F.col("_bio").isNull())
            .drop("_bio", "_tags", "_found"))


def introduce(
    df: DataFrame, batch_fn: Callable[[list[dict]], list[tuple[str, str | None, float]]] | None = None,
) -> DataFrame:
    """Add intro_text, mentioned_member, toxicity_score, whether the text fits its limit, and ``model_failed``.

    ``df`` holds only the rows that need a text and a ``community_name`` column; ``batch_fn`` gets
    the rows as dicts. The default text, also of rows on which it fails, mentions nobody and scores 0.
    """
    default = default_introduction(F.col("community_name"))
    if batch_fn is None:
        out = (df.withColumn("intro_text", default)
               .withColumn("mentioned_member", F.lit(None).cast("string"))
               .withColumn("toxicity_score", F.lit(0.0)).withColumn("model_failed", F.lit(False)))
    else:
        def row(r) -> tuple[str, str | None, float]:
            return str(r[0]), None if r[1] is None else str(r[1]), float(r[2])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                results = by_row(batch_fn, row, batch.to_pylist())
                yield _replacing(
                    batch,
                    intro_text=pa.array([r[0] if r else None for r in results], type=pa.string()),
                    mentioned_member=pa.array([r[1] if r else None for r in results], type=pa.string()),
                    toxicity_score=pa.array([r[2] if r else None for r in results], type=pa.float64()))

        hooked = df.mapInArrow(run, _ddl(
            df, "intro_text string", "mentioned_member string", "toxicity_score double"))
        out = (hooked.withColumn("model_failed", F.col("intro_text").isNull())
               .withColumn("intro_text", F.coalesce("intro_text", default))
               .withColumn("toxicity_score", F.coalesce("toxicity_score", F.lit(0.0))))
    return out.withColumn("fits", F.length("intro_text") <= INTRO_MAX_CHARS)


def score_toxicity(
    df: DataFrame,
    text: str = "text",
    batch_fn: Callable[[list[str]], np.ndarray] | None = None,
    labels: DataFrame | None = None,
    key: str = "doc_id",
) -> DataFrame:
    """Add ``toxicity_score``: the highest of the model's four scores, or the label table's score.

    A text on which the model fails and an unlabelled row score 0; ``model_failed`` tells the former,
    so that a caller may hold such texts back.
    """
    if batch_fn is None:
        return (df.join(labels.select(key, F.col("score").alias("_s")), key, "left")
                .withColumn("toxicity_score", F.coalesce("_s", F.lit(0.0))).drop("_s")
                .withColumn("model_failed", F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = by_row(batch_fn, lambda r: [float(r[i]) for i in range(len(SCORE_COLUMNS))],
                          batch.column(text).to_pylist())
            scores = {c: pa.array([None if r is None else r[i] for r in rows], type=pa.float64())
                      for i, c in enumerate(SCORE_COLUMNS)}
            yield _replacing(batch, **scores)

    hooked = df.mapInArrow(run, _ddl(df, *[f"{c} double" for c in SCORE_COLUMNS]))
    return (hooked.withColumn("model_failed", max_score().isNull())
            .withColumn("toxicity_score", F.coalesce(max_score(), F.lit(0.0)))
            .drop(*SCORE_COLUMNS))


def max_score(columns: tuple[str, ...] = SCORE_COLUMNS) -> Column:
    return F.greatest(*columns)


def by_row(fn: Callable, shape: Callable[[Any], Any], *columns: list) -> list:
    """The hook's results in their declared shape; None for each row on which it fails.

    Where a batch fails, or returns the wrong number of results, its halves are asked again, down to
    single rows: the outcome of a row does not depend on the rows it shares a batch with.
    """
    count = len(columns[0])
    if not count:
        return []
    try:
        results = [shape(r) for r in fn(*columns)]
        if len(results) == count:
            return results
    except Exception:  # noqa: BLE001  whatever a model raises
        pass
    if count == 1:
        return [None]
    half = count // 2
    return by_row(fn, shape, *(c[:half] for c in columns)) + by_row(fn, shape, *(c[half:] for c in columns))
