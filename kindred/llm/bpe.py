"""Byte-level BPE encoding and decoding with a given public vocabulary.

A long text is cut into overlapping chunks which become rows of their own, so that one document is encoded by
many tasks. Each chunk is pre-tokenised from its first character, which may lie inside a pre-token. The matches
depend only on the text to their right, so as soon as two neighbouring chunks have a boundary in common, all
later ones agree: there they are stitched. Decoding concatenates the raw bytes of the ids.

Defined cases: a null or empty text has no ids and decodes to no bytes; a null ``doc_id`` and repeated rows are
kept, one result row for each input row; columns other than ``doc_id`` and ``text`` are ignored; an empty table
gives an empty result. A text without any white space after its first chunk is one chunk, however long.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import slices, texts

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CHUNK = 1 << 16
OVERLAP = 1 << 10
# Matches that start this close to a chunk's cut end may differ in the whole text ("'re" is decided by 3 characters).
EDGE = 3
BATCH_IDS = 1 << 20
CACHE = 1 << 17


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    """The vocabulary: token bytes to rank, from a file in the tiktoken format."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


class Encoder:
    """Encodes pre-tokens one by one; equal pre-tokens are merged once while they stay in the cache."""

    def __init__(self, vocabulary: str | None, pattern: str | None):
        self.split = regex.compile(pattern or default_pattern())
        # The pattern takes any string as one piece: the pre-tokens are found here, not there.
        self.merge = tiktoken.Encoding(
            "pieces", pat_str=r"(?s:.+)", mergeable_ranks=load_ranks(vocabulary), special_tokens={}).encode_ordinary
        self.cache: dict[str, list[int]] = {}

    def piece(self, piece: str) -> list[int]:
        if len(self.cache) >= CACHE:
            self.cache.clear()
        ids = self.cache[piece] = self.merge(piece)
        return ids

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        known, miss = self.cache.get, self.piece
        for piece in self.split.findall(text):
            out += known(piece) or miss(piece)
        return out

    def marked(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids, the end of every pre-token, and how many ids there are up to it."""
        out: list[int] = []
        ends, counts = [], []
        for match in self.split.finditer(text):
            out += self.cache.get(match[0]) or self.piece(match[0])
            ends.append(match.end())
            counts.append(len(out))
        return out, ends, counts


def cut(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, start of the next chunk or -1). Every overlap holds a place where white space begins after
    another character; no pre-token runs across it, so neighbouring chunks always have a boundary in common."""
    begins = regex.compile(r"(?<=\S)\s")
    start, size = 0, len(text)
    while True:
        following = start + chunk
        met = begins.search(text, following + 1) if following + 1 < size else None
        end = max(following + overlap, met.start() + EDGE + 1) if met else size
        if end >= size:
            yield start, size, -1
            return
        yield start, end, following
        start = following


def _id_batches(rows: Iterator[tuple[tuple, list[int]]], names: list[str], types: list) -> Iterator[pa.RecordBatch]:
    """Record batches of (key columns…, ids), each of a bounded number of ids."""
    keys, flat, ends = [], [], [0]

    def batch():
        columns = [pa.array([k[i] for k in keys], types[i]) for i in range(len(types))]
        ids = pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))
        return pa.RecordBatch.from_arrays([*columns, ids], names=[*names, "ids"])

    for key, ids in rows:
        keys.append(key)
        flat.append(np.array(ids, np.int32))
        ends.append(ends[-1] + len(ids))
        if ends[-1] >= BATCH_IDS:
            yield batch()
            keys, flat, ends = [], [], [0]
    if keys:
        yield batch()


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, chunk: int = CHUNK,
           overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: ``doc_id``, ``ids`` (array of int)."""
    rows = texts(docs)

    def whole(batches):
        # Owned by the task, so that its tables go when the task ends.
        enc = Encoder(vocabulary, pattern)
        yield from _id_batches(
            (((k,), enc.ids(t)) for b in slices(batches) for k, t in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True)),
            ["doc_id"], [pa.int64()])

    def cut_rows(batches):
        for b in slices(batches, 8):
            for row, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for start, end, following in cut(text, chunk, overlap):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], t) for x, t in ((row, pa.int64()), (doc_id, pa.int64()), (start, pa.int64()),
                                                       (following, pa.int64()), (text[start:end], pa.string()))],
                        names=["row", "doc_id", "start", "following", "text"])

    def encode_chunks(batches):
        # Owned by the task, so that its tables go when the task ends.
        enc = Encoder(vocabulary, pattern)
        for b in slices(batches, 8):
            for row, doc_id, start, following, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                head, tail, ids = marks(enc, start, following, text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row]), pa.array([doc_id], pa.int64()), pa.array([start]), pa.array([following]), pa.array([text]),
                     *(pa.array([x], pa.list_(pa.int64())) for x in (*head, *tail)),
                     pa.array([ids], pa.list_(pa.int32()))],
                    names=["row", "doc_id", "start", "following", "text", "head", "head_ids", "tail", "tail_ids", "ids"])

    def marks(enc, start, following, text):
        """Boundaries (place, ids before it) where the chunk may follow the one before or give way to the next; its ids."""
        ids, ends, counts = enc.marked(text)
        ends, counts = np.array([0, *ends], np.int64) + start, np.array([0, *counts], np.int64)
        head = ends <= start + 2 * overlap + 2 * EDGE if start else np.zeros(len(ends), bool)
        tail = (ends >= following) & (ends <= start + len(text) - EDGE) if following >= 0 else np.zeros(len(ends), bool)
        if start and following < 0 or start and not (head & (ends > start)).any():
            head[:] = True
        return (ends[head], counts[head]), (ends[tail], counts[tail]), np.array(ids, np.int32)

    def stitch(group):
        chunks = [(c.start, c.following, c.text, (c.head, c.head_ids), (c.tail, c.tail_ids), c.ids)
                  for c in group.sort_values("start").itertuples()]
        parts, skip, begun = [], 0, 0
        start, _, text, _, tail, ids = chunks[0]
        for after in chunks[1:]:
            _, here, there = np.intersect1d(tail[0], after[3][0], return_indices=True)
            if len(here):
                parts.append(ids[skip:tail[1][here[0]]])
                begun, skip = int(tail[0][here[0]]), after[3][1][there[0]]
                start, _, text, _, tail, ids = after
            else:
                # Nowhere do the two meet: they are encoded as one, from the last boundary that is known.
                text = text[begun - start:max(0, after[0] - start)] + after[2][max(0, begun - after[0]):]
                start, skip = begun, 0
                _, tail, ids = marks(Encoder(vocabulary, pattern), start, after[1], text)
        parts.append(ids[skip:])
        return group.iloc[:1][["doc_id"]].assign(ids=[np.concatenate(parts)])

    short = rows.where(F.char_length("text") <= chunk).mapInArrow(whole, "doc_id long, ids array<int>")
    long = (
        rows.where(F.char_length("text") > chunk)
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        .mapInArrow(cut_rows, "row long, doc_id long, start long, following long, text string")
        .repartition("row", "start")
        .mapInArrow(encode_chunks, "row long, doc_id long, start long, following long, text string, "
                                   "head array<long>, head_ids array<long>, tail array<long>, tail_ids array<long>, ids array<int>")
        .groupBy("row").applyInPandas(stitch, "doc_id long, ids array<int>"))
    return short.unionByName(long)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` and ``bytes``: the tokens' bytes one after another (null ids: no bytes)."""
    def to_bytes(batches):
        tokens = {rank: token for token, rank in load_ranks(vocabulary).items()}
        table = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        for b in slices(batches, 64):
            data = [b"".join(map(table.__getitem__, ids or ())) for ids in b[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[0], b[1], pa.array(data, pa.binary())], names=["doc_id", "ids", "bytes"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(
        to_bytes, "doc_id long, ids array<int>, bytes binary")


def digests(decoded: DataFrame) -> DataFrame:
    """The query's columns from the operator's output."""
    return decoded.select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))
