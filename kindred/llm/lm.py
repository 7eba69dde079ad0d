"""Language-model scores by context-tree weighting over bytes, next to an add-one unigram score over words.

Each byte is eight binary decisions, each with the path of the bits before it. For every decision a tree over the
preceding ``DEPTH`` bytes mixes Krichevsky-Trofimov estimates of all depths: a node's weight is half that of its own
estimate and half the product of its children's. The counts come from all training rows; the weights are then
frozen, so the probability of a byte depends only on the ``DEPTH`` bytes before it and scoring adds up looked-up values.

Spark's part: texts are packed into blocks of some megabytes, frozen in the shared folder. Every block counts its
words and grams (a byte with its context); sums over blocks give the training counts; distinct grams are grouped by
their last two context bytes, a bounded alphabet, to weight the lower levels of the tree, and only the two upper ones,
at most 256 x 255 nodes, pass the driver. Word counts go back to the blocks that asked for them, and so do the
log-probabilities of grams, unless the whole tree is below ``BROADCAST_GRAMS``.

Defined cases: null texts count as empty; an empty text has the end token only; a null ``doc_id`` belongs to the share
its empty string hashes to; repeated rows are kept and count each time; other columns are ignored; without training
rows every byte decision has probability 1/2 and the base score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm.blocks import pack, unpack
from kindred.llm.common import texts
from kindred.session import settle

DEPTH = 4
BLOCK = 12 << 20
# A tree of up to so many grams (16 bytes each) travels to every task; a larger one only where it is asked for.
BROADCAST_GRAMS = 2_000_000
# Grams that are counted together.
PIECE = 1 << 20
# Stands before and after every text; it never occurs in UTF-8.
EDGE = b"\xff"
LOG_PI = float(np.log(np.pi))


def padded(text: str) -> bytes:
    return EDGE * DEPTH + text.encode("utf-8", "replace").lower() + EDGE


def codes(data: bytes, depth: int = DEPTH) -> np.ndarray:
    """Context and byte of every position after the first ``depth``, as one number."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    out = b[:len(b) - depth]
    for k in range(1, depth + 1):
        out = out << 8 | b[k:len(b) - depth + k]
    return out


def log_gamma_half(top: int) -> tuple[np.ndarray, np.ndarray]:
    """log Gamma(n + 1/2) and log Gamma(n + 1) for n up to ``top``, by their recurrences."""
    n = np.arange(top)
    return (np.concatenate([[0.5 * LOG_PI], 0.5 * LOG_PI + np.cumsum(np.log(n + 0.5))]),
            np.concatenate([[0.0], np.cumsum(np.log(n + 1.0))]))


def _stirling(x: np.ndarray) -> np.ndarray:
    """log Gamma(x) for x of 8 or more."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x ** 3) + 1 / (1260 * x ** 5)


_HALF, _WHOLE = log_gamma_half(16)


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    def half(n):
        return np.where(n < 16, _HALF[np.minimum(n, 15).astype(int)], _stirling(np.maximum(n, 8) + 0.5))

    total = zeros + ones
    whole = np.where(total < 16, _WHOLE[np.minimum(total, 15).astype(int)], _stirling(np.maximum(total, 8) + 1.0))
    return half(zeros) + half(ones) - whole - LOG_PI


def mix(zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of nodes whose children's logs sum to ``children``, and the share of their own
    estimate in the mixture."""
    own = estimate(zeros, ones)
    both = np.logaddexp(own, children)
    return both - np.log(2), np.exp(own - both)


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Probability of a one after these counts."""
    return (ones + 0.5) / (zeros + ones + 1)


@dataclass
class Level:
    """The decision nodes of one depth: where each decision finds its own, its estimate of a one, and its share."""
    place: np.ndarray
    one: np.ndarray
    share: np.ndarray


def decisions(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node (the path with a leading one) and bit of the eight decisions of each gram's byte, (8, n)."""
    byte, depth = grams & 255, np.arange(8)[:, None]
    return (1 << depth) | (byte >> (8 - depth)), (byte >> (7 - depth)) & 1


def lower_levels(grams: np.ndarray, counts: np.ndarray, depth: int) -> tuple[list[Level], np.ndarray]:
    """Levels ``depth`` to 2 under one pair of last context bytes, and that pair's nodes as an array
    (4, 256): zeros, ones, log weighted probability, share."""
    nodes, bits = decisions(grams)
    weights = np.broadcast_to(counts, nodes.shape).ravel()
    bits = bits.ravel()
    levels: list[Level] = []
    below = None
    for d in range(depth, 1, -1):
        keys = ((grams >> 8) & ((1 << 8 * d) - 1)) << 8 | nodes
        own, place = np.unique(keys.ravel(), return_inverse=True)
        zeros = np.bincount(place, weights * (bits == 0), len(own))
        ones = np.bincount(place, weights * (bits == 1), len(own))
        if below is None:
            weighted, share = estimate(zeros, ones), np.ones(len(own))
        else:
            keys, values = below
            up = ((keys >> 8) & ((1 << 8 * d) - 1)) << 8 | (keys & 255)
            weighted, share = mix(zeros, ones, np.bincount(np.searchsorted(own, up), values, len(own)))
        below = own, weighted
        levels.append(Level(place.ravel(), kt(zeros, ones), share))
    top = np.zeros((4, 256))
    top[:, own & 255] = zeros, ones, weighted, share
    return levels, top


def tree_values(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``gram`` and ``value``: log10 probability of each gram's last byte after its context, from the training
    counts ``n`` of all grams (rows with n = 0 are asked for but teach nothing)."""
    grouped = counts.withColumn("pair", F.shiftright(F.col("gram"), 8).bitwiseAND(F.lit(0xFFFF)).cast("int"))

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        zeros, ones, weighted, _ = lower_levels(group["gram"].to_numpy(), group["n"].to_numpy(float), depth)[1][:, 1:]
        return pd.DataFrame({"last": int(group["pair"].iloc[0]) & 255, "node": np.arange(1, 256), "zeros": zeros,
                             "ones": ones, "below": weighted})

    # At most 256 x 255 rows.
    upper = grouped.groupBy("pair").applyInPandas(
        pairs, "last int, node int, zeros double, ones double, below double").groupBy("last", "node").agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toPandas()
    tables = {}
    for name in ("zeros", "ones", "below"):
        tables[name] = np.zeros((256, 256))
        tables[name][upper["last"], upper["node"]] = upper[name]
    above, share1 = mix(tables["zeros"], tables["ones"], tables["below"])
    kt1 = kt(tables["zeros"], tables["ones"])
    zeros0, ones0 = tables["zeros"].sum(axis=0), tables["ones"].sum(axis=0)
    _, share0 = mix(zeros0, ones0, above.sum(axis=0))
    kt0 = kt(zeros0, ones0)
    packed = counts.sparkSession.sparkContext.broadcast((kt0, share0, kt1, share1))

    def values(group: pd.DataFrame) -> pd.DataFrame:
        kt_root, share_root, kt_last, share_last = packed.value
        grams, last = group["gram"].to_numpy(), int(group["pair"].iloc[0]) & 255
        nodes, bits = (x.ravel() for x in decisions(grams))
        p = np.zeros(len(nodes))
        for level in lower_levels(grams, group["n"].to_numpy(float), depth)[0]:
            share = level.share[level.place]
            p = share * level.one[level.place] + (1 - share) * p
        p = share_last[last, nodes] * kt_last[last, nodes] + (1 - share_last[last, nodes]) * p
        p = share_root[nodes] * kt_root[nodes] + (1 - share_root[nodes]) * p
        logs = np.log10(np.where(bits == 1, p, 1 - p)).reshape(8, -1).sum(axis=0)
        return pd.DataFrame({"gram": grams, "value": logs})

    return grouped.groupBy("pair").applyInPandas(values, "gram long, value double")


def count_block(data: bytes) -> tuple[Counter, np.ndarray, np.ndarray]:
    """Training counts of all words of a block (the empty word is the end token) and of all its grams."""
    words: Counter = Counter()
    other: set[bytes] = set()
    held: dict[bool, list[np.ndarray]] = {True: [], False: []}
    sums = {t: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for t in held}

    def gather(trained: bool):
        found, counts = np.unique(np.concatenate(held[trained]), return_counts=True)
        both, place = np.unique(np.concatenate([sums[trained][0], found]), return_inverse=True)
        sums[trained] = both, np.bincount(place, np.concatenate([sums[trained][1], counts])).astype(np.int64)
        held[trained].clear()

    for _, trained, text in unpack(data):
        low = padded(text)
        found = low[DEPTH:-1].split()
        if trained:
            words.update(found)
            words[b""] += 1
        else:
            other.update(found)
        held[trained].append(codes(low))
        if sum(map(len, held[trained][-32:])) > PIECE or len(held[trained]) > 512:
            gather(trained)
    for trained in (True, False):
        if held[trained]:
            gather(trained)
    (grams, counts), (asked, _) = sums[True], sums[False]
    asked = np.setdiff1d(asked, grams)
    for word in other:
        words.setdefault(word, 0)
    words.setdefault(b"", 0)
    return words, np.concatenate([grams, asked]), np.concatenate([counts, np.zeros(len(asked), np.int64)])


class Lookup:
    """Values by gram: most grams have a slot of their own, those whose slot is taken one in a smaller table after it."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        self.levels = []
        factor = 0x9E3779B97F4A7C15
        while len(grams):
            bits = max(4, int(len(grams)).bit_length() + 1)
            level = np.uint64(factor), np.uint64(64 - bits), np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
            slots = self.slots(level, grams)
            level[2][slots], level[3][slots] = grams, values
            self.levels.append(level)
            rest = level[2][slots] != grams
            grams, values = grams[rest], values[rest]
            factor = (factor * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1

    @staticmethod
    def slots(level: tuple, grams: np.ndarray) -> np.ndarray:
        return (grams.astype(np.uint64) * level[0]) >> level[1]

    def of(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams))
        place = None
        for level in self.levels:
            slots = self.slots(level, grams)
            hit = level[2][slots] == grams
            if place is None:
                out[hit] = level[3][slots[hit]]
                place = np.flatnonzero(~hit)
            else:
                out[place[hit]] = level[3][slots[hit]]
                place = place[~hit]
            grams = grams[~hit]
            if not len(grams):
                break
        return out


class Known(dict):
    """log10(c + 1) by word; 0 for words that are not there."""

    def __missing__(self, word: bytes) -> float:
        return 0.0


def score_block(data: bytes, words: dict[bytes, float], lookup: Lookup):
    """(doc_id, tokens, known tokens, coded bytes, sum of log10(c + 1), log10 probability) of every row of a block."""
    held: list[tuple] = []
    waiting: list[np.ndarray] = []
    size = 0

    def flush():
        begin = np.cumsum([0, *(len(c) for c in waiting[:-1])])
        totals = np.add.reduceat(lookup.of(np.concatenate(waiting)), begin)
        for row, total in zip(held, totals.tolist(), strict=True):
            yield *row, total

    for doc_id, _, text in unpack(data):
        low = padded(text)
        found = low[DEPTH:-1].split()
        logs = np.fromiter(map(words.__getitem__, [b"", *found]), np.float64, len(found) + 1)
        waiting.append(codes(low))
        held.append((doc_id, len(logs), int((logs > 0).sum()), len(waiting[-1]), float(logs.sum())))
        size += len(low)
        if size > PIECE // 4:
            yield from flush()
            held, waiting, size = [], [], 0
    if held:
        yield from flush()


def score(docs: DataFrame, trained: Column, block: int = BLOCK,
          broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (log10 probability of the
    text and its end) and ``bits_per_byte`` (its code length) for every row, from a model of the rows
    where ``trained`` (a condition on ``doc_id``) holds."""
    blocks = pack(texts(docs).select("doc_id", F.coalesce(trained, F.lit(False)).alias("trained"), "text"), block)

    def count(batches):
        for b in batches:
            for key, data in zip(b[0].to_pylist(), b[1], strict=True):
                words, grams, n = count_block(data.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(words), key)), pa.array(list(words), pa.binary()),
                     pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())],
                    names=["block", "word", "gram", "n"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(grams), key)), pa.nulls(len(grams), pa.binary()),
                     pa.array(grams), pa.array(n)], names=["block", "word", "gram", "n"])

    counted = settle(blocks.mapInArrow(count, "block long, word binary, gram long, n long"), "counts")
    words = counted.where(F.col("word").isNotNull()).select("block", "word", "n")
    grams = counted.where(F.col("gram").isNotNull()).select("block", "gram", "n")
    # A word has at most one row for each block, so its window stays small.
    own = Window.partitionBy("word")
    back = words.select(
        "block", "word", F.sum("n").over(own).alias("c"),
        (F.min(F.when(F.col("n") > 0, F.col("block"))).over(own) == F.col("block")).alias("first"))
    # A block takes a word that does not come back for one that no training row has.
    back = back.where((F.col("c") > 0) | (F.col("word") == F.lit(b"")))
    tree = settle(tree_values(grams.groupBy("gram").agg(F.sum("n").alias("n"))), "tree")
    model = None
    if tree.count() <= broadcast_grams:
        # At most ``broadcast_grams`` rows of 16 bytes.
        held = tree.toArrow()
        model = docs.sparkSession.sparkContext.broadcast((held["gram"].to_numpy(), held["value"].to_numpy()))
    none = F.lit(None)
    back = back.withColumns({"gram": none.cast("long"), "value": none.cast("double")})
    if model is None:
        # A larger tree goes to the blocks as the word counts do: to each the grams it has.
        back = back.unionByName(grams.select("block", "gram").join(tree, "gram").select(
            "block", none.cast("binary").alias("word"), none.cast("long").alias("c"), F.lit(False).alias("first"),
            "gram", "value"))

    # Of a task: its first block builds the table for all of them.
    tables: list[Lookup] = []

    def meet(data: pa.Table, found: pa.Table) -> pa.Table:
        names = ["doc_id", "n_tokens", "n_known", "n_bytes", "logs", "score", "distinct"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        of_words = found.filter(found["word"].is_valid())
        logs = np.log10(of_words["c"].to_numpy() + 1.0).tolist()
        known = Known(zip(of_words["word"].to_pylist(), logs, strict=True))
        first = pa.compute.sum(of_words["first"]).as_py() or 0
        if model is None:
            of_grams = found.filter(found["gram"].is_valid())
            lookup = Lookup(of_grams["gram"].to_numpy(), of_grams["value"].to_numpy())
        else:
            if not tables:
                tables.append(Lookup(*model.value))
            lookup = tables[0]
        rows = []
        for blob in data["data"]:
            rows += score_block(blob.as_py(), known, lookup)
        # The last row carries the number of words that this block counts for the vocabulary.
        columns = zip(*(r + (None,) for r in rows), (None, 0, 0, 0, 0.0, 0.0, first), strict=True)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    scored = settle(
        blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
            meet, "doc_id long, n_tokens long, n_known long, n_bytes long, logs double, score double, "
                  "distinct long"), "scores")
    vocabulary = scored.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    tokens = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return scored.where(F.col("distinct").isNull()).select(
        "doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(tokens + vocabulary + 1)))).alias("base_score"),
        "score", (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
