"""Tags implied by words and phrases, from a rule table of any size."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.session import settle

# Task functions travel with their code, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD_BREAK = "[^a-z0-9]+"
# Texts that ask for their rules together, and words that a task takes at once.
TEXTS = 1000
WORDS = 1 << 18
# The filter of phrases has 2 ** FILTER bits, however many rules there are.
FILTER = 26
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(text), WORD_BREAK), "")


def grams(words: Column, length: int) -> Column:
    """Every stretch of ``length`` words, once, joined by blanks."""
    if length == 1:
        return F.array_distinct(words)
    starts = F.sequence(F.lit(1), F.size(words) - length + 1)
    found = F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, length), " ")))
    return F.when(F.size(words) >= length, found).otherwise(F.array().cast("array<string>"))


def normal_rules(rules: DataFrame) -> DataFrame:
    """``phrase`` (its words joined by blanks), ``n_words`` and ``tag``; rules without a word or a tag are left out."""
    words = words_of(F.col("phrase"))
    return rules.filter(F.col("tag").isNotNull()).select(
        F.array_join(words, " ").alias("phrase"), F.size(words).alias("n_words"), "tag").filter("n_words > 0").distinct()


def _hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    for w in words:
        if w not in known:
            known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
    return np.array([known[w] for w in words], dtype=np.uint64)


def _slots(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Bits of the filter that stretches of ``n`` words stand for."""
    mixed = np.zeros(len(starts), dtype=np.uint64)
    for j in range(n):
        mixed = (mixed ^ hashes[starts + j]) * MIX
        mixed ^= mixed >> np.uint64(29)
    return mixed * MIX >> np.uint64(64 - FILTER)


def _starts(row: np.ndarray, n: int) -> np.ndarray:
    """Where stretches of ``n`` words of one text begin."""
    return np.flatnonzero(row[:len(row) - n + 1] == row[n - 1:]) if len(row) >= n else np.empty(0, np.int64)


def _cuts(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of texts of some ``WORDS`` words, a longer text by itself."""
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > WORDS:
            yield slice(at, i)
            at, total = i, 0
        total += int(size)
    if at < len(sizes):
        yield slice(at, len(sizes))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = []
        known: dict[str, int] = {}
        for phrase in batch.column("phrase").to_pylist():
            words = phrase.split(" ")
            slots.append(_slots(_hashes(words, known), np.zeros(1, np.int64), len(words))[0])
        slots = np.array(slots, dtype=np.uint64)
        bits = np.uint64(1) << (slots & np.uint64(63))
        yield pa.RecordBatch.from_arrays([pa.array((slots >> np.uint64(6)).astype(np.int32)), pa.array(bits.view(np.int64))],
                                         names=["word", "bits"])


def _asked(lengths: list[int], bits: np.ndarray):
    """The stretches of each group of texts that may be phrases of rules, once."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, int] = {}
            for cut in _cuts(np.asarray(batch.column("_words").value_lengths())):
                part = batch.slice(cut.start, cut.stop - cut.start)
                lists, group = part.column("_words"), np.asarray(part.column("_group"))
                coded = lists.flatten().dictionary_encode()
                codes, words = np.asarray(coded.indices).astype(np.int64), coded.dictionary
                hashes = _hashes(words.to_pylist(), known)[codes]
                row = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
                for n in lengths:
                    starts = _starts(row, n)
                    slots = _slots(hashes, starts, n)
                    starts = starts[bits[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1) == 1]
                    if not len(starts):
                        continue
                    _, same = np.unique(group[row[starts]], return_inverse=True)
                    for j in range(n):
                        _, first, same = np.unique(same * len(words) + codes[starts + j], return_index=True, return_inverse=True)
                    starts = starts[first]
                    said = [words.take(pa.array(codes[starts + j])) for j in range(n)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(group[row[starts]]), said[0] if n == 1 else pc.binary_join_element_wise(*said, " ")],
                        names=["_group", "phrase"])
    return ask


def _found(key: str):
    """Of a group of texts and the rules it may need: every text's tags, for texts with any."""
    def find(texts: pa.Table, rules: pa.Table) -> pa.Table:
        tag_lists = _whole(rules["tags"])
        coded_tags = tag_lists.flatten().dictionary_encode()
        tags, tag_codes = coded_tags.dictionary, np.asarray(coded_tags.indices).astype(np.int64)
        tag_sizes = np.asarray(tag_lists.value_lengths()).astype(np.int64)
        tag_at = np.cumsum(tag_sizes) - tag_sizes
        lists = _whole(texts["_words"])
        keys, out = [], []
        by_length: dict[int, list[tuple[int, list[str]]]] = {}
        for i, phrase in enumerate(rules["phrase"].to_pylist()):
            words = phrase.split(" ")
            by_length.setdefault(len(words), []).append((i, words))
        for cut in _cuts(np.asarray(lists.value_lengths())) if len(rules) else ():
            part = lists.slice(cut.start, cut.stop - cut.start)
            coded = part.flatten().dictionary_encode()
            codes, index = np.asarray(coded.indices).astype(np.int64), {w: c for c, w in enumerate(coded.dictionary.to_pylist())}
            row = np.repeat(np.arange(len(part)), np.asarray(part.value_lengths()))
            hit_rows, hit_rules = [], []
            for n, some in by_length.items():
                here = [(i, [index[w] for w in words]) for i, words in some if all(w in index for w in words)]
                if not here:
                    continue
                rule, said = np.array([i for i, _ in here]), np.array([c for _, c in here], dtype=np.int64)
                starts = _starts(row, n)
                # Word by word: the beginnings of phrases, numbered, and where they stand.
                rule_id, text_id = np.zeros(len(rule), np.int64), np.zeros(len(starts), np.int64)
                for j in range(n):
                    begun, first, rule_id = np.unique(rule_id * len(index) + said[:, j], return_index=True, return_inverse=True)
                    pair = text_id * len(index) + codes[starts + j]
                    at = np.minimum(np.searchsorted(begun, pair), len(begun) - 1)
                    ok = begun[at] == pair
                    starts, text_id = starts[ok], at[ok]
                hit_rows.append(row[starts])
                hit_rules.append(rule[first][text_id])
            if not hit_rows:
                continue
            pairs = np.unique(np.concatenate(hit_rows) * len(rules) + np.concatenate(hit_rules))
            rows, rule = pairs // len(rules), pairs % len(rules)
            size = tag_sizes[rule]
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(tag_at[rule], size)
            pairs = np.unique(np.repeat(rows, size) * len(tags) + tag_codes[place])
            rows = pairs // len(tags)
            offsets = np.searchsorted(rows, np.arange(len(part) + 1)).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(offsets), tags.take(pa.array(pairs % len(tags)))))
            keys.append(_whole(texts[key]).slice(cut.start, cut.stop - cut.start))
        if not out:
            return pa.table({key: pa.array([], texts.schema.field(key).type), "tags": pa.array([], pa.list_(pa.string()))})
        table = pa.table({key: pa.chunked_array(keys), "tags": pa.chunked_array(out)})
        return table.filter(pc.greater(pc.list_value_length(table["tags"]), 0))
    return find


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], type=column.type)


def implied_tags(texts: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``tags`` (sorted): the tags of every rule whose phrase stands in the text, for keys with any.

    ``rules``: phrase, tag. Texts come in groups; a group asks once for each of its stretches of as many words as rules
    have, if a filter of fixed size does not rule it out, and the answers meet the group's texts again, where words are
    compared. So neither a text's stretches nor a rule's texts are moved one by one, and the plan does not grow with
    the rules; it grows with the number of phrase lengths, a handful of numbers that the driver reads first.
    """
    known = settle(normal_rules(rules).groupBy("phrase", "n_words").agg(F.collect_set("tag").alias("tags")), "rules")
    lengths = sorted(r.n_words for r in known.select("n_words").distinct().collect())
    if not lengths:
        return texts.select(key, F.array().cast("array<string>").alias("tags")).limit(0)
    marked = known.select("phrase").mapInArrow(_mark, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER - 6), dtype=np.uint64)
    bits[marked["word"].to_numpy()] = marked["bits"].to_numpy().view(np.uint64)
    # Stored, so that a text stays in its group.
    grouped = settle(texts.select(key, words_of(F.col(text)).alias("_words")).filter(F.size("_words") > 0).withColumn(
        "_group", F.floor(F.monotonically_increasing_id() / TEXTS)), "texts")
    asked = grouped.select("_group", "_words").mapInArrow(_asked(lengths, bits), "_group long, phrase string")
    answers = asked.join(known.select("phrase", "tags"), "phrase").select("_group", "phrase", "tags")
    kind = dict(texts.dtypes)[key]
    found = grouped.groupBy("_group").cogroup(answers.groupBy("_group")).applyInArrow(_found(key), f"`{key}` {kind}, tags array<string>")
    return found.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))


def enrich(profiles: DataFrame, rules: DataFrame, key: str = "user_id", text: str = "bio", tags: str = "interest_tags") -> DataFrame:
    """The profiles with ``enriched_tags``: their own tags and the implied ones, sorted, each once."""
    found = implied_tags(profiles, rules, key, text).withColumnRenamed("tags", "_implied")
    none = F.array().cast("array<string>")
    return profiles.join(found, key, "left").withColumn("enriched_tags", F.array_sort(F.array_union(
        F.coalesce(F.col(tags), none), F.coalesce("_implied", none)))).drop("_implied")
