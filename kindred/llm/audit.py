"""How filters of a corpus act on each other, for every order in which they may be applied.

A text fails filter A with under 200 words, B with 100 * distinct words < 50 * words, C with 100 * capital letters >
2 * code points, D with any of ``#$%&*|``, E where any row with a smaller id holds the same text. Which filters a row
fails does not depend on the order, so rows are counted once by (part, set of failed filters, labels); the figures of all
120 orders are sums of these at most 32 counts of a part.

E by a prepass: every text adds two counts to a counting Bloom sketch of its partition (saturated at two, kept as two bit
planes), the sketches are merged segment by segment, and the merged "two or more" plane is sent to all tasks. A text with
a count under two is unique for certain and never leaves its task. The rest, repeats and chance collisions, are grouped
by the full text to find its smallest id. The sketch has 16 counts for each row and 2 ** 28 at most (a plane of 32 MB);
beyond some 10 ** 8 different texts it clears fewer of them, which changes what is shuffled and never the result.

Defined cases: a null text is empty (it fails A, and E like any other text); a null part is the empty string; a row with
a null id never fails E nor makes another fail it; rows that share id and text don't make each other fail E; of several
label rows of an id any 1 counts, null labels and ids count as 0; other columns are left out; without rows there is no
part and no result.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import slices
from kindred.session import settle

FILTERS = "ABCDE"
MIN_WORDS = 200
MARKS = b"#$%&*|"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SEGMENT = 1 << 13
MIN_COUNTERS, MAX_COUNTERS = 1 << 16, 1 << 28
CAPITALS = bytes(range(65, 91))
# UTF-8 bytes that go on a character.
INNER = bytes(range(0x80, 0xC0))


def failures(text: bytes) -> int:
    """Bits 1, 2, 4, 8 for a failed A, B, C, D. ``bytes.split`` parts at exactly space, tab, LF, VT, FF and CR."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return ((len(words) < MIN_WORDS) | (100 * len(set(words)) < 50 * len(words)) << 1
            | (100 * capitals > 2 * len(text.translate(None, INNER))) << 2
            | (len(text.translate(None, MARKS)) < len(text)) << 3)


def counters(rows: int) -> int:
    """Counts of a sketch for so many texts: a power of two."""
    return min(MAX_COUNTERS, max(MIN_COUNTERS, 1 << (16 * rows - 1).bit_length()))


def places(hashes: np.ndarray, size: int) -> np.ndarray:
    """The two counts of each hash, as rows of an array."""
    bits = hashes.view(np.uint64)
    return np.stack([bits & np.uint64(size - 1), bits >> np.uint64(32) & np.uint64(size - 1)]).astype(np.int64)


class Sketch:
    """Counts 0, 1 and "2 or more" as two bit planes."""

    def __init__(self, size: int):
        self.size = size
        self.once, self.twice = np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        place, count = np.unique(places(hashes, self.size), return_counts=True)
        at, bit = place >> 3, (1 << (place & 7)).astype(np.uint8)
        again = (count > 1) | (self.once[at] & bit != 0)
        np.bitwise_or.at(self.twice, at[again], bit[again])
        np.bitwise_or.at(self.once, at, bit)


def repeated(twice: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both counts of each hash are two or more; false only for texts that occur once."""
    place = places(hashes, 8 * len(twice))
    return (twice[place >> 3] >> (place & 7).astype(np.uint8) & 1).all(axis=0)


def merged_sketch(hashes: DataFrame, size: int) -> np.ndarray:
    """The "2 or more" plane over all rows of the one long column; ``size`` / 8 bytes."""
    width = SEGMENT // 8

    def sketch(batches):
        found = Sketch(size)
        for b in batches:
            found.add(b.column(0).to_numpy())
        once, twice = found.once.reshape(-1, width), found.twice.reshape(-1, width)
        used = np.flatnonzero(once.any(axis=1))
        for at in range(0, len(used), 1024):
            part = used[at:at + 1024]
            yield pa.RecordBatch.from_arrays([
                pa.array(part.astype(np.int32)), pa.array([once[i].tobytes() for i in part], pa.binary()),
                pa.array([twice[i].tobytes() for i in part], pa.binary())], names=["segment", "once", "twice"])

    def merge(batches):
        now, once, twice = None, None, None
        done: list[tuple[int, bytes]] = []

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in done], pa.int32()), pa.array([t for _, t in done], pa.binary())],
                names=["segment", "twice"])

        for b in batches:
            for segment, one, two in zip(*(c.to_pylist() for c in b.columns), strict=True):
                one, two = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
                if segment == now:
                    twice |= two | once & one
                    once |= one
                    continue
                if now is not None and twice.any():
                    done.append((now, twice.tobytes()))
                now, once, twice = segment, one.copy(), two.copy()
            if done:
                yield out()
                done.clear()
        if now is not None and twice.any():
            done.append((now, twice.tobytes()))
            yield out()

    parts = hashes.mapInArrow(sketch, "segment int, once binary, twice binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, twice binary")
    plane = np.zeros((size // SEGMENT, width), np.uint8)
    for row in merged.toLocalIterator():
        plane[row.segment] = np.frombuffer(row.twice, np.uint8)
    return plane.reshape(-1)


def flags(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``doc_id``, ``part`` and ``mask`` (bits 1 to 16 for a failed A to E) of every row."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("name", F.xxhash64("text"))
    size = counters(rows.count())
    plane = docs.sparkSession.sparkContext.broadcast(merged_sketch(rows.select("name"), size).tobytes())

    def judge(batches):
        twice = np.frombuffer(plane.value, np.uint8)
        for b in slices(batches, 1024):
            again = repeated(twice, b.column(3).to_numpy())
            words = b.column(2).to_pylist()
            mask = [failures(t.encode()) for t in words]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(mask, pa.int32()), b.column(3),
                 pa.array([t if a else None for t, a in zip(words, again, strict=True)], pa.string())],
                names=["doc_id", "part", "mask", "name", "repeat"])

    judged = settle(rows.mapInArrow(judge, "doc_id long, part string, mask int, name long, repeat string"), "judged")
    held = judged.where("repeat IS NOT NULL AND doc_id IS NOT NULL")
    # The smallest id is found on the full text and told to its row by that id; the hashes only part rows of one id.
    least = held.groupBy("repeat").agg(F.min("doc_id").alias("doc_id")).select(
        "doc_id", F.xxhash64("repeat").alias("name"), F.xxhash64(F.lit(1), "repeat").alias("other"),
        F.lit(True).alias("least"))
    later = held.select("doc_id", "part", "mask", "name", F.xxhash64(F.lit(1), "repeat").alias("other")).join(
        least, ["doc_id", "name", "other"], "left")
    alone = judged.where("repeat IS NULL OR doc_id IS NULL").select("doc_id", "part", "mask")
    return alone.unionByName(later.select("doc_id", "part", F.when(F.col("least"), F.col("mask")).otherwise(
        F.col("mask").bitwiseOR(F.lit(16))).alias("mask")))


def mask_counts(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask``, rows ``n`` and how many of them are of good quality (``good``) and ``toxic``."""
    known = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"),
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    return marked.join(known, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def weights() -> tuple[list[str], list[int], dict[str, np.ndarray]]:
    """Orders and steps, and for each figure its (600, 32) matrix over the sets of failed filters."""
    masks = np.arange(32)
    size = np.array([bin(m).count("1") for m in masks])
    orders, steps, figures = [], [], {c: [] for c in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            fails, gone = masks & bit != 0, masks & before != 0
            orders.append("".join(order))
            steps.append(step)
            figures["kept"].append(masks & (before | bit) == 0)
            figures["removed"].append(fails & ~gone)
            figures["redundant"].append(fails & gone)
            figures["unique_fails"].append(masks == bit)
            # Of the filters that a row fails each comes first in an equal share of the orders.
            figures["shapley"].append(np.where(fails, 120 // np.maximum(size, 1), 0))
            before |= bit
    return orders, steps, {c: np.array(m).astype(np.int64) for c, m in figures.items()}


def interactions(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of the module's description."""
    parts = mask_counts(flags(docs, **columns), labels).groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def expand(batches):
        orders, steps, figures = weights()
        for b in batches:
            for part, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, good, toxic = np.zeros((3, 32), np.int64)
                for row in counts:
                    n[row["mask"]], good[row["mask"]], toxic[row["mask"]] = row["n"], row["good"], row["toxic"]
                found = {c: m @ n for c, m in figures.items()} | {
                    "good_lost": figures["removed"] @ good, "toxic_lost": figures["removed"] @ toxic}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(orders)), pa.array(orders), pa.array(steps, pa.int32()),
                     *(pa.array(found[c]) for c in names)], names=["part", "filter_order", "step", *names])

    return parts.mapInArrow(expand, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names))


def oracle() -> str:
    """The same in SQL: the sets of failed filters by counting, and every order and step over the counts."""
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    return rf"""
    WITH rows AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {words} AS w FROM documents),
    least AS (SELECT text, min(doc_id) AS least FROM rows GROUP BY 1),
    known AS (SELECT doc_id, max(coalesce(quality = 1, FALSE)::INT) AS good, max(coalesce(toxic = 1, FALSE)::INT) AS toxic
              FROM labels GROUP BY 1),
    marked AS (
      SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
        + 4 * (100 * length(regexp_replace(r.text, '[^A-Z]', '', 'g')) > 2 * length(r.text))::INT
        + 8 * regexp_matches(r.text, '[#$%&*|]')::INT + 16 * coalesce(r.doc_id > least, FALSE)::INT AS mask
      FROM rows r JOIN least USING (text) LEFT JOIN known k ON k.doc_id = r.doc_id),
    counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY 1, 2),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
    orders AS (
      SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM f a JOIN f b ON b.x <> a.x JOIN f c ON c.x NOT IN (a.x, b.x) JOIN f d ON d.x NOT IN (a.x, b.x, c.x)
      JOIN f e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
    steps AS (
      SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit,
             coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
      FROM orders, range(1, 6) r(step)),
    grid AS (SELECT part, s.* FROM (SELECT DISTINCT part FROM rows) JOIN steps s ON TRUE)
    SELECT g.part, filter_order, step,
      CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
      CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
      CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
      CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
      CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
      CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
      CAST(sum(CASE WHEN mask & bit <> 0 THEN n * 120 // bit_count(mask) ELSE 0 END) AS BIGINT) AS shapley
    FROM grid g JOIN counts USING (part) GROUP BY 1, 2, 3"""
