"""SimHash near-duplicates through a segment-popcount embedding.

A text's fingerprint has the majority bits of its hashed word shingles. The 64 bits are cut into 32 segments; the
number of set bits of each maps a fingerprint to a point of a small grid. The Manhattan distance of two points never
exceeds the fingerprints' bit distance, so pairs further apart than the limit on the grid need no look at the bits.

The range join: the segments form six axes. Two points within distance 3 agree on at least three whole axes, so each
point is put into the 20 cells of three axes; points that share a cell are compared on the grid first (counts are
written as thermometer codes, whose differing bits add up to the Manhattan distance), then on the fingerprints.
Equal fingerprints were merged before. A cell with very many points is cut into blocks, and every pair of blocks is a
task of its own; a task returns links that span its components, never all pairs of a group. Components come from
star contractions over links, each round written to the shared folder.

Defined cases: null texts count as empty; texts without words have fingerprint zero and are linked like any other;
a null ``doc_id`` is kept (its component is named by the smallest id that is not null, or null); repeated rows are
kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import keys_of, row_key, signed, slices, texts, with_row_key
from kindred.llm.components import components
from kindred.session import settle

SHINGLE = 3
SEED = 42
PIECE = 1 << 14
DISTANCE = 3
AXES = 6
# Points of a cell that one task compares at once.
BLOCK = 2048
EVEN = 0x5555555555555555


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles; no words: 0."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    total = max(1, len(words) - size + 1)
    stops = ends[size - 1:] if len(words) >= size else ends[-1:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, total, PIECE):
        hashed = b"".join([
            digest(joined[a:b], SEED) for a, b in zip(starts[at:min(total, at + PIECE)], stops[at:], strict=False)])
        ones += np.unpackbits(np.frombuffer(hashed, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``row`` (key of id and text), ``doc_id`` and ``bits`` (the fingerprint as a signed long) of every row."""
    def score(batches):
        for b in slices(batches):
            # Signed, as Spark's long.
            bits = np.array([fingerprint(t.as_py(), size) for t in b[2]], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b[0], b[1], pa.array(bits)], names=["row", "doc_id", "bits"])

    return texts(docs).select(row_key(), "doc_id", "text").mapInArrow(score, "row long, doc_id long, bits long")


def grid_point(bits: Column) -> Column:
    """Set bits of each two-bit segment as a thermometer code: 00, 01 or 11."""
    even, odd = bits.bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(EVEN))
    return even.bitwiseOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))


def axis_masks(axes: int = AXES) -> list[int]:
    """The code bits of each axis: the 32 segments dealt to ``axes`` runs of nearly equal length."""
    edges = [32 * a // axes for a in range(axes + 1)]
    return [(1 << 2 * b) - (1 << 2 * a) for a, b in zip(edges, edges[1:], strict=False)]


def span(left: np.ndarray, right: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links within ``distance`` between two blocks (or inside one), reduced to a spanning forest."""
    def code(bits):
        even, odd = bits & np.uint64(EVEN), (bits >> np.uint64(1)) & np.uint64(EVEN)
        return even | odd | ((even & odd) << np.uint64(1))

    near = np.argwhere(np.bitwise_count(code(left)[:, None] ^ code(right)[None, :]) <= distance)
    a, b = left[near[:, 0]], right[near[:, 1]]
    real = (np.bitwise_count(a ^ b) <= distance) & (a != b)
    parent: dict[int, int] = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    links = []
    for x, y in zip(a[real].tolist(), b[real].tolist(), strict=True):
        if (rx := root(x)) != (ry := root(y)):
            parent[rx] = ry
            links.append((x, y))
    return links


def links(points: DataFrame, distance: int = DISTANCE, axes: int = AXES, block: int = BLOCK) -> DataFrame:
    """``a`` and ``b``: links between distinct fingerprints (column ``bits``) that connect what is within reach."""
    if axes <= distance:
        raise ValueError("there must be more axes than differing bits")
    masks = axis_masks(axes)
    triples = [sum(t) for t in combinations(masks, axes - distance)]
    cells = points.select("bits", grid_point(F.col("bits")).alias("point")).select("bits", F.explode(F.array(*(
        F.struct(F.lit(n).alias("axes"), F.col("point").bitwiseAND(F.lit(signed(m))).alias("corner"))
        for n, m in enumerate(triples)))).alias("cell")).select("bits", "cell.axes", "cell.corner")
    sizes = cells.groupBy("axes", "corner").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    shared = cells.join(sizes, ["axes", "corner"]).select(
        "axes", "corner", "bits", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.when(F.col("blocks") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("bits"), F.col("blocks")).cast("int"))
    tiles = shared.withColumn("own", own).select(
        "axes", "corner", "own", "bits", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select("axes", "corner", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                         "own", "bits")
    keys = ["axes", "corner", "i", "j"]

    def compare(batches):
        held: list[pa.Table] = []

        def tiles_of(rows: pa.Table):
            columns = [rows[k].to_numpy() for k in (*keys, "own")]
            bits = rows["bits"].to_numpy().astype(np.uint64)
            change = np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in columns[:4]])) + 1
            found = []
            for a, b in zip([0, *change], [*change, len(bits)], strict=True):
                if b - a > 1:
                    i, j, own = columns[2][a], columns[3][a], columns[4][a:b]
                    part = bits[a:b]
                    left, right = (part, part) if i == j else (part[own == i], part[own == j])
                    for at in range(0, len(left), block):
                        for to in range(0, len(right), block):
                            found += span(left[at:at + block], right[to:to + block], distance)
            ends = np.array(found, np.uint64).reshape(-1, 2).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*(b for t in held for b in t.to_batches()), batch])
            # The last tile may go on in the next batch.
            last = np.ones(rows.num_rows, bool)
            for key in keys:
                values = rows[key].to_numpy()
                last &= values == values[-1]
            edge = int(np.argmax(last))
            if edge:
                yield tiles_of(rows.slice(0, edge))
            held = [rows.slice(edge)]
        if held:
            yield tiles_of(held[0])

    return tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")


def placed(docs: DataFrame, size: int, distance: int) -> DataFrame:
    """``row``, ``doc_id``, ``bits`` and ``root`` (a fingerprint that names the component) of every row."""
    marked = settle(fingerprints(docs, size), "fingerprints")
    groups = components(links(marked.select("bits").distinct(), distance))
    return marked.join(groups.withColumnRenamed("node", "bits"), "bits", "left").select(
        "row", "doc_id", "bits", F.coalesce("root", "bits").alias("root"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` for every row."""
    rows = placed(docs, size, distance)
    names = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(names, "root").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One document of each component, the one with the smallest id (a null id only where there is no other); of rows
    that repeat id and text, one. Columns unchanged."""
    first = placed(docs, size, distance).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("first")).select("first.*")
    keyed, names = with_row_key(docs)
    return keyed.join(keys_of(first, names), names, "left_semi").dropDuplicates(names).select(docs.columns)
