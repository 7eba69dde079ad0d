"""Removal of repeated passages: anchors chosen by content, counted by the hash of what surrounds them.

This replaces prefix doubling: no rank pairs are sorted, nothing is ranked anew and the offsets do not double.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts anywhere else. Sorting the pairs of ranks
of all positions, again for every doubled offset, would move each byte of the corpus a dozen times (an estimate; no
such run was measured). Here names are kept for chosen positions only, below called ranks. The hashes of 8 bytes rank
the positions of a text; every string of ``LENGTH`` bytes is represented by its lowest position among the first
``SPREAD`` (the leftmost of equal ones), which depends on the string alone: equal strings choose the same place within
themselves. The rounds, at growing offsets:

1. ``core``: the rank of the LENGTH - SPREAD + 1 bytes after a chosen position, a part of every string it represents.
   Spark counts them; a position whose rank is unique leaves, and with it all its strings.
2. ``full``: of those that stay, the rank pair of the core and of all bytes of all strings that the position stands
   for. Where that pair occurs again, every string of the position is repeated.
3. Where it is unique, the strings of the position are ranked one by one at the full length, next to one position for
   each different pair of the same core. The ranks are past the threshold, so equal ones are repeated strings.

Ranks are 64-bit names by content (two bases, used in pairs) in place of dense numbers, which saves the sort that
renumbers them. Strings with equal names count as equal: their bytes are not compared. Texts travel as compressed blocks; a core shared by very many positions is ranked string by string
over the whole cluster instead of in one task.

Defined cases: null texts count as empty; texts shorter than ``LENGTH`` stay whole; a null ``doc_id`` and repeated rows
are kept (rows that repeat a long text lose all of it); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.blocks import BLOCK, pack, unpack
from kindred.llm.common import texts
from kindred.session import settle

LENGTH = 200
SPREAD = 100
GRAM = 8
# Bytes of text ranked at once, and bits of the table that spares unique cores the join.
SEGMENT = 1 << 18
BITS = 24
# Positions of one core that one task compares.
GROUP = 20_000
LOW = np.uint64((1 << 24) - 1)


class Names:
    """Content names of byte strings: a polynomial modulo 2 ** 64 over random values of the bytes, mixed."""

    def __init__(self, seed: int, size: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + rng.integers(0, 2, 256, np.uint64)
        base = int(rng.integers(0, 1 << 62)) * 4 + 3
        self.up, self.down = (self._powers(b, size) for b in (base, pow(base, -1, 1 << 64)))

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[:len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def names(seed: int, length: int) -> Names:
    """Large enough for every joined piece of text. Made anew by each task, so that it goes with the task."""
    return Names(seed, 2 * SEGMENT + 2 * length)


def chosen(data: np.ndarray, valid: np.ndarray, length: int, spread: int, first: Names, second: Names):
    """Chosen positions of joined texts: core, full, position, first and last start of the strings it represents.
    ``valid``: the starts of strings that lie in one text."""
    sums = first.sums(data)
    at = np.arange(len(data) - GRAM + 1)
    low = (first.of(sums, at, at + GRAM) & ~LOW) | at.astype(np.uint64)
    width = 1
    while 2 * width <= spread:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if spread > width:
        low = np.minimum(low[:width - spread], low[spread - width:])
    low = (low[:len(data) - length + 1] & LOW).astype(np.int64)
    change = np.concatenate([[True], (low[1:] != low[:-1]) | ~valid[:-1]]) & valid
    begin = np.flatnonzero(change)
    after = np.flatnonzero(np.concatenate([~valid | change, [True]]))
    last = after[np.searchsorted(after, begin, "right")] - 1
    place = low[begin]
    core = first.of(sums, place, place + length - spread + 1)
    shape = ((place - begin) * 256 + (last - place + 128)).astype(np.uint64)
    full = mixed(second.of(second.sums(data), begin, last + length) + shape * np.uint64(0x9E3779B97F4A7C15))
    return core, full, place, begin, last


def segments(data: bytes, length: int):
    """(bytes, valid starts, row number of each byte's text, offset to the position in that text): texts joined up to
    ``SEGMENT`` bytes, longer ones cut into segments that overlap by one string."""
    held: list[bytes] = []
    rows: list[int] = []
    shifts: list[int] = []
    size = 0

    def joined():
        sizes = np.array([len(x) for x in held])
        ends = np.cumsum(sizes)
        all_ = np.frombuffer(b"".join(held), np.uint8)
        valid = np.ones(len(all_) - length + 1, bool)
        for end in ends[:-1]:
            valid[max(0, end - length + 1):end] = False
        owner = np.repeat(np.arange(len(held)), sizes)
        return all_, valid, np.array(rows)[owner], (np.array(shifts) - (ends - sizes))[owner]

    for number, row in enumerate(unpack(data)):
        text = row[1].encode("utf-8", "replace")
        for start in range(0, max(1, len(text) - length + 1), SEGMENT):
            piece = text[start:start + SEGMENT + length - 1]
            if len(piece) >= length:
                held.append(piece)
                rows.append(number)
                shifts.append(start)
                size += len(piece)
            if size >= SEGMENT // 2:
                yield joined()
                held, rows, shifts, size = [], [], [], 0
    if held:
        yield joined()


ANCHORS = "core long, full long, block long, row int, place int, first int, last int"


def anchors(blocks: DataFrame, length: int, spread: int, wanted=None) -> DataFrame:
    """The chosen positions of all blocks; ``wanted``: a broadcast bit table that their cores must meet."""
    def run(batches):
        first_names, second_names = names(1, length), names(2, length)
        table = None if wanted is None else np.unpackbits(np.frombuffer(wanted.value, np.uint8), bitorder="little")
        for b in batches:
            for key, packed in zip(b[0].to_pylist(), b[1], strict=True):
                for data, valid, rows, shift in segments(packed.as_py(), length):
                    core, full, place, begin, last = chosen(data, valid, length, spread, first_names, second_names)
                    keep = slice(None) if table is None else table[core & np.uint64(len(table) - 1)].astype(bool)
                    core, full, place, begin, last = (x[keep] for x in (core, full, place, begin, last))
                    move = shift[begin]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(core.astype(np.int64)), pa.array(full.astype(np.int64)),
                        pa.array(np.full(len(core), key)), pa.array(rows[begin].astype(np.int32)),
                        *(pa.array((x + move).astype(np.int32)) for x in (place, begin, last))],
                        names=["core", "full", "block", "row", "place", "first", "last"])

    return blocks.mapInArrow(run, ANCHORS)


def bit_table(cores: DataFrame, bits: int) -> bytes:
    """One bit for each slot that a core falls into: 2 ** bits bits, whatever the number of cores."""
    slot = F.col("core").bitwiseAND(F.lit((1 << bits) - 1))
    found = cores.groupBy(F.bitmap_bucket_number(slot + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot + 1)).alias("bitmap")).toArrow()
    table = np.zeros((1 << bits) // 8, np.uint8)
    for bucket, bitmap in zip(found["bucket"].to_pylist(), found["bitmap"].to_pylist(), strict=True):
        table[(bucket - 1) * 4096:bucket * 4096] = np.frombuffer(bitmap, np.uint8)
    return table.tobytes()


def repeated_runs(codes: np.ndarray, owners: np.ndarray, starts: np.ndarray, single: np.ndarray):
    """Runs of starts whose names occur more than once: (owner, first, last) for owners marked ``single``. ``codes``,
    ``owners`` and ``starts`` are aligned, and starts ascend within an owner."""
    _, place, counts = np.unique(codes, return_inverse=True, return_counts=True)
    hit = np.flatnonzero((counts[place] > 1) & single[owners])
    if not len(hit):
        return np.zeros((0, 3), np.int64)
    cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(owners[hit]) != 0)) + 1
    begin, end = hit[np.concatenate([[0], cut])], hit[np.concatenate([cut - 1, [len(hit) - 1]])]
    return np.stack([owners[begin], starts[begin], starts[end]], axis=1)


def string_names(pieces: list[bytes], sizes: np.ndarray, cores: np.ndarray, length: int, named: Names):
    """Names of all strings of all pieces (``sizes``: how many each has), and the piece of each."""
    codes, owners = [], []
    at = 0
    while at < len(pieces):
        to, chars = at, 0
        while to < len(pieces) and (to == at or chars + len(pieces[to]) < SEGMENT):
            chars += len(pieces[to])
            to += 1
        data = np.frombuffer(b"".join(pieces[at:to]), np.uint8)
        begin = np.cumsum([0, *(len(p) for p in pieces[at:to - 1])])
        owner = np.repeat(np.arange(to - at), sizes[at:to])
        start = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(sizes[at:to]) - sizes[at:to], sizes[at:to])
        codes.append(named.of(named.sums(data), start, start + length) ^ mixed(cores[at:to].astype(np.uint64))[owner])
        owners.append(owner + at)
        at = to
    return np.concatenate(codes), np.concatenate(owners)


def removed(docs: DataFrame, length: int = LENGTH, spread: int = SPREAD, block: int = BLOCK,
            group: int = GROUP) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (array of start, end in bytes) and ``kept`` (the remaining bytes) for every
    row."""
    spark = docs.sparkSession
    blocks = pack(texts(docs), block)

    # Round 1: cores that occur more than once.
    cores = settle(anchors(blocks, length, spread).groupBy("core").agg(F.count("*").alias("n")).where(
        F.col("n") > 1).select("core"), "cores")
    wanted = spark.sparkContext.broadcast(bit_table(cores, BITS))
    stay = settle(anchors(blocks, length, spread, wanted).join(cores, "core"), "anchors")

    # Round 2: pairs that occur more than once; of each pair one position goes on if its core has a single one.
    classes = settle(stay.groupBy("core", "full").agg(
        F.count("*").alias("n"), F.min(F.struct("block", "row", "place", "first", "last")).alias("at")), "classes")
    per_core = classes.groupBy("core").agg(F.count("*").alias("pairs"), F.min("n").alias("least")).where(
        (F.col("least") == 1) & (F.col("pairs") > 1)).select("core", "pairs")
    asked = classes.join(per_core, "core").select(
        "core", "pairs", (F.col("n") == 1).alias("single"), "at.*")

    # Round 3: their strings at full length.
    def cut(data: pa.Table, ask: pa.Table) -> pa.Table:
        table = {name: ask[name].to_numpy() for name in ("row", "first", "last")}
        order = np.argsort(table["row"], kind="stable")
        rows = table["row"][order]
        pieces: list[bytes | None] = [None] * len(order)
        for packed in data["data"]:
            for number, row in enumerate(unpack(packed.as_py())):
                a, b = np.searchsorted(rows, [number, number + 1])
                if a < b:
                    text = row[1].encode("utf-8", "replace")
                    for k in order[a:b]:
                        pieces[k] = text[table["first"][k]:table["last"][k] + length]
        return ask.append_column("bytes", pa.array(pieces, pa.binary()))

    columns = "core long, pairs long, single boolean, block long, row int, place int, first int, last int"
    strings = settle(blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(
        cut, f"{columns}, bytes binary"), "strings")
    common = strings.where(F.col("pairs") <= group)

    def compare(batches):
        named = names(2, length)

        def runs(rows: pa.Table):
            first, last = rows["first"].to_numpy(), rows["last"].to_numpy()
            sizes = (last - first + 1).astype(np.int64)
            codes, owners = string_names(rows["bytes"].to_pylist(), sizes, rows["core"].to_numpy(), length, named)
            starts = first[owners] + np.arange(len(owners)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            found = repeated_runs(codes, owners, starts, rows["single"].to_numpy())
            of = found[:, 0]
            return pa.RecordBatch.from_arrays([
                pa.array(rows["block"].to_numpy()[of]), pa.array(rows["row"].to_numpy()[of]),
                pa.array(found[:, 1].astype(np.int32)), pa.array(found[:, 2].astype(np.int32))],
                names=["block", "row", "first", "last"])

        held: list[pa.Table] = []
        for batch in batches:
            if batch.num_rows:
                rows = pa.concat_tables([*held, pa.Table.from_batches([batch])])
                core = rows["core"].to_numpy()
                # The last core may go on in the next batch.
                edge = int(np.argmax(core == core[-1]))
                if edge:
                    yield runs(rows.slice(0, edge))
                held = [rows.slice(edge)]
        if held:
            yield runs(held[0])

    found = common.repartition("core").sortWithinPartitions("core").mapInArrow(
        compare, "block long, row int, first int, last int")

    def spread_out(batches):
        named = names(2, length)
        for rows in batches:
            first, last = rows.column("first").to_numpy(), rows.column("last").to_numpy()
            for a in range(0, rows.num_rows, 1024):
                part = rows.slice(a, 1024)
                sizes = (last - first + 1)[a:a + 1024].astype(np.int64)
                codes, owners = string_names(
                    part.column("bytes").to_pylist(), sizes, part.column("core").to_numpy(), length, named)
                starts = first[a:a + 1024][owners] + np.arange(len(owners)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([
                    pa.array(part.column("core").to_numpy()[owners]), pa.array(codes.astype(np.int64)),
                    pa.array(part.column("single").to_numpy(zero_copy_only=False)[owners]),
                    pa.array(part.column("block").to_numpy()[owners]), pa.array(part.column("row").to_numpy()[owners]),
                    pa.array(starts.astype(np.int32))], names=["core", "name", "single", "block", "row", "first"])

    # Cores in very many positions: their strings are counted one by one.
    crowded = strings.where(F.col("pairs") > group).mapInArrow(
        spread_out, "core long, name long, single boolean, block long, row int, first int")
    often = crowded.groupBy("core", "name").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("core", "name")
    found = found.unionByName(crowded.where("single").join(often, ["core", "name"]).select(
        "block", "row", "first", F.col("first").alias("last")))

    # Covered bytes: all strings of positions in repeated pairs, and the runs found one by one.
    whole = stay.join(classes.where(F.col("n") > 1).select("core", "full"), ["core", "full"]).select(
        "block", "row", "first", "last")
    covered = whole.unionByName(found)

    def remove(data: pa.Table, runs: pa.Table) -> pa.Table:
        row, first, last = (runs[c].to_numpy() for c in ("row", "first", "last"))
        order = np.argsort(row, kind="stable")
        row, first, last = row[order], first[order], last[order]
        ids, sizes, spans, kept = [], [], [], []
        for packed in data["data"]:
            for number, (doc_id, text) in enumerate(unpack(packed.as_py())):
                text = text.encode("utf-8", "replace")
                a, b = np.searchsorted(row, [number, number + 1])
                edges = np.zeros((0, 2), np.int64)
                if a < b:
                    depth = np.zeros(len(text) + 1, np.int32)
                    np.add.at(depth, first[a:b], 1)
                    np.add.at(depth, last[a:b].astype(np.int64) + length, -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).reshape(-1, 2)
                    kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
                else:
                    kept.append(text)
                ids.append(doc_id)
                sizes.append(len(text))
                spans.append([{"start": int(x), "end": int(y)} for x, y in edges])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, span),
                         pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return blocks.groupBy("block").cogroup(covered.groupBy("block")).applyInArrow(
        remove, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def digests(found: DataFrame) -> DataFrame:
    """The query's columns from the operator's output."""
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
