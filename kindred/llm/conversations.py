"""Cheapest repair of the structure of conversations, by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows used, state), the state being what the roles put out so far allow next: nothing yet, a
system turn, a user turn, an assistant turn. Edges are the edits: K keeps a row (0), R gives it the role that comes next (3),
D deletes it (4; the only choice for a blank or duplicate row), I puts in an empty text of the role that comes next (3);
a truncated row that stays costs 3 more. Initials of the roles must read ``(s?(ua)+)?``. One heap goes forward from the first
node, one in reverse from the last ones; both go on until their least costs add up to more than the best meeting, so every
node of every cheapest path is settled from one side, every crossing of equal cost included. The least audit is then
read off by taking the least edit, node by node, that stays on a cheapest path (an audit up to a point names its node, so
no two paths have to be held).

Rows are sorted by range, so that most conversations lie in one partition and are repaired where they are read. What
reaches over an edge of a partition, or is longer than ``PIECE_ROWS`` rows or ``PIECE_BYTES`` bytes, goes on in pieces:
duplicates are found by a group-by, each piece is solved from every state to every state, the pieces are joined in order,
and the repaired texts stream through the hash. No task holds the rows of a conversation of any length; what grows
with it are its audit and its pieces' tables (one character a row for each pair of states).

Order and defined cases: rows with the same turn follow each other by role, by text (by the first 64 characters of
both, then by a hash) and repeats lie side by side; null ids and turns read as one space in the damage's key; a null
id is a conversation of its own; null roles and texts become one space; the initial of an empty role is empty; an
unknown role can only be given another or go; without rows there is no result; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import slices
from kindred.session import settle

PIECE_ROWS = 20_000
PIECE_BYTES = 16 << 20
SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)

# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = STATES = range(4)
GOALS = (EMPTY, ASSISTANT)
# The role that R and I give in a state, and the state after it.
NEXT_ROLE = {EMPTY: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
BEFORE = {EMPTY: (), SYSTEM: (), USER: (EMPTY, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
KEEP, REROLE, DELETE, INSERT, MEND = 0, 3, 4, 3, 3


def after(state: int, initial: str) -> int | None:
    """The state once a row whose role has this initial is kept; None if it may not follow."""
    if initial == NEXT_ROLE[state][0]:
        return NEXT[state]
    return SYSTEM if state == EMPTY and initial == "s" else None


def ahead(rows: Sequence[tuple[str, int]], node: tuple[int, int]):
    """(edit, cost, next node), in the order of the edits' letters."""
    at, state = node
    if at < len(rows):
        yield "D", DELETE, (at + 1, state)
    yield "I", INSERT, (at, NEXT[state])
    if at < len(rows) and rows[at][1] < BLANK:
        initial, fault = rows[at]
        more = MEND if fault == TRUNCATED else 0
        if (kept := after(state, initial)) is not None:
            yield "K", KEEP + more, (at + 1, kept)
        yield "R", REROLE + more, (at + 1, NEXT[state])


def behind(rows: Sequence[tuple[str, int]], node: tuple[int, int]):
    """(cost, earlier node) of every edit that leads to ``node``."""
    at, state = node
    for earlier in BEFORE[state]:
        yield INSERT, (at, earlier)
    if at:
        yield DELETE, (at - 1, state)
        initial, fault = rows[at - 1]
        if fault < BLANK:
            more = MEND if fault == TRUNCATED else 0
            for earlier in BEFORE[state]:
                yield REROLE + more, (at - 1, earlier)
            for earlier in STATES:
                if after(earlier, initial) == state:
                    yield KEEP + more, (at - 1, earlier)


def repair(rows: Sequence[tuple[str, int]], state: int = EMPTY, goals: Iterable[int] = GOALS) -> tuple[int, str] | None:
    """Least cost and, among the cheapest, the least audit of (initial, fault) rows; None if no goal can be reached."""
    start, ends = (0, state), {(len(rows), g) for g in goals}
    cost = [{start: 0}, dict.fromkeys(ends, 0)]
    heaps = [[(0, start)], [(0, e) for e in sorted(ends)]]
    settled: list[dict] = [{}, {}]
    best = 0 if start in ends else None
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = int(heaps[1][0][0] < heaps[0][0][0] or (heaps[1][0][0] == heaps[0][0][0] and len(heaps[1]) < len(heaps[0])))
        c, node = heappop(heaps[side])
        if node in settled[side]:
            continue
        settled[side][node] = c
        edges = behind(rows, node) if side else ((w, v) for _, w, v in ahead(rows, node))
        for w, v in edges:
            if c + w < cost[side].get(v, c + w + 1):
                cost[side][v] = c + w
                heappush(heaps[side], (c + w, v))
            if v in cost[1 - side] and (best is None or c + w + cost[1 - side][v] < best):
                best = c + w + cost[1 - side][v]
    if best is None:
        return None
    forward, reverse = settled
    # Forward nodes from which a crossing of the best cost, or an end, is reached.
    open_ = [u for u, c in forward.items()
             if (u in ends and c == best) or any(v in reverse and c + w + reverse[v] == best for _, w, v in ahead(rows, u))]
    leads = set(open_)
    while open_:
        u = open_.pop()
        for w, p in behind(rows, u):
            if p not in leads and p in forward and forward[p] + w == forward[u]:
                leads.add(p)
                open_.append(p)
    node, c, audit = start, 0, []
    while not (node in ends and c == best):
        edit, w, node = next((e, w, v) for e, w, v in ahead(rows, node) if (
            v in reverse and c + w + reverse[v] == best) or (v in leads and forward[v] == c + w))
        audit.append(edit)
        c += w
    return best, "".join(audit)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``live``: false for a dropped row, whose role and text are gone."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        text.alias("text"), F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("fate"))
    fate = F.col("fate")
    return rows.select(
        "conv_id", "turn", F.when(fate == 4, "user").when(fate != 0, F.col("role")).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate("text", ENDS, "")).when(fate != 0, F.col("text")).alias("text"),
        (fate != 0).alias("live"),
        F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def fault_of(text: str) -> int:
    """Whether a text is blank or truncated, by itself."""
    rest = text.rstrip(SPACES)
    return BLANK if not rest else FINE if rest[-1] in ENDS else TRUNCATED


class Rewriter:
    """Replays an audit over rows as they come and hashes the repaired conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, EMPTY
        self.hash, self.any = hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True

    def inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self._put(NEXT_ROLE[self.state], "")
            self.state = NEXT[self.state]
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._put(role, text)
            self.state = after(self.state, role[:1])
        elif edit == "R":
            self._put(NEXT_ROLE[self.state], text)
            self.state = NEXT[self.state]

    def digest(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


def illegal(before: str | None, initial: str) -> bool:
    return before is not None and before + initial not in ("su", "ua", "au")


class Tally:
    """Counts over rows in their order: turns, faults, neighbours that may not follow each other."""

    def __init__(self):
        self.rows: list[tuple[str, int]] = []
        self.first = self.last = self.low = self.high = None
        self.turns = self.illegal = 0

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.illegal += illegal(self.last, initial)
        self.first, self.last = initial if self.first is None else self.first, initial
        self.rows.append((initial, fault))

    def faults(self) -> tuple[int, int, int]:
        return tuple(sum(f == kind for _, f in self.rows) for kind in (BLANK, DUPLICATE, TRUNCATED))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
JOINED = "conv string, conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string"
# A row of a repaired conversation (``piece`` null) or a row that goes on.
FOUND = f"{RESULT}, piece long, seq long, turn long, role string, text string, live boolean, fault int"


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def whole(conv_id: int | None, rows: list[tuple]) -> tuple:
    """The result of a conversation that is held whole; ``rows``: (turn, role, text, live)."""
    seen, tally, kept = set(), Tally(), []
    for turn, role, text, live in rows:
        if live:
            fault = fault_of(text)
            if fault != BLANK and (role, text) in seen:
                fault = DUPLICATE
            seen.add((role, text))
            tally.add(turn, role[:1], fault)
            kept.append((role, text))
    cost, audit = repair(tally.rows)
    out = Rewriter(audit)
    for role, text in kept:
        out.row(role, text)
    gaps = 0 if tally.low is None else tally.high - tally.low + 1 - tally.turns
    return (conv_id, gaps, *tally.faults(), tally.illegal, cost, audit, out.digest())


def first_pass(rows: DataFrame, piece_rows: int, piece_bytes: int) -> DataFrame:
    """Results of conversations inside a partition, and the rows of the others; ``rows`` are sorted by range."""
    schema = arrow_schema(FOUND)
    results = len(RESULT.split(", "))

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        held: list[tuple] = []
        size, piece, seq, now, alone = 0, 0, 0, None, False

        def pass_on():
            nonlocal piece, seq, size
            for turn, role, text, live in held:
                out.append((now, *[None] * (results - 1), part << 32 | piece, part << 40 | seq, turn, role, text, live,
                            fault_of(text) if live else None))
                seq += 1
            piece += 1
            held.clear()
            size = 0

        def batch():
            found = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return found

        started = False
        for b in slices(batches):
            for conv_id, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if started and conv_id != now:
                    # The first conversation of a partition may have begun in the one before.
                    if alone:
                        out.append((*whole(now, held), *[None] * (len(schema) - results)))
                        held.clear()
                        size = 0
                    else:
                        pass_on()
                    alone = True
                started, now = True, conv_id
                held.append(tuple(row))
                size += len(row[2] or "")
                if len(held) >= piece_rows or size >= piece_bytes:
                    alone = False
                    pass_on()
                    yield batch()
            if len(out) >= 1000:
                yield batch()
        if held:
            pass_on()
        if out:
            yield batch()

    return rows.mapInArrow(run, FOUND)


PIECE = ("conv string, conv_id long, piece long, first string, last string, low long, high long, turns long, blank long, "
         "duplicate long, truncated long, illegal long")
WAYS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _pieces(batches):
    """A row per piece: its counts and, for every pair of states, the cheapest least way through it."""
    def row(conv, conv_id, piece, tally):
        ways = [{"start": s, "end": e, "cost": way[0], "audit": way[1]}
                for s in STATES for e in STATES if (way := repair(tally.rows, s, [e]))]
        blank, duplicate, truncated = tally.faults()
        return pa.RecordBatch.from_pylist([{
            "conv": conv, "conv_id": conv_id, "piece": piece, "first": tally.first, "last": tally.last, "low": tally.low,
            "high": tally.high, "turns": tally.turns, "blank": blank, "duplicate": duplicate, "truncated": truncated,
            "illegal": tally.illegal, "ways": ways}], schema=arrow_schema(PIECE).append(pa.field("ways", WAYS)))

    now, tally = None, None
    for b in slices(batches, 4096):
        for conv, conv_id, piece, _, turn, initial, live, fault, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now is None or piece != now[2]:
                if now:
                    yield row(*now, tally)
                now, tally = (conv, conv_id, piece), Tally()
            if live:
                tally.add(turn, initial, DUPLICATE if fault != BLANK and not first else fault)
    if now:
        yield row(*now, tally)


def _join_pieces(pieces: pa.Table) -> pa.Table:
    """One conversation's pieces put together: sums, and the cheapest least way from state to state."""
    best: dict[int, tuple[int, str]] = {EMPTY: (0, "")}
    sums = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0)
    low = high = last = None
    for p in sorted(pieces.to_pylist(), key=lambda p: p["piece"]):
        for c in sums:
            sums[c] += p[c]
        if p["low"] is not None:
            sums["turns"] -= p["low"] == high
            low, high = p["low"] if low is None else low, p["high"]
        if p["first"] is not None:
            sums["illegal"] += illegal(last, p["first"])
            last = p["last"]
        step: dict[int, tuple[int, str]] = {}
        for way in p["ways"]:
            if way["start"] in best:
                so_far = best[way["start"]]
                found = (so_far[0] + way["cost"], so_far[1] + way["audit"])
                step[way["end"]] = min(found, step.get(way["end"], found))
        best = step
    cost, audit = min(best[g] for g in GOALS if g in best)
    gaps = 0 if low is None else high - low + 1 - sums.pop("turns")
    return pa.Table.from_pylist([{
        "conv": p["conv"], "conv_id": p["conv_id"], "gaps": gaps, **{c: sums[c] for c in COUNTS[1:5]}, "cost": cost,
        "audit": audit}], schema=arrow_schema(JOINED))


def _digests(batches):
    """Streams each conversation's audit (first) and rows, in order, through the hash."""
    schema = arrow_schema(RESULT)
    head, out = None, None

    def done():
        return pa.RecordBatch.from_pylist([head | {"repaired_sha256": out.digest()}], schema=schema)

    for b in slices(batches):
        for row in b.to_pylist():
            if row["seq"] < 0:
                if head:
                    yield done()
                head, out = {n: row[n] for n in schema.names[:-1]}, Rewriter(row["audit"])
            elif row["live"]:
                out.row(row["role"], row["text"])
    if head:
        yield done()


def in_pieces(rest: DataFrame) -> DataFrame:
    """The results of the conversations whose rows (of :func:`first_pass`) lie in several places."""
    rows = rest.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    firsts = rows.where(F.col("live") & (F.col("fault") != BLANK)).groupBy(
        "conv", F.xxhash64("role", "text").alias("k"), F.xxhash64(F.lit(1), "text", "role").alias("k2")).agg(
        F.min("seq").alias("seq")).select("seq", F.lit(True).alias("first"))
    marked = rows.select("conv", "conv_id", "piece", "seq", "turn", F.substring("role", 1, 1).alias("initial"), "live",
                         "fault").join(firsts, "seq", "left").select(
        "conv", "conv_id", "piece", "seq", "turn", "initial", "live", "fault", F.coalesce("first", F.lit(False)).alias("first"))
    pieces = marked.repartition("piece").sortWithinPartitions("piece", "seq").mapInArrow(
        _pieces, f"{PIECE}, ways array<struct<start:int,end:int,cost:long,audit:string>>")
    joined = pieces.groupBy("conv").applyInArrow(_join_pieces, JOINED)
    nothing = [F.lit(None).cast("long").alias(c) for c in COUNTS]
    lines = joined.select("conv", "conv_id", F.lit(-1).cast("long").alias("seq"), *COUNTS, "audit",
                          F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
                          F.lit(False).alias("live")).unionByName(
        rows.select("conv", "conv_id", "seq", *nothing, F.lit(None).cast("string").alias("audit"), "role", "text", "live"))
    # A hash takes its bytes in order: the texts of one conversation stream through one task, none of them held.
    return lines.repartition("conv").sortWithinPartitions("conv", "seq").mapInArrow(_digests, RESULT)


def order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.substring("role", 1, 64).asc_nulls_first(),
            F.substring("text", 1, 64).asc_nulls_first(), F.xxhash64("role", "text").asc(), F.col("at").asc()]


def repaired(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row per conversation of ``rows`` (as :func:`damaged` gives them), in the columns of ``RESULT``."""
    # Rows that repeat each other may be cut apart by where they were read.
    keyed = rows.withColumn("at", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(*order()).sortWithinPartitions(*order()).select("conv_id", "turn", "role", "text", "live")
    found = settle(first_pass(ranged, piece_rows, piece_bytes), "conversations")
    names = arrow_schema(RESULT).names
    return found.where("piece IS NULL").select(names).unionByName(in_pieces(found.where("piece IS NOT NULL")).select(names))
