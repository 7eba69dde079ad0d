"""Streams that keep one row per key in Spark's state store, with lifetimes and timers."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kindred.plans.users import DELETE, SYNC_COLUMNS, UPSERTS, handled
from kindred.schemas import PREFERENCE_FIELDS

# Task functions travel with their code, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _none(value):
    """A pandas cell as a plain value; missing ones as None."""
    if value is None or value is pd.NaT or (isinstance(value, float) and np.isnan(value)):
        return None
    return value.item() if isinstance(value, np.generic) else value


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


# --- users ----------------------------------------------------------------------------------------

def user_schema(payload: list[str], key: str = "long") -> str:
    """Columns of the users' state and of what the stream emits, ``version`` counting a user's changes."""
    return (f"user_id {key}, " + ", ".join(f"{c} string" for c in payload)
            + ", deleted boolean, upsert_ts long, upsert_id long, last_ts long, last_id long, version long")


class _Users(StatefulProcessor):
    """The payload of a user's newest upsert and whether its newest event is a delete, whatever order events come in."""

    def __init__(self, payload: list[str]):
        self.payload, self.upserts, self.delete = payload, tuple(UPSERTS), DELETE

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("current", user_schema(self.payload).split(", ", 1)[1])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = len(self.payload)
        old = self.row.get() if self.row.exists() else (*[None] * n, False, None, None, None, None, 0)
        payload, (deleted, upsert_ts, upsert_id, last_ts, last_id, version) = old[:n], old[n:]
        for chunk in rows:
            ts, ids = chunk["at"].to_numpy(), chunk["event_id"].to_numpy()
            order = np.lexsort((ids, ts))
            last = order[-1]
            if last_ts is None or (ts[last], ids[last]) >= (last_ts, last_id):
                last_ts, last_id = int(ts[last]), int(ids[last])
                deleted = bool(chunk["type"].iloc[last] == self.delete)
            upserts = order[chunk["type"].isin(self.upserts).to_numpy()[order]]
            if len(upserts):
                best = upserts[-1]
                if upsert_ts is None or (ts[best], ids[best]) >= (upsert_ts, upsert_id):
                    upsert_ts, upsert_id = int(ts[best]), int(ids[best])
                    payload = tuple(_none(chunk[c].iloc[best]) for c in self.payload)
        changed = (*payload, deleted, upsert_ts is None) != (*old[:n], old[n], old[n + 1] is None) or not version
        new = (*payload, deleted, upsert_ts, upsert_id, last_ts, last_id, version + changed)
        self.row.update(new)
        if changed:
            names = [c.split()[0] for c in user_schema(self.payload).split(", ")]
            yield pd.DataFrame([(key[0], *new)], columns=names).astype({c: "Int64" for c in names[-5:]})

    def close(self) -> None:
        pass


def users(events: DataFrame, payload: list[str] | None = None) -> DataFrame:
    """Change events in, one row per user and micro-batch that changes it out (columns of :func:`user_schema`).

    The state holds each user's current row and the positions of its newest upsert and event.
    """
    payload = payload or SYNC_COLUMNS
    key = dict(events.dtypes)["user_id"].replace("bigint", "long")
    keyed = handled(events).select("user_id", "type", "event_id", micros("ts").alias("at"), *payload).groupBy("user_id")
    return keyed.transformWithStateInPandas(_Users(payload), user_schema(payload, key), "append", "None")


# --- preferences ----------------------------------------------------------------------------------

def _preference_state() -> str:
    return (", ".join(f"{f} string, {f}_ts long, {f}_seq long" for f in PREFERENCE_FIELDS)
            + ", created_at long, updated_at long, version long")


def preference_schema(key: str = "long") -> str:
    return (f"user_id {key}, " + ", ".join(f"{f} string" for f in PREFERENCE_FIELDS)
            + ", created_at long, updated_at long, onboarding_complete boolean, version long")


class _Preferences(StatefulProcessor):
    """Each field's newest non-null value with its position, on top of the stored row."""

    def __init__(self, fields: list[str], state: str):
        self.fields, self.state = fields, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("current", self.state)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        one = initialState.iloc[0]
        self.row.update((*[x for f in self.fields for x in (_none(one[f]), None, None)],
                         _none(one["created"]), _none(one["updated"]), 0))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = 3 * len(self.fields)
        old = self.row.get() if self.row.exists() else None
        held = list(old[:n]) if old else [None] * n
        touched = None
        for chunk in rows:
            touched = int(chunk["touched"].max())
            ts, seq = chunk["at"].to_numpy(), chunk["seq"].to_numpy()
            order = np.lexsort((seq, ts))
            for i, f in enumerate(self.fields):
                given = order[chunk[f].notna().to_numpy()[order]]
                if len(given):
                    best = given[-1]
                    at = (int(ts[best]), int(seq[best]))
                    if held[3 * i + 1] is None or at >= (held[3 * i + 1], held[3 * i + 2]):
                        held[3 * i:3 * i + 3] = [chunk[f].iloc[best], *at]
        created = old[n] if old and old[n] is not None else touched
        version = (old[n + 2] if old else 0) + 1
        self.row.update((*held, created, touched, version))
        values = held[::3]
        yield pd.DataFrame([(key[0], *values, created, touched, all(v is not None for v in values), version)],
                           columns=["user_id", *self.fields, "created_at", "updated_at", "onboarding_complete", "version"])

    def close(self) -> None:
        pass


def preferences(accepted: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Accepted patches (``touched``: when they are applied) in, a user's current row out after each micro-batch with patches.

    ``stored``: the rows that exist before the stream starts. Every later row goes on from them, so the completeness
    flag and the times are those of the whole row.
    """
    key = dict(accepted.dtypes)["user_id"].replace("bigint", "long")
    keyed = accepted.select("user_id", "seq", micros("created_at").alias("at"), micros("touched").alias("touched"),
                            *PREFERENCE_FIELDS).groupBy("user_id")
    first = None if stored is None else stored.select(
        "user_id", *PREFERENCE_FIELDS, micros("created_at").alias("created"), micros("updated_at").alias("updated")).groupBy("user_id")
    return keyed.transformWithStateInPandas(
        _Preferences(PREFERENCE_FIELDS, _preference_state()), preference_schema(key), "append", "None", first)


# --- cache entries --------------------------------------------------------------------------------

class _Entries(StatefulProcessor):
    """The newest event of an entry, for as long as its kind lives; a removal keeps its place without the payload."""

    def __init__(self, lifetimes: dict[str, int], value: str, payload: list[str]):
        self.lifetimes, self.value, self.payload = lifetimes, value, payload

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = {kind: handle.getValueState(kind, self.value, ms) for kind, ms in self.lifetimes.items()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        entry = self.entries[key[0]]
        old = entry.get() if entry.exists() else None
        new = old
        for chunk in rows:
            at = np.lexsort((chunk["seq"].to_numpy(), chunk["at"].to_numpy()))[-1]
            row = chunk.iloc[at]
            place = (int(row["at"]), int(row["seq"]))
            if new is None or place >= new[1:3]:
                live = row["op"] == "set"
                new = (bool(live), *place, *[_none(row[c]) if live else None for c in self.payload])
        if new != old:
            entry.update(new)
            yield pd.DataFrame([(*key, *new)], columns=["kind", "key", "live", "at", "seq", *self.payload])

    def close(self) -> None:
        pass


def entry_schema(events: DataFrame, payload: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in events.schema}
    return ", ".join(["live boolean, at long, seq long", *(f"{c} {types[c]}" for c in payload)])


def entries(events: DataFrame, lifetimes: dict[str, int], payload: list[str]) -> DataFrame:
    """Cache writes and removals in, an entry's newest event out. The state forgets an entry ``lifetimes[kind]`` milliseconds
    after it was last written, by the clock of the stream; events of a kind without a lifetime are left out."""
    value = entry_schema(events, payload)
    keyed = events.filter(F.col("kind").isin(list(lifetimes))).select(
        "kind", "key", "op", micros("ts").alias("at"), F.col("seq").cast("long").alias("seq"), *payload).groupBy("kind", "key")
    return keyed.transformWithStateInPandas(
        _Entries(lifetimes, value, payload), f"kind string, key string, {value}", "append", "ProcessingTime")


# --- presence -------------------------------------------------------------------------------------

CONNECTION = "connected boolean, at long, event_id long"


class _Connections(StatefulProcessor):
    """The newest event of each connection of one user's share; a timer at the first end drops silent and closed ones.

    The share is one list in the state, read and written as a whole: a call of the state per connection costs more than
    all else."""

    def __init__(self, silence_ms: int, step_ms: int):
        self.silence, self.step = silence_ms, step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getListState("connections", f"sid string, {CONNECTION}")

    def _ends(self, connected: bool, at: int) -> int:
        """When an entry leaves the state, in milliseconds, rounded up to a step."""
        ms = -(-at // 1000) + (self.silence if connected else 0)
        return -(-ms // self.step) * self.step

    def _first_end(self, entries) -> int | None:
        return min((self._ends(connected, at) for connected, at, _ in entries), default=None)

    def _keep(self, entries: dict[str, tuple]) -> None:
        if entries:
            self.known.put([(sid, *entry) for sid, entry in entries.items()])
        else:
            self.known.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest: dict[str, tuple] = {}
        for row in rows:
            event = (int(row.at), int(row.event_id), bool(row.connected))
            if row.sid not in newest or event > newest[row.sid]:
                newest[row.sid] = event
        entries = {sid: entry for sid, *entry in self.known.get()}
        timer = self._first_end(entries.values())
        changed = []
        for sid, (at, event_id, connected) in newest.items():
            old = entries.get(sid)
            if old is None or (at, event_id) >= tuple(old[1:3]):
                entries[sid] = (connected, at, event_id)
                changed.append(sid)
        if changed:
            self._keep(entries)
            first = self._first_end(entries.values())
            if first != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(first)
        for sid in changed:
            yield _change(key[0], sid, *entries[sid], "event")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        entries = {sid: entry for sid, *entry in self.known.get()}
        ended = [sid for sid, (connected, at, _) in entries.items() if self._ends(connected, at) <= now]
        gone = [(sid, entries.pop(sid)) for sid in ended]
        if gone:
            self._keep(entries)
        if entries:
            self.handle.registerTimer(self._first_end(entries.values()))
        for sid, (connected, at, event_id) in gone:
            if connected:
                yield _change(key[0], sid, False, at, event_id, "silent")

    def close(self) -> None:
        pass


def _change(user_id, sid, connected, at, event_id, reason) -> Row:
    return Row(user_id=user_id, sid=sid, connected=connected, at=at, event_id=event_id, reason=reason)


def connections(events: DataFrame, delay: str, silence_ms: int, step_ms: int = 60_000, shares: int = 4) -> DataFrame:
    """Connects and disconnects in, changes of a connection out (``reason``: the event, or ``silent``).

    A connection without a sign of life for ``silence_ms`` ends when the watermark (``delay`` behind the newest event)
    passes that moment, a closed one is forgotten when it passes its end; both are rounded up to ``step_ms``. A user's
    connections are dealt into ``shares`` keys, so a user with very many is not one task's work.
    """
    key = dict(events.dtypes)["user_id"].replace("bigint", "long")
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).filter(F.col("user_id").isNotNull())
    keyed = timed.select("user_id", F.pmod(F.xxhash64("sid"), F.lit(shares)).alias("share"), "sid", "connected", "ts",
                         micros("ts").alias("at"), F.col("event_id").cast("long").alias("event_id")).groupBy("user_id", "share")
    return keyed.transformWithState(
        _Connections(silence_ms, step_ms), f"user_id {key}, sid string, {CONNECTION}, reason string", "append", "EventTime")
