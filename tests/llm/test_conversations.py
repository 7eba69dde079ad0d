from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import groupby

import duckdb
import pytest

from kindred.llm import conversations as C
from kindred.llm import queries

SF = "/root/testdata/sf0.001"
GRAMMAR = re.compile("(s?(ua)+)?")


def every_repair(rows, inserts):
    """(cost, audit, initials) of every sequence of edits with at most so many inserts."""
    if inserts:
        for role in "ua":
            for c, a, out in every_repair(rows, inserts - 1):
                yield c + 3, "I" + a, role + out
    if not rows:
        yield 0, "", ""
        return
    (initial, fault), rest = rows[0], rows[1:]
    more = 3 if fault == C.TRUNCATED else 0
    for c, a, out in every_repair(rest, inserts):
        yield c + 4, "D" + a, out
        if fault < C.BLANK:
            yield c + more, "K" + a, initial + out
            for role in "ua":
                yield c + 3 + more, "R" + a, role + out


def test_least_cost_and_audit_of_all_edits():
    rng = random.Random(3)
    for _ in range(250):
        rows = [(rng.choice("suaaux"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 4))]
        want = min((c, a) for c, a, out in every_repair(rows, 3) if GRAMMAR.fullmatch(out))
        assert C.repair(rows) == want, rows


def by_table(rows, state=0, goals=(0, 3)):
    """The same by filling the whole table from the end."""
    best = [{} for _ in range(len(rows) + 2)]
    for at in range(len(rows), -1, -1):
        now = {g: (0, "") for g in goals} if at == len(rows) else {}
        for _ in range(5):
            for s in C.STATES:
                ways = [now[s]] if s in now else []
                for edit, w, (to, q) in C.ahead(rows, (at, s)):
                    later = now.get(q) if to == at else best[to].get(q)
                    if later is not None:
                        ways.append((w + later[0], edit + later[1]))
                if ways:
                    now[s] = min(ways)
        best[at] = now
    return best[0].get(state)


def test_long_conversations_and_every_pair_of_states():
    rng = random.Random(4)
    for n in (0, 1, 7, 60, 400):
        for _ in range(12):
            rows = [(rng.choice("suaua?"), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(n)]
            for s in C.STATES:
                for e in C.STATES:
                    assert C.repair(rows, s, [e]) == by_table(rows, s, [e])
            assert C.repair(rows) == by_table(rows)


def plain(rows):
    """The contract, one conversation after the other."""
    hurt = []
    for conv_id, turn, role, text in rows:
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        hurt += [(conv_id, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    out = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in rows}
    place = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3])
    for conv_id, group in groupby(sorted(hurt, key=place), key=lambda r: r[0]):
        group = list(group)
        faults, seen = [], set()
        for _, _, role, text in group:
            rest = text.rstrip(" \t\n\v\f\r")
            faults.append(C.BLANK if not rest else C.DUPLICATE if (role, text) in seen else
                          C.TRUNCATED if rest[-1] not in ".!?" else C.FINE)
            seen.add((role, text))
        turns = {r[1] for r in group} - {None}
        bad = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(group, group[1:]))
        cost, audit = by_table([(r[2][:1], f) for r, f in zip(group, faults)])
        lines, rest = [], list(group)
        for edit in audit:
            expected = "assistant" if lines and lines[-1].startswith("u") else "user"
            _, _, role, text = rest.pop(0) if edit != "I" else (0, 0, expected, "")
            if edit != "D":
                lines.append(f"{role if edit == 'K' else expected}:{text}")
        out[conv_id] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(C.BLANK),
                        faults.count(C.DUPLICATE), faults.count(C.TRUNCATED), bad, cost, audit,
                        hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_over_the_given_table(spark):
    rows = duckdb.connect().execute(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    assert found(queries.op12_repair_conversations(spark, SF)) == plain(rows)


def some_rows(rng, n, conversations):
    texts = ["Yes.", "No?", "well", "", " \t", None, "Thanks!  ", "ends here", "Ünï…", "a b c."]
    return [(rng.choice(conversations), rng.choice([None, *range(12)]),
             rng.choice(["user", "assistant", "system", "tool", "", None, "User"]),
             rng.choice([*texts, f"text {rng.randint(0, 40)}."])) for _ in range(n)]


@pytest.mark.parametrize("piece_rows", [3, 20_000])
def test_nulls_ties_and_one_large_conversation_in_pieces(spark, piece_rows):
    rng = random.Random(piece_rows)
    rows = some_rows(rng, 500, [None, *range(60), 7, 7, 7]) + some_rows(rng, 400, [7])
    rows += [(99, 5, "user", "the same row.")] * 50 + [(98, t, "system", "gap") for t in (0, 10**15, 2**62)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, piece int")
    assert found(C.repaired(C.damaged(table.repartition(6)), piece_rows=piece_rows)) == plain(rows)
    assert found(C.repaired(C.damaged(table), piece_rows=piece_rows, piece_bytes=10)) == plain(rows)


def test_empty_table_and_long_texts(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert C.repaired(C.damaged(spark.createDataFrame([], schema))).count() == 0
    rows = [(1, i, "user" if i % 2 else "assistant", "word " * 200_000 + f"{i}.") for i in range(6)]
    assert found(C.repaired(C.damaged(spark.createDataFrame(rows, schema)), piece_bytes=1 << 20)) == plain(rows)
