"""Conversation repair: the grammar against plain parsing and search, whole tables against the SQL twin."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granulake.llm import conversations as conv
from granulake.llm.q_conversations import SQL

ROWS = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?")


def searched(kinds):
    """Least (cost, audit) by search over edits, without the grammar; the roles made are checked by the pattern."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, made = heapq.heappop(heap)
        if at == len(kinds) and PATTERN.fullmatch(made):
            return cost, audit
        key = (at, made[-1:], bool(made))
        if (key, cost, audit) in seen or len(made) > 2 * len(kinds) + 2:
            continue
        seen.add((key, cost, audit))
        options = [("I", 2, at, r) for r in "ua"]
        if at < len(kinds):
            kind = kinds[at]
            options.append(("D", 3, at + 1, ""))
            if kind != "D":
                extra = kind.isupper()
                options.append(("K", extra, at + 1, kind.lower()))
                options += [("R", 2 + extra, at + 1, r) for r in "ua"]
        for edit, more, after, role in options:
            new = made + role
            if re.fullmatch(r"s?(ua)*u?", new):
                heapq.heappush(heap, (cost + more, audit + edit, after, new))


def all_splits(kinds):
    """Cell of the whole by every way to cut every span."""
    n = len(kinds)
    cells = {(i, i + 1): conv.terminal(k) for i, k in enumerate(kinds)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            out = {}
            for k in range(i + 1, i + size):
                for key, value in conv.join(cells[i, k], cells[k, i + size]).items():
                    out[key] = min(out.get(key, value), value)
            cells[i, i + size] = out
    return cells[0, n]


def test_grammar_against_search_and_all_splits():
    rng = random.Random(1)
    for _ in range(150):
        kinds = "".join(rng.choices("suaxSUAXD", k=rng.randrange(0, 8)))
        assert conv.best(conv.span(kinds)) == searched(kinds), kinds
        if kinds:
            assert all_splits(kinds) == conv.span(kinds)
    long = "".join(rng.choices("uaUAsD", k=300))
    folded = {(0, 0): (0, "")}
    for i in range(0, 300, 7):
        folded = conv.join(folded, conv.span(long[i : i + 7]))
    assert conv.best(folded) == conv.best(conv.span(long))


def plain_repair(rows):
    """Results by conversation, row by row."""
    out, by = {}, {}
    for c, t, r, x in rows:
        by.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fate:
            x = "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x
            by[c] += [(t, "user" if fate == 4 else r, x)] * (2 if fate == 3 else 1)
    for c, got in by.items():
        got.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(f"{len(x[1])}:{x[1]}:{x[2]}".encode()).digest()))
        seen, kinds, faults = set(), "", []
        for t, r, x in got:
            body = x.rstrip(conv.BLANK)
            fault = "blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((r, x))
            faults.append(fault)
            letter = r[:1] if r[:1] in ("s", "u", "a") else "x"
            kinds += "D" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        turns = [t for t, _, _ in got if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:]))
        cost, audit = searched(kinds)
        lines, rest, last = [], iter(got), ""
        for e in audit:
            row = next(rest) if e != "I" else (None, None, "")
            if e != "D":
                role = row[1] if e == "K" else "assistant" if last == "u" else "user"
                last = role[:1]
                lines.append(f"{role}:{row[2]}")
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


def odd_rows():
    rng = random.Random(4)
    rows = [
        (None, 0, "user", "No id."), (None, None, None, None), (1, None, "user", "No turn."), (1, None, "user", "No turn."), (1, 5, None, "x."),
        (2, 0, "system", "Be kind."), (2, 1, "user", " \t\n"), (2, 2, "user", "Hi"), (2, 3, "assistant", "Hello.  "), (2, 3, "assistant", "Hello.  "),
        (3, 0, "", "Empty role."), (3, 1, "tool", "Other!"), (3, 2, "User", "Upper?"), (4, 7, "user", "é" * 2000 + "."), (4, 8, "assistant", ""),
        (-5, 3, "assistant", "日本語。"), (-5, 4, "system", "late system."), (-5, 4, "user", "tie."), (-5, 4, "assistant", "tie."),
    ]
    for c in range(10, 60):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t + (t > 2), rng.choice(["user", "assistant", "assistant", "user", "system"]), rng.choice(["Same.", f"{t} says.", "cut off", f"{c}!"])))
    return rows


def results(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in rows}
    assert len(out) == len(rows)
    return out


def by_sql(rows):
    con = duckdb.connect()
    names = [x.split(" ")[0] for x in ROWS.split(", ")]
    table = pa.table([pa.array([r[i] for r in rows], pa.int64() if i < 2 else pa.string()) for i in range(4)], names=names)
    con.register("conversations", table)
    got = con.execute(SQL).fetchall()
    return {r[0]: r[1:] for r in got}


@pytest.mark.parametrize("block", [2048, 2])
def test_odd_conversations(spark, block):
    rows = odd_rows()
    df = spark.createDataFrame(rows, ROWS).withColumns({"kind": F.lit(1), "copies": F.lit("x"), "fault": F.lit(None).cast("int"), "digest": F.lit(0)})
    got = results(conv.repair(conv.damage(df.repartition(3)), block_rows=block))
    assert got == plain_repair(rows)
    assert got == by_sql(rows)


def test_conversation_that_spans_every_task(spark):
    rng = random.Random(9)
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", rng.choice([f"{t}.", "again.", "cut", ""])) for t in range(600)]
    rows += [(7, 600, "user", "copied!")] * 50 + [(c, t, "user" if t % 2 == 0 else "assistant", "Fine.") for c in (6, 8) for t in range(4)]
    df = spark.createDataFrame(rows, ROWS)
    got = results(conv.repair(conv.damage(df), block_rows=16))
    assert got == by_sql(rows)
    assert got[7][2] > 100


def test_only_dropped_rows_and_empty_tables(spark):
    turn = next(t for t in range(500) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(9, turn, "user", "gone.")], ROWS)
    assert results(conv.repair(conv.damage(df))) == {9: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert conv.repair(conv.damage(spark.createDataFrame([], ROWS))).count() == 0
