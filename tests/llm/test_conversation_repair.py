"""The program against a search over all edits, the query against plain loops and against its SQL."""

from __future__ import annotations

import hashlib
import heapq
import os
import random
import re
import zlib

import duckdb
import pytest

from ledgerscope.llm import conversation_repair as repair
from ledgerscope.llm import queries


def cheapest(rows):
    """(cost, audit, repaired rows) by a search in order of cost and letters; rows are (role, text, must go, truncated)."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, q, out = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit, out
        if (i, q) in seen:
            continue
        seen.add((i, q))
        to, speaker = (3, "assistant") if q == 2 else (2, "user")
        heapq.heappush(heap, (cost + 5, audit + "I", i, to, out + ((speaker, ""),)))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q, out))
            if not gone:
                heapq.heappush(heap, (cost + 1 + 5 * cut, audit + "R", i + 1, to, out + ((speaker, text),)))
                kept = {"s": 1 if q == 0 else None, "u": 2 if to == 2 else None, "a": 3 if to == 3 else None}.get(role[:1])
                if kept:
                    heapq.heappush(heap, (cost + 5 * cut, audit + "K", i + 1, kept, out + ((role, text),)))


def test_runs_and_pieces_same_as_search():
    rng = random.Random(1)
    symbols = ["s0", "s1", "u0", "u1", "a0", "a1", "o0", "o1", repair.GONE]
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
    for _ in range(3000):
        seq = [rng.choice(symbols[rng.randrange(0, 6):]) for _ in range(rng.randrange(0, 11))]
        seq = sorted(seq) if rng.random() < 0.3 else seq
        cost, audit, _ = cheapest([(roles[s[0]], "", s == repair.GONE, s[-1] == "1") for s in seq])
        k = rng.randrange(0, len(seq) + 1)
        left, right = repair.runs_of(seq[:k]), repair.runs_of(seq[k:])
        middle = repair._through(repair.transition(right), repair.END)
        assert repair._through(repair.transition(left), middle)[repair.START] == cost
        first, at = repair.unroll(left, middle, (0,))[0]
        second, end = repair.unroll(right, repair.END, (0, 1, 2, 3))[at]
        assert "".join(first + second) + repair.closing(end) == audit


def test_long_runs_take_few_steps():
    v = repair.advance("u0", 10 ** 12, repair.END)
    w = repair.advance("u0", 10 ** 12 - 2, repair.END)
    assert v[repair.START] == w[repair.START] + 1  # of two more user rows one is kept and one re-roled


def plain_report(rows):
    """Every step with plain loops."""
    ids = {r[0] for r in rows}
    after = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        after += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv in ids:
        mine = [r for r in after if r[0] == conv]
        name = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()[:32]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, name(r)))
        seen, faults, edits = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, _, role, text in mine:
            found = re.findall(r"[^\x20\x09-\x0D]", text)
            blank, again, cut = not found, (role, text) in seen, bool(found) and found[-1] not in ".!?"
            seen.add((role, text))
            fault = "blank" if blank else "duplicate" if again else "truncated" if cut else None
            if fault:
                faults[fault] += 1
            edits.append((role, text, blank or again, cut))
        cost, audit, repaired = cheapest(edits)
        turns = {r[1] for r in mine if r[1] is not None}
        initials = [r[2][:1] for r in mine]
        out[conv] = {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **faults, "cost": cost, "audit": audit,
                     "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "rows": list(repaired),
                     "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()}
    return out


def table():
    rng = random.Random(4)
    texts = ["Fine.", "Good?", "cut", " \t\n", "", "ends . ", "é!", "...", "x.\x00y", None]
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(0, 9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ["user", "assistant"][turn % 2]
            role = rng.choice(["system", "tool", "", None, "User", "sys"]) if rng.random() < 0.1 else role
            turn = None if rng.random() < 0.1 else turn - rng.randrange(0, 2) * 3
            rows.append((conv, turn, role, rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    rows += [(None, t, "user", "null id.") for t in (1, 1, None, 2)] + [(900, None, None, None)] * 3
    rows += [(901, t, ["user", "assistant"][t % 2], f"hot {t}." if t % 7 else "again.") for t in range(700)]  # over all parts
    rows += [(902, 5, "user", "same.")] * 40 + [(903, t, "user", f"{t}.") for t in range(30)] + [(904, 1, "user", "z " * 100_000 + ".")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, `e0.v0` string").repartition(3)


@pytest.fixture
def many_parts(spark):
    """Small ranges stay apart, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_report_same_as_plain(spark, many_parts):
    rows = table()
    convs = frame(spark, rows)
    got = {r["conv_id"]: r for r in repair.report(repair.damaged(convs), convs).collect()}
    want = plain_report(rows)
    assert set(got) == set(want)
    for conv, row in want.items():
        assert {c: got[conv][c] for c in row if c != "rows"} == {c: v for c, v in row.items() if c != "rows"}, conv
    fixed = {}
    for r in sorted(repair.repaired(repair.damaged(convs)).collect(), key=lambda r: r["position"]):
        fixed.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert fixed == {conv: row["rows"] for conv, row in want.items() if row["rows"]}


def test_long_conversation_is_cut_into_pieces(spark, many_parts):
    rows = [(1, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(400)]
    ordered = repair._ordered(repair._keyed(frame(spark, rows)))
    assert ordered.select("part").distinct().count() > 1
    got = repair.report(frame(spark, rows)).collect()
    assert [(r["audit"], r["cost"]) for r in got] == [("K" * 400, 0)]


def test_empty_table(spark):
    assert repair.report(frame(spark, [])).collect() == [] and repair.repaired(frame(spark, [])).collect() == []


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")
def test_same_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{FOLDER}/conversations.parquet'")
    want = con.execute(queries.statements()["op13_conversation_repair"])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r) for r in queries.plans()["op13_conversation_repair"](spark, FOLDER).select(*names).collect()) == sorted(want.fetchall())
