"""Repeated runs of lines against a plain search over all windows."""

from __future__ import annotations

import hashlib
import random

from ledgerscope.llm import line_dedup

BLANK = " \t\r\x0b\x0c"


def plain(docs):
    """Per (id, text): lines, removed lines, runs, kept text."""
    order = sorted({(i is None, i or 0, t) for i, t in docs}, key=lambda d: (d[0], d[1]))
    seen, out = set(), {}
    for none, i, text in order:
        lines = (text or "").split("\n")
        full = [n for n, line in enumerate(lines) if line.strip(BLANK)]
        gone = set()
        for s in range(len(full) - line_dedup.RUN + 1):
            run = tuple(lines[n].strip(BLANK) for n in full[s:s + line_dedup.RUN])
            if run in seen:
                gone.update(range(s, s + line_dedup.RUN))
            seen.add(run)
        runs = sum(1 for g in gone if g - 1 not in gone)
        dead = {full[g] for g in gone}
        kept = "\n".join(line for n, line in enumerate(lines) if n not in dead)
        out[None if none else i, text] = (len(full), len(gone), runs, kept)
    return out


def corpus():
    rng = random.Random(9)
    pool = [f"line number {i} é" for i in range(40)]
    docs = []
    for i in range(120):
        lines = rng.choices(pool, k=rng.randrange(0, 14))
        if i % 3 == 0:
            at = rng.randrange(20)
            lines[2:2] = pool[at:at + rng.randrange(2, 9)]
        docs.append((i, "\n".join(x + " " * rng.randrange(2) + ("\n" if rng.random() < 0.1 else "") for x in lines)))
    docs += [(120, None), (121, ""), (122, "\n\n"), (123, "same\n" * 500), (124, docs[3][1]), (125, "\n".join(f"u{i}" for i in range(3000)))]
    docs += [(3, docs[3][1]), (None, docs[0][1] + "\nend of null")]
    return docs


def test_same_as_plain(spark):
    docs = corpus()
    want = plain(docs)
    got = line_dedup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(
        str((i, *want[i, t][:3], hashlib.sha256(want[i, t][3].encode()).hexdigest())) for i, t in docs)
    assert sum(r["n_removed"] for r in got) > 100


def test_drop_rewrites_texts(spark):
    docs = corpus()
    want = plain(docs)
    frame = spark.createDataFrame([(i, t, "k", 5) for i, t in docs], "doc_id long, text string, run_starts string, n_chars long")
    got = line_dedup.drop_repeated_lines(frame)
    assert got.columns == frame.columns
    expected = []
    for i, t in docs:
        n, gone, _, kept = want[i, t]
        if gone == 0:
            expected.append(str((i, t, "k", 5)))
        elif gone < n:
            expected.append(str((i, kept, "k", len(kept))))
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(expected)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.report(frame).count() == 0 and line_dedup.drop_repeated_lines(frame).count() == 0


def test_long_runs_of_one_or_two_lines_go(spark):
    def line(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    one, half, other = line("a", 51), line("b", 30), line("c", 21)
    docs = [(1, one + "\nends"), (2, "begins\n " + one + " "), (3, one), (4, half + "\n\n" + other + "\nx"), (5, "y\n" + half + "\n" + other),
            (6, half), (7, line("d", 50)), (8, line("d", 50) + "\nz"), (9, one + "\n" + line("e", 60) + "\n" + one)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(frame).collect()}
    assert got == {1: docs[0][1], 2: "begins", 4: docs[3][1], 5: "y", 6: half, 7: docs[6][1], 8: docs[7][1], 9: line("e", 60)}
    assert sum(r["n_removed"] for r in line_dedup.report(frame).collect()) == 0
