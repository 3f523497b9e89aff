"""Fingerprints and matches against plain versions."""

from __future__ import annotations

import hashlib
import random
import re

from ledgerscope.llm import spot_signatures as spots


def plain_set(text):
    """Signatures as text, before hashing."""
    ws = [w for w in re.sub(r"[\W_]+", " ", text.lower()).split(" ") if w]
    out = set()
    for i, w in enumerate(ws):
        if w in spots.ANCHORS:
            content = [x for x in ws[i + 1:i + 1 + spots.REACH] if x not in spots.ANCHORS + spots.COMMON]
            out.add(" ".join([w, *content[:spots.CHAIN]]))
    return out or {" ".join(["*", *ws[i:i + spots.CHAIN]]) for i in range(len(ws))}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(120)] + spots.ANCHORS + spots.COMMON[:20] + ["naïve", "Über"]
    docs = [(i * 3, " ".join(rng.choices(words, k=rng.randrange(1, 150))) + rng.choice(["", ".", "!\n"])) for i in range(70)]
    for i in range(25):
        parts = rng.choice(docs)[1].split(" ")
        parts[rng.randrange(len(parts))] = "swapped"
        docs.append((1000 + i, " ".join(parts)))
    docs += [(2000, None), (2001, ""), (2002, "..."), (2003, docs[0][1]), (2004, "no anchors here at all"), (2005, "the"), (2006, "the word " * 9000), (5000, "é" * 7)]
    return docs


def plain_report(docs):
    order = sorted(docs, key=lambda d: d[0])
    out = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = plain_set(text), plain_set(edited), plain_set(after)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), len(a) * 8, len(b) * 8, round(likeness(a, b), 9), round(likeness(a, c), 9)))
    return out


def test_report_same_as_plain(spark, monkeypatch):
    docs = corpus()
    random.Random(1).shuffle(docs)
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, bucket int")
    for per_bucket in (spots.PER_BUCKET, 9):
        monkeypatch.setattr(spots, "PER_BUCKET", per_bucket)
        rows = spots.report(frame).collect()
        got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], len(r["fingerprint"]), len(r["edited_fingerprint"]), round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows]
        assert sorted(got) == plain_report(docs)
        prints = {r["doc_id"]: r["fingerprint"] for r in rows}
        assert prints[0] == prints[2003] and prints[2001] == ""


def test_nulls_repeats_one_row_and_empty(spark):
    frame = spark.createDataFrame([(None, "the first text"), (4, "the same"), (4, "the same"), (None, None)], "doc_id long, text string")
    rows = spots.report(frame).collect()
    assert len(rows) == 4 and sum(r["doc_id"] == 4 for r in rows) == 2
    one = spots.report(frame.where("doc_id is null and text is not null")).collect()
    assert one[0]["near_next"] == 1.0 and one[0]["near_edited"] <= 1.0
    assert spots.report(frame.limit(0)).count() == 0


def test_matches_same_as_plain(spark):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["query_id"], r["doc_id"]): round(r["likeness"], 9) for r in spots.matches(frame.where("doc_id % 2 = 0"), frame).collect()}

    def classes(rows):
        out = {}
        for i, t in sorted(rows):
            out.setdefault(frozenset(plain_set(t or "")), i)
        return {i: s for s, i in out.items() if s}

    left, right = classes([d for d in docs if d[0] % 2 == 0]), classes(docs)
    want = {(q, d): round(likeness(a, b), 9) for q, a in left.items() for d, b in right.items() if likeness(a, b) >= 0.8}
    assert got == want and len(want) > len(left)
