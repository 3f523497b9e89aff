"""Removed bytes against a plain search over all 50-byte strings."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from ledgerscope.llm import substring_dedup


def plain(docs):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            k = b[s:s + 50]
            rank = (i is None, i or 0)
            first[k] = min(first.get(k, rank), rank)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s:s + 50]] < (i is None, i or 0):
                gone[s:s + 50] = b"\x01" * 50
        spans = sum(1 for x in range(len(b)) if gone[x] and (x == 0 or not gone[x - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randrange(8, 60)) for _ in range(8)]
    docs = []
    for i in range(60):
        text = prose(rng.randrange(0, 120))
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, max(1, len(p) - 40))
            text += " " + p[a:a + rng.randrange(30, 200)] + " " + prose(rng.randrange(0, 20))
        docs.append((rng.randrange(1000) * 7 + i % 7, text))
    for _ in range(25):  # near copies
        i, t = rng.choice(docs)
        t = list(t)
        for _ in range(rng.randrange(0, 3)):
            if t:
                t[rng.randrange(len(t))] = "#"
        docs.append((rng.randrange(10_000), "".join(t)))
    docs += [(20_001, "a" * 300), (20_002, "a" * 120), (20_000, "ab" * 100), (20_003, "ab" * 40), (20_004, None), (20_005, ""),
             (20_006, "x" * 49), (20_007, "x" * 50), (20_008, "x" * 50), (20_008, "x" * 50), (None, docs[0][1]), (None, docs[0][1])]
    return docs


@pytest.mark.parametrize("seed, batch_bytes", [(1, 3 << 20), (2, 2000), (3, 600)])
def test_same_as_plain(spark, monkeypatch, seed, batch_bytes):
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", batch_bytes)
    docs = corpus(seed)
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, batch int")
    pack = substring_dedup._packed

    def packed(batches):  # tasks don't see the test's setting otherwise
        substring_dedup.BATCH_BYTES = batch_bytes
        return pack(batches)

    monkeypatch.setattr(substring_dedup, "_packed", packed)
    got = substring_dedup.removals(frame).drop("spans").collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, plain(docs)))


def test_spans_and_empty_table(spark):
    base = "".join(chr(97 + i * i % 23) for i in range(90))
    frame = spark.createDataFrame([(1, base), (2, "12345" + base[:60] + "6789")], "doc_id long, text string")
    rows = {r["doc_id"]: r["spans"] for r in substring_dedup.removals(frame).collect()}
    assert rows == {1: [], 2: [5, 65]}
    assert substring_dedup.removals(frame.limit(0)).count() == 0


def test_answers_reach_every_entry_without_a_search():
    """Entries come in any order of keys and ids; each gets what holds for its key."""
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 40, 300).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ids = rng.integers(-5, 60, 300)
    for buckets in (3, 1 << 17):
        asked = substring_dedup.Question(keys, ids, None, buckets)
        values = rng.integers(0, 2, len(asked.keys)).astype(bool)
        by_key = dict(zip(asked.keys.tolist(), values.tolist()))
        assert asked.looked_up(values).tolist() == [by_key[k] for k in keys.tolist()]
        nothing = np.zeros(len(asked.keys), bool)
        assert asked.earlier(ids, nothing).tolist() == [bool((ids[keys == k] < i).any()) for k, i in zip(keys, ids)]
        assert asked.marks.tolist() == [len(set(ids[keys == k].tolist())) > 1 for k in asked.keys]
        assert sorted(k for _, page, _, _ in asked.pages() for k in np.frombuffer(page, np.uint64).tolist()) == sorted(by_key)
    empty = substring_dedup.Question(keys[:0], ids[:0], None, 8)
    assert not empty.pages() and not len(empty.looked_up(np.zeros(0, bool)))
