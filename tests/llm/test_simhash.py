"""Fingerprints and components against a plain all-pairs version."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from ledgerscope.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_print(text):
    words = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reachable, by repeated relaxation over all pairs."""
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if label[b] > label[a] and bin(prints[a] ^ prints[b]).count("1") <= 3:
                    label[b], changed = label[a], True
    return label


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 400))) for _ in range(n)]
    for i in range(n // 2):
        parts = rng.choice(texts).split(" ")
        parts[rng.randrange(len(parts))] = "changed"
        texts.append("\t".join(parts) if i % 2 else " ".join(parts))
    texts += ["", None, " \n ", "one", "one two", "x y z " * 5000, "x y z " * 5001, texts[0], texts[0]]
    return texts


def test_same_as_plain(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    rows = simhash.components(docs).collect()
    prints = {i: plain_print(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == plain_components(prints)


@pytest.mark.parametrize("probe_from", [2, 10_000])
def test_spanning_links_connect_what_distance_connects(probe_from):
    rng = np.random.default_rng(3)
    positions = simhash._POSITIONS[17]
    free = [p for p in range(8) if p not in positions]
    members = {0}
    while len(members) < 150:  # drifting values, so that chains form
        x = list(members)[rng.integers(len(members))]
        for _ in range(rng.integers(1, 6)):
            x ^= 1 << int(8 * free[rng.integers(3)] + rng.integers(8))
        members.add(x)
    values = np.array([v - (1 << 64) if v >> 63 else v for v in sorted(members)], np.int64)
    children, roots = simhash.spanning_links(values, positions, probe_from)
    root = {int(v): int(v) for v in values} | {int(c): int(r) for c, r in zip(children, roots)}
    label = plain_components({i: int(v) & (1 << 64) - 1 for i, v in enumerate(values)})
    groups = {}
    for i, v in enumerate(values):
        groups.setdefault(label[i], set()).add(root[int(v)])
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_drop_keeps_one_of_each_group_and_extra_columns(spark):
    base = " ".join(f"t{i}" for i in range(200))
    rows = [(3, base, 1), (1, base, 2), (1, base, 2), (None, base, 3), (7, "other text here", 4), (None, None, 5), (9, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `text_hash` int")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text_hash"]) for r in kept.collect()) == [(1, 2), (7, 4), (9, 6)]


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.components(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0
    rows = simhash.components(spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["component_id"]) for r in rows] == [(None, None)]
