"""The near-dedup stage against brute-force Jaccard similarity over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ledgerscope.llm import near_copies, simhash


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_kept(texts):
    """Smallest id of every component over all pairs at 0.8 or more."""
    sets = [plain_set(t) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i for i in range(len(texts)) if root(i) == i}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    same = " ".join(rng.choices(words, k=12))
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 300))) for _ in range(40)]
    texts += [same + " " + " ".join(rng.choices(words, k=30)) for _ in range(20)]
    for _ in range(120):  # copies of copies, some of them below the similarity
        parts = rng.choice(texts).split(" ")
        for _ in range(rng.randrange(1, 5)):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        texts.append(" ".join(parts[rng.randrange(3):]) or "none")
    base = rng.choices(words, k=90)
    texts += [" ".join([*base[:i], "x", *base[i:]]) for i in range(60)]
    return texts + ["", None, " ", "one", "one two", "One\ttwo", "x y z " * 3000]


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_same_as_brute_force(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == plain_kept(texts)
    assert len(kept) < len({r["component_id"] for r in simhash.components(docs).collect()})


def test_any_order_of_shingles_gives_the_same(spark, monkeypatch):
    texts = corpus(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_copies, "SAMPLED", 1)
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()} == plain_kept(texts)


def test_sketches_never_rule_out_similar_sets():
    rng, tight = random.Random(4), 0
    for _ in range(3000):
        n = rng.choice([1, 3, 10, 60, 64, 65, 200, 1000])
        a = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
        gone = rng.randrange(0, max(1, int(0.35 * n)))
        b = np.unique(np.concatenate([a[gone:], np.array([rng.getrandbits(64) for _ in range(rng.randrange(0, max(1, int(0.3 * n))))], np.uint64)]))
        possible = near_copies.may_be_similar(near_copies.sketch(a), len(a), near_copies.sketch(b), len(b))
        assert possible or not near_copies.similar(a, b)
        tight += not possible
    assert tight > 100


def test_posting_over_many_batches(spark):
    """A posting that spans Arrow batches comes out whole, and so do its neighbours."""
    rows = [(s, k, 10, 0) for s, size in ((1, 3), (2, 5000), (3, 1), (4, 2)) for k in range(size)]
    frame = spark.createDataFrame(rows, near_copies._POSTINGS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = near_copies._by_posting(frame, "u long, v long", lambda shingle, key, n, place: [(shingle[:1], np.array([len(key)]))]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == [(1, 3), (2, 5000), (4, 2)]


def test_simhash_links_are_the_first_candidates(spark, monkeypatch):
    texts = corpus(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    named = near_copies.classes(docs)
    pairs = {(r["u"], r["v"]) for r in simhash.linked_sets(docs, named).collect()}
    keys = {r["doc_id"]: r["set_key"] for r in named.collect()}
    label = {k: k for k in keys.values()}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for u, v in pairs:
        assert u < v
        label[max(root(u), root(v))] = min(root(u), root(v))
    prints = [int.from_bytes(simhash.fingerprint((t or "").encode()), "big") for t in texts]
    found = 0
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= simhash.MAX_BITS:
                assert root(keys[i]) == root(keys[j])
                found += keys[i] != keys[j]
    assert found and pairs
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda prints: asked.append(1) or links(prints))
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()} == plain_kept(texts)
    assert asked
