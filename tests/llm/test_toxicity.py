"""Windows, gradients, held-out accuracy, and odd input."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ledgerscope.llm import toxicity as tox


def corpus(n=700, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    bad = ["grubworm", "blockhead", "nitwit"]
    rows = []
    for i in range(n):
        parts = rng.choices(words, k=rng.randrange(5, 150))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randrange(1, 3)):
                parts.insert(rng.randrange(len(parts)), rng.choice(bad) + rng.choice(["", "!", ","]))
        rows.append((i, " ".join(parts), int(toxic)))
    return rows


def test_windows_overlap_and_cover():
    for n in (0, 1, tox.SPAN - 1, tox.SPAN, tox.SPAN + 1, 5 * tox.SPAN + 3):
        starts, sizes = tox.windows([7, n])
        own = [(s - 7, z) for s, z in zip(starts.tolist(), sizes.tolist()) if s >= 7]
        assert {i for s, z in own for i in range(s, s + z)} == set(range(n))
        assert all(b[0] - a[0] == tox.STRIDE for a, b in zip(own, own[1:]))


def test_gradients_same_as_differences():
    rng = np.random.default_rng(0)
    net = tox._fresh({"aa": 1, "bb": 2}, rng)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    words = ["aa", "bb", "zz"]
    at, mask = rng.integers(0, 3, (6, 4)), np.ones((6, 4), bool)
    mask[4:, 1] = False
    y, weights, seen = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 0.5]), np.zeros(3, bool)

    def loss():
        m = net.forward(net.inputs(words)[0], at, mask)
        return float(((np.logaddexp(0, m) - y * m) * weights).sum() / weights.sum())

    g = net.gradients(words, at, mask, y, weights, seen)
    for name, index in (("Wf", (3, 5)), ("Ub", (1, 20)), ("Bf", (9,)), ("Wa", (2, 1)), ("va", (3,)), ("wo", (4,)), ("bo", (0,)), ("Ew", (1, 2)), ("Ub", (7, 3))):
        old = net.w[name][index]
        sides = []
        for step in (1e-3, -1e-3):
            net.w[name][index] = old + step
            sides.append(loss())
        net.w[name][index] = old
        assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(g[name][index], rel=0.05, abs=2e-4), name


def test_held_out_accuracy_and_rows(spark):
    rows = corpus()
    docs = [(i, t, "en") for i, t, _ in rows] + [(9000, None, "en"), (9001, "", "en"), (9002, "?!", "en"), (9003, "word " * 40_000, "en"), (5, rows[5][1], "en"), (None, rows[4][1], "en")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows] + [(0, 1, 1), (8888, 1, 1)], "doc_id long, quality int, toxic int")
    got = tox.score(frame, labels).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[9000]["score"] == by_id[9001]["score"] == by_id[9002]["score"] == 0.0 and by_id[None]["held_out"] is False
    kept = tox.drop_toxic(frame, labels)
    assert kept.columns == frame.columns and kept.count() == sum(r["score"] < 0.5 for r in got)


def test_without_labels_or_rows(spark):
    frame = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in tox.score(frame, labels).collect()] == [0.0]
    assert tox.score(frame.limit(0), labels).count() == 0


def test_fit_has_whole_texts_and_long_clean_documents_stay_clean(spark):
    rng = random.Random(4)
    rows = corpus()
    plain = sorted({w for _, t, y in rows if not y for w in t.split()})
    # toxic words only far behind, and clean documents as long
    far = [(2000 + i, " ".join([*rng.choices(plain, k=2500), "numbskull", *rng.choices(plain, k=20)]), 1) for i in range(30)]
    long = [(3000 + i, " ".join(rng.choices(plain, k=2500)), 0) for i in range(60)]
    rows += far + long
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    texts = {t for t, _ in tox.sample(frame, labels)}
    learned = [t for i, t, _ in far + long if t in texts]
    assert len(learned) > 60 and sum("numbskull" in t for t in learned) > 15
    got = {r["doc_id"]: r for r in tox.score(frame, labels).collect()}
    assert np.mean([got[i]["predicted"] for i, _, _ in long]) < 0.1
    assert np.mean([got[i]["predicted"] for i, _, _ in far]) > 0.9
