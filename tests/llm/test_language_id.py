"""The forward algorithm against a listing of all segmentations; held-out accuracy; odd input."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from ledgerscope.llm import language_id as lid


def all_segmentations(word: bytes, p: dict[bytes, float]) -> float:
    if not word:
        return 1.0
    return sum(p[word[:n]] * all_segmentations(word[n:], p) for n in range(1, len(word) + 1) if word[:n] in p)


def test_forward_sums_all_segmentations():
    pieces = sorted({bytes([b]) for b in range(256)} | {b" a", b"ab", b"abc", b" ab", b"bc", b"ca", b" abcab"})
    model = lid.train(["abc ab ca abcab", "bca cab bb", ""], ["x", "y", "y"], pieces, rounds=2)
    assert model.p[:-1].sum(axis=0) == pytest.approx([1, 1])
    words = ["abc", "ab", "b", "cabcabc", "zé", "abcé" * 5]
    logs = model.log_words(words)
    for k in range(2):
        p = dict(zip(pieces, model.p[:-1, k]))
        for i, word in enumerate(words):
            want = math.log(all_segmentations(b" " + word.encode(), p))
            assert logs[i, k] == pytest.approx(want) and model.log_long(b" " + word.encode())[k] == pytest.approx(want)


def test_long_words_are_summed_whole(monkeypatch):
    """A plain forward pass in logarithms over a word of many blocks, with pieces that lie across their bounds."""
    pieces = sorted({bytes([b]) for b in range(256)} | {b" a", b"ab", b"abcabc", b"bcabcabca", "é".encode(), b"x" * 20})
    model = lid.train(["abcabcabca " * 9, "é ab xxxx " * 7], ["x", "y"], pieces, rounds=3)
    raw = b" " + ("abcabcé" * 40 + "x" * 90).encode()
    want = []
    for k in range(2):
        p, sums = dict(zip(pieces, model.p[:-1, k])), [0.0]
        for end in range(1, len(raw) + 1):
            terms = [sums[end - n] + math.log(p[raw[end - n:end]]) for n in range(1, min(20, end) + 1) if p.get(raw[end - n:end])]
            top = max(terms)
            sums.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        want.append(sums[-1])
    assert model.log_long(raw) == pytest.approx(want)
    monkeypatch.setattr(lid, "BLOCK", 37)
    assert model.log_long(raw) == pytest.approx(want)


def test_letters_are_those_of_unicode():
    assert lid.has_letter("é") and lid.has_letter("1 ª") and not lid.has_letter("²½① 3_!") and not lid.has_letter(None)


def test_sample_is_the_smallest_hashes(spark):
    rows = [(i, "w", "aa" if i % 3 else "bb") for i in range(900)] + [(5, "w2", "aa"), (None, "w", "aa")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r["id"], r["language"]) for r in lid.sample(frame, 20).collect()}
    from pyspark.sql import functions as F
    placed = {r["doc_id"]: r["h"] for r in frame.where("doc_id is not null").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("h")).collect()}
    for lang in ("aa", "bb"):
        mine = sorted({(placed[i], i) for i, _, x in rows if i is not None and x == lang and zlib.crc32(str(i).encode()) % 5})
        assert {i for i, x in got if x == lang} == {i for _, i in mine[:20]}


def test_rounds_raise_the_likelihood():
    pieces = sorted({bytes([b]) for b in range(256)} | {b" the", b"he", b"re", b"th"})
    texts = ["the there other here three " * 5]
    totals = [lid.train(texts, ["en"], pieces, rounds=n).log_words(lid.words_of(texts[0])).sum() for n in (1, 2, 4)]
    assert totals[0] <= totals[1] <= totals[2]


def test_held_out_accuracy_and_rows(spark):
    rng = random.Random(4)
    parts = {"aa": ["the", "ing", "tion", "and"], "bb": ["der", "sch", "ung", "und"], "cc": ["que", "ción", "los", "ñe"]}
    rows = []
    for i in range(240):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 40))), lang))
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "123 !?", "cc"), (903, "sch" * 30_000, "bb"), (904, "the and", None), (None, "und der", "bb"), (3, rows[3][1], rows[3][2])]
    frame = spark.createDataFrame([(*r, 0.5) for r in rows + odd], "doc_id long, text string, lang string, score double")
    got = lid.identify(frame).collect()
    assert len(got) == len(rows + odd)
    truth = {i: x for i, _, x in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert by_id[900] == by_id[901] == by_id[902] == ("und", 0.0) and by_id[903][0] == "bb" and by_id[904][0] == "aa"


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in lid.identify(frame).collect()] == [("und", 0.0)]
    assert lid.identify(frame.limit(0)).count() == 0
