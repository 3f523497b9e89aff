"""Word windows found by shift tables against a plain scan of every position."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from ledgerscope.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(text, items):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hit, owners = set(), set()
    for item, body in items:
        own = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in body or ""))
        size = min(13, len(own))
        windows = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i:i + size]) in windows:
                hit.update(range(i, i + size))
                owners.add(str(item) if item is not None else "null")
    return (len(words), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(),
            bool(hit) and 20 * len(hit) >= len(words))


def tables(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of", "a", "Über", "x1", "42", "naïve", "end"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 40)))) for i in range(30)]
    items += [(30, "Solo"), (31, "two words"), (32, None), (33, ""), (None, "null id item of four"), (2, items[2][1]), (34, "of, OF; of of")]
    docs = []
    for i in range(80):
        parts = rng.choices(vocabulary, k=rng.randrange(0, 120))
        if i % 2:
            body = items[rng.randrange(30)][1].split(" ")
            at = rng.randrange(len(body))
            parts[5:5] = body[at:at + rng.randrange(5, 30)]
        docs.append((i, "-".join(parts) if i % 5 == 0 else " ".join(parts).upper()))
    docs += [(80, None), (81, ""), (82, "solo " * 50), (83, "Solo\x00two\x7fwords"), (84, "of " * 30_000), (84, "of " * 30_000), (None, "null id item of four")]
    return (items, docs, spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(items, "item_id long, text string"))


@pytest.mark.parametrize("block_chars", [decontaminate.BLOCK_CHARS, 200])
def test_same_as_plain(spark, block_chars):
    items, docs, frame, benchmark = tables(spark)
    rows = decontaminate.scan(frame, benchmark, block_chars).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(str((i, *plain(t, items))) for i, t in docs)


@pytest.mark.parametrize("block_chars", [decontaminate.BLOCK_CHARS, 200])
def test_drop_keeps_clean_rows_whole(spark, block_chars):
    items, docs, frame, benchmark = tables(spark)
    from pyspark.sql import functions as F
    wide = frame.withColumn("contaminated", F.lit("x")).withColumn("bad_id", F.lit(1))
    kept = decontaminate.drop_contaminated(wide, benchmark, block_chars)
    assert kept.columns == wide.columns
    assert sorted(map(str, (tuple(r)[:2] for r in kept.collect()))) == sorted(str((i, t)) for i, t in docs if not plain(t, items)[4])


def test_empty_tables(spark):
    items, docs, frame, benchmark = tables(spark)
    assert decontaminate.scan(frame.limit(0), benchmark).count() == 0
    assert decontaminate.scan(frame, benchmark.limit(0)).where("n_hit > 0 or contaminated").count() == 0


@pytest.mark.parametrize("block_chars", [decontaminate.BLOCK_CHARS, 20])
def test_item_ids_with_commas_and_empty_ids(spark, block_chars):
    items = [("a,b", "one two three"), ("", "four five six"), ("a", "seven eight nine"), ("b", "one two three"), (None, "ten")]
    docs = [(1, "one two three"), (2, "four five six"), (3, "one two three four five six seven eight nine ten"), (4, "none")]
    got = decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), block_chars)
    assert sorted(map(tuple, got.collect())) == sorted((i, *plain(t, items)) for i, t in docs)
