"""The mixture against a slot-by-slot earliest-deadline-first schedule, and its deviation from the fluid mixture."""

from __future__ import annotations

from fractions import Fraction

import pytest

from ledgerscope.llm import mixing


def fluid(parts, blocks, key, j):
    """Slots after which the fluid mixture has done j blocks of a source."""
    v = Fraction(j, parts[key])
    return sum(min(parts[k] * v, Fraction(blocks[k])) for k in parts)


def plain(parts, blocks):
    """Every block of every source in the slot that one sequential scheduler gives it."""
    done, order = dict.fromkeys(parts, 0), []
    for t in range(sum(blocks.values())):
        due = [(-(-fluid(parts, blocks, k, done[k] + 1) // 1), k) for k in parts
               if done[k] < blocks[k] and fluid(parts, blocks, k, done[k]) // 1 <= t]
        key = min(due)[1]
        order.append((key, done[key]))
        done[key] += 1
    return order


@pytest.mark.parametrize("parts, blocks", [
    ({"a": 3, "b": 2, "c": 1}, {"a": 20, "b": 5, "c": 9}),
    ({"a": 60, "b": 30, "c": 10, "d": 1}, {"a": 7, "b": 31, "c": 64, "d": 2}),
    ({"a": 1}, {"a": 4}),
    ({"a": 7, "b": 7, "c": 7, "d": 7, "e": 2}, {"a": 70, "b": 3, "c": 14, "d": 15, "e": 40}),
])
def test_same_as_sequential_and_within_a_block(spark, parts, blocks):
    sources = spark.createDataFrame([(k, parts[k], blocks[k]) for k in parts], "key string, parts long, blocks long")
    wanted = spark.createDataFrame([(k, j) for k in blocks for j in range(blocks[k])], "key string, block long")
    rows = sorted(mixing.block_slots(sources, wanted).collect(), key=lambda r: r["slot"])
    total = sum(blocks.values())
    assert [r["slot"] for r in rows] == list(range(total))
    order = plain(parts, blocks)
    done = dict.fromkeys(parts, 0)
    for t, r in enumerate(rows):
        assert r["release"] <= t < r["deadline"]
        done[r["key"]] += 1
        assert r["block"] == done[r["key"]] - 1
        for k in parts:  # less than one block ahead or behind after every slot
            assert fluid(parts, blocks, k, done[k] - 1) < t + 1 or done[k] == 0
            assert done[k] == blocks[k] or fluid(parts, blocks, k, done[k] + 1) > t + 1
    assert [(r["key"], r["block"]) for r in rows] == order


def test_rows_stay_whole(spark):
    rows = [(i, "x" * (i * 37 % 90), "big" if i % 3 else f"s{i % 4}") for i in range(200)]
    rows += [(200, None, None), (201, "", "s1"), (5, "dup", "big"), (5, "dup", "big"), (None, "no id", "s2"), (300, "y" * 5000, "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    parts = spark.createDataFrame([("big", 5), ("s1", 2), (None, 1)], "source string, parts long")
    got = mixing.slots(docs, parts, block_chars=100).collect()
    assert sorted(str((r["doc_id"], r["source"])) for r in got) == sorted(str((i, s)) for i, _, s in rows)
    per_slot = {}
    for r in got:
        per_slot.setdefault(r["slot"], set()).add((r["key"], r["block"]))
    assert all(len(v) == 1 for v in per_slot.values())
    wide = docs.selectExpr("*", "1 as mix_slot", "2 as slot")
    mixed = mixing.mixed(wide, parts, block_chars=100)
    assert mixed.columns == [*wide.columns, "_mix_slot"] and mixed.count() == len(rows)


def test_default_parts_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a" * 100, "x"), (2, "b", "y"), (3, None, "z")], "doc_id long, text string, source string")
    parts = {r["key"]: r["parts"] for r in mixing.tempered_parts(mixing._sized(docs)).collect()}
    assert parts["+x"] > parts["+y"] >= 1 and parts["+z"] == 1
    assert mixing.slots(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
    assert {r["slot"] for r in mixing.slots(docs).collect()} == {0, 1, 2}
