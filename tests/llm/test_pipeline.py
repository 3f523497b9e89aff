"""The stages one after the other, each against what it must keep."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from ledgerscope.llm import decontaminate, queries
from ledgerscope.session import pin
from test_near_copies import plain_kept

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, pin(stage(spark, docs, FOLDER), name)
        seen.append((name, before.count(), docs.count()))
        assert docs.columns[:len(columns)] == columns
        if name == "line_dedup":
            assert docs.where("n_chars != length(text)").count() == 0
        if name == "simhash_near_dedup":
            rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
            want = plain_kept([t for _, t in rows])
            assert {r["doc_id"] for r in docs.collect()} == {rows[i][0] for i in want}
        if name == "benchmark_decontamination":
            clean = {r["doc_id"] for r in decontaminate.scan(before, benchmark).where("not contaminated").collect()}
            assert {r["doc_id"] for r in docs.collect()} == clean
    assert docs.columns == [*columns, "mix_slot"] and seen[-1][1] == seen[-1][2]
    assert all(after <= before for _, before, after in seen) and len(corpus_pipeline.STAGES) == 5


def test_every_operator_has_a_query():
    names = queries.plans()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == [*range(1, 14)]
    assert set(queries.statements()) <= set(names)
