"""Distributed order statistics against plain NumPy and Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope.functions import ordering
from ledgerscope.functions.ordering import chronological_index, exact_percentiles, global_positions, prefix_totals, running_before, value_bucket
from ledgerscope.operators.clean import running_child_index


@pytest.mark.parametrize("seed", [1, 2])
def test_percentiles_equal_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    groups = {"normal": rng.normal(0, 5, 301), "heavy": rng.pareto(1.1, 250) * 1e6, "ties": rng.integers(0, 3, 400).astype(float),
              "hot": np.concatenate([np.full(500, 7.0), rng.normal(7, 1e-4, 77)]), "one": np.array([3.25])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    probs = {"min": 0.0, "p25": 0.25, "median": 0.5, "p95": 0.95, "max": 1.0}
    got = exact_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", probs).toPandas().set_index("g")
    for name, values in groups.items():
        for column, p in probs.items():
            assert got.loc[name, column] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


def _shuffled_rows(spark, run):
    """How many rows the stages of ``run`` write to shuffles, and its result."""
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    last = max(stages(), default=-1)
    result = run()
    return sum(n for stage, n in stages().items() if stage > last), result


def test_percentiles_shuffle_a_histogram_and_few_values(spark):
    n = 30_000
    df = spark.range(n, numPartitions=2).select(F.lit("x").alias("g"), (F.col("id") * 7919 % n / 8).alias("v"))
    rows, got = _shuffled_rows(spark, lambda: exact_percentiles(df, ["g"], "v", {"p25": 0.25, "median": 0.5}).collect())
    want = np.quantile(np.arange(n) / 8, [0.25, 0.5])
    assert (got[0]["p25"], got[0]["median"]) == pytest.approx(tuple(want), rel=1e-12)
    assert rows < 2 * n


def test_child_index_shuffles_rows_once_and_cuts_crowded_transactions(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CROWD", 500)
    rng = random.Random(13)
    rows = [("hot" if i % 3 == 0 else f"t{i % 500}", f"a{rng.randrange(9)}-{i}", rng.randrange(50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "transaction_id string, address string, value bigint").repartition(3, "transaction_id")
    df.cache().count()
    written, got = _shuffled_rows(spark, lambda: running_child_index(df, "output", ["value", "address"]).collect())
    df.unpersist()
    assert len(got) == len(rows)
    for t in {t for t, _, _ in rows}:
        own = sorted((r["value"], r["address"], r["output_index"]) for r in got if r["transaction_id"] == t)
        assert [i for _, _, i in own] == list(range(len(own))), t
    monkeypatch.setattr(ordering, "CROWD", 5000)
    written, again = _shuffled_rows(spark, lambda: running_child_index(df, "output", ["value", "address"]).collect())
    assert sorted(map(str, again)) == sorted(map(str, got)) and written < 3 * len(rows)


def test_value_bucket_never_decreases(spark):
    rng = random.Random(3)
    values = sorted([0.0, -0.5, 1.0, 2.0, 4.0, 1e-9, -1e9] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-8, 12) for _ in range(2000)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    buckets = [r["b"] for r in df.select("i", value_bucket(F.col("v")).alias("b")).orderBy("i").collect()]
    assert buckets == sorted(buckets)


def test_running_before_splits_a_hot_key(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.randrange(0, 400), i, rng.randrange(100)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint, v bigint")
    got = running_before(df, ["k"], F.floor(F.col("t") / 10), ["t", "i"], sums={"s": "v"}, mins={"lo": "v"}, maxs={"hi": "v"}).collect()
    for r in got:
        before = [v for k, t, i, v in rows if k == r["k"] and (t, i) < (r["t"], r["i"])]
        assert r["s"] == sum(before)
        assert r["lo"] == (min(before) if before else None)
        assert r["hi"] == (max(before) if before else None)


def test_running_before_cuts_only_crowded_keys_and_shuffles_rows_once(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CROWD", 100)
    rng = random.Random(11)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}", rng.randrange(0, 400), i, rng.randrange(100)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint, v bigint")
    crowd = ordering.crowded(df, ["k"])
    assert [r["k"] for r in crowd.collect()] == ["hot"]
    bucket, order, wanted = F.floor(F.col("t") / 10), ["t", "i"], {"sums": {"s": "v"}, "mins": {"lo": "v"}, "maxs": {"hi": "v"}}
    cut = ordering.pieces(df, ["k"], bucket, crowd)
    assert {(r["k"] == "hot", r["_b"] is not None) for r in cut.collect()} == {(True, True), (False, False)}
    assert ordering.piece_starts(cut, ["k"], **wanted).select("k").distinct().count() == 1
    got = running_before(df, ["k"], bucket, order, **wanted).collect()
    assert len(got) == len(rows)
    for r in got:
        before = [v for k, t, i, v in rows if k == r["k"] and (t, i) < (r["t"], r["i"])]
        assert (r["s"], r["lo"], r["hi"]) == (sum(before), min(before, default=None), max(before, default=None))


def test_prefix_totals_and_index(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(0, 9000), f"{rng.randrange(16 ** 4):04x}-{i}", rng.randrange(10)) for i in range(500)]
    rows += [(4321, f"{rng.randrange(16 ** 4):04x}+{i}", 1) for i in range(300)]  # one second holds over a third
    df = spark.createDataFrame(rows, "ts bigint, id string, v bigint")
    order = sorted((ts, i) for ts, i, _ in rows)
    got = {r["id"]: r["position"] for r in chronological_index(df, "ts", "id").collect()}
    assert [got[i] for _, i in order] == list(range(len(rows)))
    totals = prefix_totals(df, F.floor(F.col("ts") / 3600), F.struct("ts", F.substring("id", 1, 1)), ["ts", "id"], ["v"]).collect()
    for r in totals:
        assert r["before_v"] == sum(v for ts, i, v in rows if (ts, i) < (r["ts"], r["id"]))


def test_positions_of_one_second_and_one_prefix_use_all_tasks(spark, monkeypatch):
    rng = random.Random(9)
    ids = [f"same-prefix-{rng.randrange(16 ** 8):08x}-{i}" for i in range(4000)]
    df = spark.createDataFrame([(77, i) for i in ids], "ts bigint, id string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        dealt = []
        plain = ordering.pin
        monkeypatch.setattr(ordering, "pin", lambda frame, label: dealt.append(plain(frame, label)) or dealt[0])
        rows = global_positions(df, ["ts", "id"], "at").collect()
        sizes = [r["count"] for r in dealt[0].groupBy(F.shiftright("_line", 33)).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert [r["id"] for r in sorted(rows, key=lambda r: r["at"])] == sorted(ids) and {r["at"] for r in rows} == set(range(4000))
    assert len(sizes) == 6 and max(sizes) < 2 * min(sizes) + 200
