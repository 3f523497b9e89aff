"""The stored bench tables against the cleaning and normalisation of the raw frames."""

from __future__ import annotations

import datetime as dt
from collections import Counter

from ledgerscope.sources import bench_tables


def _odd_tables(spark, folder):
    """Keys without partner, null keys and attributes, repeated and contradicting rows."""
    day = lambda n: dt.datetime(1996, 1, 1) + dt.timedelta(days=n)
    orders = [(k, 100 + k % 5, day(k % 3), "1-URGENT" if k % 2 else "5-LOW") for k in range(0, 200)]
    orders += orders[:20]
    orders += [(k, 7 + 60 * (k % 3), day(k % 4), "1-URGENT" if k % 3 else None) for k in range(90, 110)]
    orders += [(k, 1, day(1), "5-LOW") for k in range(95, 105)] + [(k, 12, day(1), "1-URGENT") for k in range(95, 105)]
    orders += [(None, 3, day(0), "5-LOW"), (150, None, day(2), "1-URGENT"), (151, 9, None, "5-LOW"), (97, None, day(0), "1-URGENT")]
    lines = [(k, k * 7 + i, i % 3, i % 3 + 1, float(i), 10.0 * k + i / 3, 0.1 * (i % 2), 0.0, "R" if (k + i) % 3 == 0 else "N", "O", day(i))
             for k in range(20, 230) for i in range(k % 5)]
    lines += lines[:30] + [(None, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, "R", "O", day(0)), (30, None, 1, 1, 1.0, None, 0.0, 0.0, None, "O", None),
                           (31, 5, 1, 1, 1.0, 4.0, 0.0, 0.0, "R", "F", day(9)), (31, 5, 1, 1, 1.0, 4.0, 0.0, 0.0, "R", "O", day(8))]
    events = [(e, e % 13, "error" if e % 4 == 0 else "view") for e in range(0, 260)]
    events += [(e, e % 17, "view") for e in range(90, 120)] + events[:9] + [(None, 1, "view"), (60, None, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                 "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(f"{folder}/events.parquet")


def test_stored_tables_are_the_cleaned_raw_tables(spark, tmp_path):
    folder = str(tmp_path)
    _odd_tables(spark, folder)
    want, stored = bench_tables.canonical_tables(spark, folder), bench_tables.stored_tables(spark, folder)
    assert set(stored) == set(want)
    for name, df in want.items():
        assert [(f.name, f.dataType) for f in stored[name].schema] == [(f.name, f.dataType) for f in df.schema], name
        found, rows = (Counter(map(tuple, d.collect())) for d in (stored[name], df))
        assert found == rows and rows, (name, list((found - rows).items())[:3], list((rows - found).items())[:3])


def test_short_ids_keep_the_order_and_turn_into_full_ones(spark, tmp_path):
    folder = str(tmp_path)
    _odd_tables(spark, folder)
    stored = bench_tables.stored_tables(spark, folder)
    order = lambda t: t["transactions"].orderBy("timestamp_epoch_sec", "transaction_id")
    short = [r[0] for r in order(stored.short()).collect()]
    assert [r[0] for r in bench_tables.full_ids(order(stored.short())).collect()] == [r[0] for r in order(stored).collect()]
    assert short == sorted(short)
    for name in stored:
        key = "entity_id" if name == "results" else "transaction_id"
        given = [c for c in stored[name].columns if c not in ("input_id", "output_id")]
        full = bench_tables.full_ids(stored.short()[name], key).select(given)
        assert Counter(map(tuple, full.collect())) == Counter(map(tuple, stored[name].select(given).collect())), name


def test_only_what_is_asked_for_is_written(spark, tmp_path):
    folder = str(tmp_path)
    _odd_tables(spark, folder)
    stored = bench_tables.stored_tables(spark, folder)
    assert stored["results"].count() == 2 * stored["labels"].count()
    assert set(stored._written) == {"orders"}
