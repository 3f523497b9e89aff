"""Point-in-time features: micro cases, a row-by-row replay, and independence from the future."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import features as f

T = 1_600_000_000


def collect(df, key="transaction_id"):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def three(ledger):
    """Three payments: alice to bob and carol, alice again after 30 s, bob to dave after 300 s."""
    rows = [("t1", T, [("alice", 100_000_000)], [("bob", 50_000_000, False), ("carol", 49_990_000, False)]),
            ("t2", T + 30, [("alice", 30_000_000)], [("dave", 20_000_000, False), ("alice", 9_990_000, True)]),
            ("t3", T + 300, [("bob", 50_000_000)], [("dave", 49_000_000, False)])]
    events = [("e1", "t1", T, "1.1.1.1", 5000, "2.2.2.2", 8333, "US", 10), ("e2", "t2", T + 29, "1.1.1.2", 5001, "2.2.2.2", 18333, "DE", None),
              ("e2b", "t2", T + 99, "9.9.9.9", 1, "2.2.2.2", 8333, "DE", 5), ("e3", "t3", T + 300, "1.1.1.1", 5002, "2.2.2.2", None, None, 30)]
    return ledger(rows, events)


def test_micro_case(three):
    m = collect(f.feature_matrix(three))
    assert m["t2"]["addr_hist_tx_count"] == 1
    assert m["t2"]["addr_hist_total_sent_sats"] == 99_990_000
    assert m["t2"]["addr_reuse_count"] == 1
    assert m["t2"]["addr_hist_unique_counterparties"] == 2
    assert m["t2"]["time_since_prev_global_tx_sec"] == 30
    assert (m["t2"]["time_txs_last_1m"], m["t2"]["time_since_prev_addr_tx_sec"]) == (1, 30)
    assert (m["t3"]["time_txs_last_1m"], m["t3"]["time_txs_last_5m"]) == (0, 2)
    assert m["t3"]["time_since_prev_global_tx_sec"] == 270
    assert m["t3"]["addr_hist_tx_count"] == 0
    assert m["t3"]["addr_hist_total_received_sats"] == 49_995_000
    assert m["t3"]["addr_hist_active_days"] == 0 and m["t3"]["time_since_prev_addr_tx_sec"] == 86400
    assert m["t2"]["net_is_standard_bitcoin_port"] == 0 and m["t2"]["net_src_port"] == 5001
    assert m["t2"]["net_hist_unique_ips_for_addr"] == 1
    assert m["t3"]["net_dst_port"] == 8333 and m["t3"]["net_country"] == "UNKNOWN"
    assert m["t2"]["rel_has_change_output"] == 1
    assert m["t2"]["rel_change_value_ratio"] == pytest.approx(9_990_000 / 29_990_000)
    assert m["t1"]["time_since_prev_global_tx_sec"] == 0


@pytest.mark.parametrize("seed", [1, 4])
def test_timeline_is_the_same_however_addresses_are_cut(ledger, random_rows, monkeypatch, seed):
    from ledgerscope.functions import ordering
    t = ledger(random_rows(seed))
    args = (t["transactions"], t["transaction_inputs"], t["transaction_outputs"])
    rows = lambda: sorted(map(str, f.address_timeline(*args).collect()))
    whole = rows()
    monkeypatch.setattr(ordering, "CROWD", 4)
    assert rows() == whole


def replay(rows):
    """The defining loop: read an address's history, then add the transaction."""
    seen, count, sent, received, partners, last = {}, {}, {}, {}, {}, {}
    out = {}
    for txid, ts, inputs, outputs in sorted(rows, key=lambda r: (r[1], r[0])):
        sender = inputs[0][0] if inputs else f"none-{txid}"
        total, people = sum(v for _, v, _ in outputs), {a for a, _, _ in outputs}
        n = count.get(sender, 0)
        days = max(0.0, (ts - seen.get(sender, ts)) / 86400) if n else 0.0
        out[txid] = (n, sent.get(sender, 0), received.get(sender, 0), len(partners.get(sender, ())), days,
                     float(ts - last[sender]) if sender in last else 86400.0)
        seen.setdefault(sender, ts)
        count[sender], sent[sender], last[sender] = n + 1, sent.get(sender, 0) + total, ts
        partners.setdefault(sender, set()).update(people)
        for p in people:
            seen.setdefault(p, ts)
            received[p] = received.get(p, 0) + total // len(people)
            partners.setdefault(p, set()).add(sender)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_history_equals_replay(ledger, random_rows, seed):
    rows = random_rows(seed, 60)
    t = ledger(rows)
    tl = f.address_timeline(t["transactions"], t["transaction_inputs"], t["transaction_outputs"])
    got = collect(f.address_features(tl).join(f.sender_pacing(tl), "transaction_id"))
    want = replay(rows)
    assert len(got) == len(rows)
    for txid, (n, sent, recv, cps, days, gap) in want.items():
        g = got[txid]
        assert (g["addr_hist_tx_count"], g["addr_hist_total_sent_sats"], g["addr_hist_total_received_sats"],
                g["addr_hist_unique_counterparties"], g["time_since_prev_addr_tx_sec"]) == (n, sent, recv, cps, gap), txid
        assert g["addr_hist_active_days"] == pytest.approx(days)


@pytest.mark.parametrize("seed,cut", [(4, 15), (5, 33)])
def test_prefix_features_do_not_change(ledger, random_rows, seed, cut):
    rows = sorted(random_rows(seed, 45), key=lambda r: (r[1], r[0]))
    events = [(f"e{i}", r[0], r[1], f"1.1.1.{i % 7}", 1, "2.2.2.2", 8333, "US", 1) for i, r in enumerate(rows)]
    whole = collect(f.feature_matrix(ledger(rows, events)))
    part = collect(f.feature_matrix(ledger(rows[:cut], events[:cut])))
    assert len(part) == cut
    for txid, values in part.items():
        assert values == whole[txid]


def test_velocity_counts(ledger, random_rows):
    rows = random_rows(6, 80)
    t = ledger(rows)["transactions"]
    got = {r["timestamp_epoch_sec"]: r.asDict() for r in f.second_velocity(t).collect()}
    times = [r[1] for r in rows]
    for ts, g in got.items():
        for name, w in f.VELOCITY_WINDOWS.items():
            assert g[name] == sum(ts - w <= x < ts for x in times)
        assert g["prev_second"] == max((x for x in times if x < ts), default=None)


def test_split_boundaries(spark):
    df = spark.range(200).select(F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("transaction_id"),
                                 (F.col("id") / 3).cast("bigint").alias("timestamp_epoch_sec"))
    got = [r["temporal_split"] for r in f.chronological_split(df).orderBy("timestamp_epoch_sec", "transaction_id").collect()]
    assert got == ["train"] * 140 + ["val"] * 30 + ["test"] * 30


@pytest.mark.parametrize("names", [["rel_fan_in", "net_asn", "net_country"], ["time_txs_last_1m", "rel_fan_out", "net_dst_port", "tx_fee_sats"], ["addr_reuse_count", "tx_log_fee"]])
def test_columns_alone_equal_those_of_the_matrix(three, names):
    whole = f.feature_matrix(three).select("transaction_id", *names)
    alone = f.feature_columns(three, names)
    assert alone.dtypes == whole.dtypes and collect(alone) == collect(whole)


def test_alert_columns_come_without_the_address_timeline(three, monkeypatch):
    def unasked(*_):
        raise AssertionError("no alert column comes from the timeline")

    for step in ("address_timeline", "network_history"):
        monkeypatch.setattr(f, step, unasked)
    from ledgerscope.plans.bench import ALERT_FEATURES
    assert {"rel_fan_in", "net_src_port", "time_txs_last_5m"} <= set(ALERT_FEATURES)
    assert f.feature_columns(three, ALERT_FEATURES).count() == 3


def test_tables_that_no_column_comes_from_are_not_asked_for(three):
    assert f.feature_columns({n: three[n] for n in three if n != "transaction_outputs"}, ["rel_fan_in", "net_asn"]).count() == 3
