"""Alert rules, grouping, idempotency, life cycle; listings and their filters."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import alerts as al, query as q


@pytest.fixture(scope="module")
def run(spark):
    """Three scored transactions: two in one cluster, one quiet but on an odd port."""
    results = spark.createDataFrame(
        [("t1", 0.85, "critical", "mixing_like", 0.9), ("t2", 0.75, "critical", "normal", 0.9), ("t3", 0.15, "low", "normal", 0.9)],
        "entity_id string, risk_score double, risk_level string, prediction_label string, confidence double").select(
        "*", F.lit("an").alias("analysis_id"), F.lit("transaction").alias("entity_type"), F.lit("2026-01-02").cast("timestamp").alias("predicted_at"))
    features = spark.createDataFrame(
        [("t1", 0, 0, 1, 1, 1, 9999, 8333, "US", 7, 4, 2, 2, 0.0, "cluster_x"), ("t2", 0, 0, 1, 1, 1, 8333, 8333, "US", 7, 4, 2, 2, 0.0, "cluster_x"),
         ("t3", 0, 0, 1, 1, 0, 8333, 9999, "DE", 0, 1, 1, 2, 0.0, "cluster_y")],
        "transaction_id string, time_txs_last_1m int, time_txs_last_5m int, rel_fan_in int, rel_fan_out int, net_is_standard_bitcoin_port int, net_src_port int, "
        "net_dst_port int, net_country string, net_asn bigint, hist_cluster_size int, hist_cluster_tx_count int, hist_component_size int, "
        "hist_address_reuse_ratio double, hist_cluster_id string")
    tx = spark.createDataFrame([("t1", 1000), ("t2", 2000), ("t3", 3000)], "transaction_id string, s bigint").select(
        "transaction_id", F.timestamp_seconds("s").alias("timestamp"))
    return results, features, tx


def test_rules_and_grouping(run):
    got = {r["grouping_key"] + "/" + r["alert_type"]: r for r in al.generate(*run, "an", "d").collect()}
    multi, high, net = got["cluster_x/MULTI_SIGNAL"], got["cluster_x/HIGH_RISK_TRANSACTION"], got["net:DE:UNKNOWN/NETWORK_ANOMALY"]
    assert set(multi["metadata"]["triggering_signals"]) == {"ml_xgboost", "catboost_typology", "network_telemetry"}
    assert multi["trigger_reason"].startswith("Compound alert: 3 independent signals (catboost_typology, ml_xgboost, network_telemetry)")
    assert (multi["severity"], multi["priority"], multi["trigger_source"]) == ("critical", "P1", "composite")
    assert high["trigger_reason"] == "XGBoost risk score is 0.750 (severity: critical)" and high["priority"] == "P1"
    assert (net["severity"], net["priority"]) == ("medium", "P3")
    assert net["trigger_reason"] == "Broadcast via non-standard peer port (src: 8333, dst: 9999)"


def test_group_takes_riskiest_member(spark, run):
    results, features, tx = run
    same = results.withColumn("prediction_label", F.lit("normal"))
    plain = features.withColumn("net_src_port", F.lit(8333))
    got = {r["grouping_key"]: r for r in al.generate(same, plain, tx, "an", "d").collect()}
    g = got["cluster_x"]
    assert (g["transaction_count"], g["transaction_id"], g["entity_type"], g["entity_id"]) == (2, "t1", "cluster", "cluster:cluster_x")
    assert g["trigger_reason"].endswith("(aggregating 2 transactions)")
    assert g["first_seen_at"] < g["last_seen_at"]


def test_second_run_gives_same_rows(run):
    first = al.generate(*run, "an", "d").drop("metadata")
    again = al.save(first, al.generate(*run, "an", "d").drop("metadata"))
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))


def test_life_cycle(spark, run):
    alerts = al.generate(*run, "an", "d").drop("metadata")
    ids = [r["alert_id"] for r in alerts.orderBy("alert_id").collect()]

    def change(df, rows):
        u = spark.createDataFrame(rows, "alert_id string, new_status string, new_priority string, s bigint").select(
            "alert_id", "new_status", "new_priority", F.timestamp_seconds("s").alias("at"))
        return al.apply_updates(df, u)

    a = change(alerts, [(ids[0], "acknowledged", None, 100), (ids[1], "resolved", "p4", 100), (ids[2], "nonsense", "P9", 100)])
    rows = {r["alert_id"]: r for r in a.collect()}
    assert rows[ids[0]]["acknowledged_at"] is not None and rows[ids[0]]["status"] == "ACKNOWLEDGED"
    assert rows[ids[1]]["resolved_at"] is not None and rows[ids[1]]["priority"] == "P4"
    assert rows[ids[2]]["status"] == "NEW" and rows[ids[2]]["updated_at"] is None
    reopened = {r["alert_id"]: r for r in change(a, [(ids[1], "INVESTIGATING", None, 200)]).collect()}
    assert reopened[ids[1]]["resolved_at"] is None and reopened[ids[1]]["status"] == "INVESTIGATING"
    assert al.listing(a, status="inactive").count() == 1 and al.listing(a, status="active").count() == 2
    assert al.listing(a, search="t3").count() == 1
    counts = {(r["dimension"], r["value"]): r["n"] for r in al.summary(a).collect()}
    assert counts[("total", "all")] == 3 and counts[("active", "all")] == 2
    with pytest.raises(ValueError):
        al.sorted_alerts(a, "name")


@pytest.mark.parametrize("bad", [dict(risk_level="huge"), dict(min_risk=0.9, max_risk=0.1), dict(min_risk=2), dict(min_btc="x"), dict(min_btc="2", max_btc="1"),
                                 dict(from_time="2026-02-01T00:00:00Z", to_time="2026-01-01T00:00:00Z"), dict(from_time="soon"), dict(max_btc="-1")])
def test_bad_filters(bad):
    with pytest.raises(q.InvalidFilter):
        q.TransactionFilter(**bad)


def test_latest_result_wins_once(spark):
    rows = [("r1", "t1", 0.2, "2026-01-01"), ("r2", "t1", 0.99, "2026-01-03"), ("r3", "t1", 0.5, None), ("r4", "t2", 0.4, "2026-01-03"), ("r5", "t2", 0.6, "2026-01-03")]
    df = spark.createDataFrame(rows, "result_id string, entity_id string, risk_score double, d string").withColumn("predicted_at", F.col("d").cast("timestamp"))
    got = {r["entity_id"]: r["risk_score"] for r in q.latest_results(df).collect()}
    assert got == {"t1": 0.99, "t2": 0.6}
    pages = [r["result_id"] for n in (1, 2, 3) for r in q.page(df, "risk_score", "result_id", number=n, size=2).collect()]
    assert pages == ["r2", "r5", "r3", "r4", "r1"]
    with pytest.raises(q.InvalidFilter):
        q.sort_column(q.TX_SORTS, "1; drop")
    with pytest.raises(q.InvalidFilter):
        q.page(df, "risk_score", "result_id", number=0)
