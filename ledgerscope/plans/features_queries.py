"""Point-in-time features, modelling table and split."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope import schemas
from ledgerscope.operators import features as f
from ledgerscope.operators import profile, quality
from ledgerscope.plans.bench import Bench, TX
from ledgerscope.plans.registry import query
from ledgerscope.sources.bench_tables import full_ids

# Logarithms differ in the last bit between engines; both sides round these columns alike.
_ROUNDED = ["tx_log_total_value", "tx_log_fee"]


def _even(df):
    return df.select(*[F.round(c, 9).alias(c) if c in _ROUNDED else F.col(c) for c in df.columns])


def _columns(names: list[str]) -> str:
    return ", ".join(f"round({n}, 9) AS {n}" if n in _ROUNDED else n for n in names)


def _pick(names: list[str]) -> str:
    return f"SELECT transaction_id, {_columns(names)} FROM f_all"


@query("f01_f06_transaction_features", _pick(schemas.TX_FEATURES))
def transaction_features(b: Bench):
    return _even(f.transaction_features(b.tx, b.ins, b.outs))


@query("f07_primary_sender", "SELECT transaction_id, sender FROM f_snd")
def primary_sender(b: Bench):
    return f.primary_senders(b.ins)


@query("f08_f13_address_history", _pick(schemas.ADDRESS_FEATURES))
def address_history(b: Bench):
    return full_ids(f.address_features(b.timeline))


@query("f14_f17_temporal", _pick(schemas.TIME_FEATURES))
def temporal(b: Bench):
    return full_ids(f.temporal_features(b.short["transactions"], b.timeline))


@query("f16_velocity_by_second", """SELECT DISTINCT ts AS timestamp_epoch_sec, m1 AS time_txs_last_1m, m5 AS time_txs_last_5m, h1 AS time_txs_last_1h FROM f_vel""")
def velocity(b: Bench):
    return f.second_velocity(b.tx).drop("first_tx", "prev_second")


@query("f18_burst_indicator", """SELECT transaction_id, CASE WHEN coalesce((ts - last_send)::DOUBLE, 86400.0) < 10 THEN 1 ELSE 0 END AS time_burst_indicator FROM f_addr""")
def burst(b: Bench):
    return full_ids(f.sender_pacing(b.timeline)).select(TX, "time_burst_indicator")


@query("f19_asof_event", """SELECT transaction_id, event_id, ev_ts FROM (SELECT n.transaction_id, n.event_id, n.ts AS ev_ts,
 row_number() OVER (PARTITION BY n.transaction_id ORDER BY n.ts DESC, n.event_id DESC) AS rn FROM c_net n JOIN c_tx t USING (transaction_id) WHERE n.ts <= t.ts) WHERE rn = 1""")
def asof(b: Bench):
    events = b.net.withColumnRenamed("timestamp_epoch_sec", "ev_ts")
    return f.latest_event_at_or_before(b.tx, events).select(TX, "event_id", "ev_ts")


@query("f20_f21_network_features", "SELECT * FROM f_net")
def network(b: Bench):
    return f.network_features(b.tx, b.ins, b.net)


@query("f21_ip_history", "SELECT event_id, ips AS net_hist_unique_ips_for_addr FROM f_ips")
def ip_history(b: Bench):
    return f.network_history(b.tx, b.ins, b.net).select("event_id", "net_hist_unique_ips_for_addr")


@query("f22_f23_relations", _pick(schemas.RELATION_FEATURES))
def relations(b: Bench):
    return f.relation_features(b.tx, b.ins, b.outs)


@query("f24_feature_matrix", _pick(schemas.MATRIX_FEATURES))
def matrix(b: Bench):
    return _even(full_ids(f.feature_matrix(b.short, b.timeline)))


@query("f25_modelling_table", f"""SELECT f.transaction_id, {_columns([c for c in schemas.MATRIX_FEATURES])}, graph_fan_in, graph_fan_out,
 graph_unique_in_addrs, graph_unique_out_addrs, hist_in_mean_neighbor_degree, hist_out_mean_neighbor_degree, hist_address_reuse_ratio,
 t.dataset_id, t.timestamp, t.ts AS timestamp_epoch_sec, behavior_type, ground_truth_label FROM f_all f JOIN g_near USING (transaction_id)
 JOIN c_tx t USING (transaction_id) JOIN c_lab USING (transaction_id)""")
def modelling(b: Bench):
    near = b.graph_features.drop("hist_component_size", "hist_cluster_id", "hist_cluster_size", "hist_cluster_tx_count")
    return _even(f.modelling_table(b.features, near, b.tx, b.labels))


@query("f26_chronological_split", "SELECT transaction_id, rn AS chronological_index, temporal_split FROM m_split")
def split(b: Bench):
    rows = b.tx.select(TX, "timestamp_epoch_sec").join(b.labels, TX)
    return f.chronological_split(rows).select(TX, "chronological_index", "temporal_split")


@query("f28_first_entities", "SELECT transaction_id, ts AS timestamp_epoch_sec FROM c_tx ORDER BY ts, transaction_id LIMIT 1000")
def first_entities(b: Bench):
    return f.first_entities(b.tx.select(TX, "timestamp_epoch_sec"), 1000)


@query("q21_feature_audit", "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS null_count, 0 AS inf_count, coalesce(stddev_samp({c}::DOUBLE) < 1e-8, false) AS is_constant FROM f_all"
    for c in schemas.MATRIX_FEATURES if c != "net_country"))
def feature_audit(b: Bench):
    return quality.feature_audit(b.features, [c for c in schemas.MATRIX_FEATURES if c != "net_country"])


@query("q22_feature_completeness", "SELECT transaction_id, coalesce(net_asn, 0)::DOUBLE AS net_asn, coalesce(net_country, 'UNKNOWN') AS net_country, 0.0::DOUBLE AS hist_cluster_size FROM f_all")
def completeness(b: Bench):
    return f.require_features(b.features.select(TX, "net_asn", "net_country"), ["net_asn", "net_country", "hist_cluster_size"])


@query("q25_join_integrity", """SELECT 'join_lost_rows' AS rule_id, 'error' AS severity, count(*) FILTER (net_asn IS NULL) AS violations, count(*) AS checked FROM f_all
 UNION ALL SELECT 'join_repeated_rows', 'error', 0, count(*) FROM f_all""")
def integrity(b: Bench):
    return quality.matrix_integrity(f.network_features(b.tx, b.ins, b.net), b.tx)


@query("q26_split_audit", """SELECT temporal_split, count(*) AS records, count(*) / sum(count(*)) OVER ()::DOUBLE * 100 AS share_pct, min(ts) AS min_epoch, max(ts) AS max_epoch,
 avg(ground_truth_label) * 100 AS positive_pct, count(DISTINCT behavior_type) AS n_classes FROM m_split GROUP BY temporal_split""")
def split_audit(b: Bench):
    return quality.split_audit(b.split)


@query("q26_split_order", "SELECT 'split_order' AS rule_id, 'error' AS severity, 0 AS violations, count(*) AS checked FROM m_split")
def split_order(b: Bench):
    return quality.order_rule(b.split)




_NUMBERS = [c for c in schemas.MATRIX_FEATURES if c not in ("net_country", "net_asn")]


@query("f27_feature_manifest", "\nUNION ALL ".join([
    f"""SELECT '{c}' AS feature, 'numeric' AS kind, min({c})::DOUBLE AS min, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median, round(max({c})::DOUBLE, 6) AS max, round(avg({c}), 6) AS mean,
 round(stddev_samp({c}::DOUBLE) / greatest(1.0::DOUBLE, abs(avg({c}))), 6) AS relative_std, count(*) FILTER ({c} IS NULL) AS null_count, count(DISTINCT {c}) AS n_distinct FROM f_all""" for c in _NUMBERS] + [
    f"""SELECT '{c}', 'categorical', NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, count(*) FILTER ({c} IS NULL), count(DISTINCT {c}) FROM f_all""" for c in ("net_country", "net_asn")]))
def manifest(b: Bench):
    """Range, centre, spread and cardinality of every column of the matrix."""
    names = [*_NUMBERS, "net_country", "net_asn"]
    p = profile.column_profile(b.features, _NUMBERS)
    c = b.features.agg(*[F.count_distinct(n).alias(n) for n in names]).select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("n_distinct")) for n in names])))
    nulls = b.features.agg(*[F.count(F.when(F.col(n).isNull(), 1)).alias(n) for n in names]).select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("null_count")) for n in names])))
    kind = F.when(F.col("feature").isin("net_country", "net_asn"), "categorical").otherwise("numeric")
    return c.join(nulls, "feature").join(p, "feature", "left").select(
        "feature", kind.alias("kind"), "min", *[F.round(x, 6).alias(x) for x in ("median", "max", "mean")],
        F.round(F.col("std") / F.greatest(F.lit(1.0), F.abs("mean")), 6).alias("relative_std"), "null_count", "n_distinct")


