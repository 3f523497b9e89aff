"""Canonical table schemas. One StructType per table; raw reads may differ, these do not."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()),
    "array<bigint>": T.ArrayType(T.LongType()),
}


def _schema(text: str) -> T.StructType:
    """``name type, ...`` to a schema, without needing a running session."""
    pairs = [part.split(" ") for part in text.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


TRANSACTIONS = _schema(
    "transaction_id string, dataset_id string, block_hash string, block_height int, timestamp timestamp, "
    "input_count int, output_count int, total_input_value_satoshi bigint, total_output_value_satoshi bigint, "
    "fee_satoshi bigint, transaction_size_bytes int, label string, ingested_at timestamp")

TRANSACTION_INPUTS = _schema(
    "input_id string, transaction_id string, dataset_id string, input_index int, input_address string, "
    "input_value_satoshi bigint, sequence_number bigint, previous_transaction_id string, previous_output_index int")

TRANSACTION_OUTPUTS = _schema(
    "output_id string, transaction_id string, dataset_id string, output_index int, output_address string, "
    "output_value_satoshi bigint, script_type string, is_spent boolean, is_change boolean")

ADDRESSES = _schema(
    "address_id string, dataset_id string, address_type string, first_seen_timestamp timestamp, "
    "last_seen_timestamp timestamp, total_received_satoshi bigint, total_sent_satoshi bigint, "
    "transaction_count bigint, output_count bigint, input_count bigint")

NETWORK_EVENTS = _schema(
    "event_id string, transaction_id string, dataset_id string, timestamp timestamp, timestamp_epoch_sec bigint, "
    "src_ip string, src_port int, dst_ip string, dst_port int, country string, asn bigint")

# Raw relational set, before cleaning and normalisation.
RAW_TRANSACTIONS = _schema(
    "txid string, block_height int, timestamp timestamp, input_count int, output_count int, "
    "total_input_value_satoshi bigint, total_output_value_satoshi bigint, fee_satoshi bigint, "
    "transaction_size_bytes int, script_type string")
RAW_INPUTS = _schema(
    "txid string, input_index int, address string, amount_satoshi bigint, prev_txid string, prev_output_index int")
RAW_OUTPUTS = _schema(
    "txid string, output_index int, address string, amount_satoshi bigint, script_type string, is_change boolean")
RAW_NETWORK_EVENTS = _schema(
    "event_id string, txid string, timestamp timestamp, src_ip string, src_port int, dst_ip string, "
    "dst_port int, country string, asn bigint")
RAW_LABELS = _schema(
    "txid string, entity_id string, scenario_id string, behavior_type string, ground_truth_label int, "
    "has_network_anomaly boolean, risk_seed boolean, related_entities array<string>")
RAW_ENTITIES = _schema(
    "entity_id string, entity_type string, primary_address string, address_count int, created_at timestamp, "
    "total_volume_satoshi bigint")

RAW_TABLES = {
    "transactions": RAW_TRANSACTIONS,
    "transaction_inputs": RAW_INPUTS,
    "transaction_outputs": RAW_OUTPUTS,
    "network_events": RAW_NETWORK_EVENTS,
    "labels": RAW_LABELS,
    "entities": RAW_ENTITIES,
}

CONSOLIDATED = _schema(
    "txid string, timestamp timestamp, input_addresses array<string>, input_amounts array<bigint>, "
    "output_addresses array<string>, output_amounts array<bigint>, fee bigint, script_type string, "
    "src_ip string, src_port int, dst_ip string, dst_port int, country string, asn bigint, scenario_id string")

RESULTS = _schema(
    "result_id string, analysis_id string, dataset_id string, entity_id string, entity_type string, "
    "anomaly_score double, risk_score double, risk_level string, prediction_label string, confidence double, "
    "model_id string, model_version string, predicted_at timestamp")

IP_RANGES = _schema(
    "start_ip bigint, end_ip bigint, country string, country_code string, region string, city string, "
    "latitude double, longitude double, asn bigint, as_name string, as_domain string")

# The eleven behaviour classes, and which of them count as suspicious typologies.
BEHAVIOR_CLASSES = [
    "amount_anomaly", "benign_high_volume", "coordinated_activity", "high_fan_in", "high_fan_out",
    "mixing_like", "normal", "peeling_chain", "rapid_multihop", "temporal_anomaly", "transaction_burst",
]
SUSPICIOUS_TYPOLOGIES = ["peeling_chain", "mixing_like", "rapid_multihop", "coordinated_activity", "amount_anomaly"]
BENIGN_CLASSES = ["normal", "benign_high_volume"]

# Columns that would leak the answer into the features.
QUARANTINED_COLUMNS = [
    "scenario_id", "has_network_anomaly", "behavior_type", "ground_truth_label", "risk_seed", "related_entities",
]

# The tabular feature names in matrix order (transaction, address, time, network, relation).
TX_FEATURES = [
    "tx_input_count", "tx_output_count", "tx_input_output_ratio", "tx_total_input_sats", "tx_total_output_sats",
    "tx_fee_sats", "tx_size_bytes", "tx_fee_rate_sat_per_byte", "tx_value_balance_ratio",
    "tx_avg_input_value_sats", "tx_max_input_value_sats", "tx_avg_output_value_sats", "tx_max_output_value_sats",
    "tx_log_total_value", "tx_log_fee",
]
ADDRESS_FEATURES = [
    "addr_hist_tx_count", "addr_hist_total_sent_sats", "addr_hist_total_received_sats", "addr_hist_avg_tx_val_sats",
    "addr_hist_unique_counterparties", "addr_hist_active_days", "addr_hist_tx_per_day", "addr_reuse_count",
]
TIME_FEATURES = [
    "time_hour_of_day", "time_day_of_week", "time_since_prev_global_tx_sec", "time_txs_last_1m",
    "time_txs_last_5m", "time_txs_last_1h", "time_since_prev_addr_tx_sec",
]
NETWORK_FEATURES = [
    "net_src_port", "net_dst_port", "net_is_standard_bitcoin_port", "net_asn", "net_hist_unique_ips_for_addr",
    "net_country",
]
RELATION_FEATURES = ["rel_fan_in", "rel_fan_out", "rel_has_change_output", "rel_change_value_ratio"]
MATRIX_FEATURES = TX_FEATURES + ADDRESS_FEATURES + TIME_FEATURES + NETWORK_FEATURES + RELATION_FEATURES
GRAPH_FEATURES = [
    "graph_fan_in", "graph_fan_out", "graph_unique_in_addrs", "graph_unique_out_addrs",
    "hist_in_mean_neighbor_degree", "hist_out_mean_neighbor_degree", "hist_component_size",
    "hist_address_reuse_ratio", "hist_cluster_id", "hist_cluster_size", "hist_cluster_tx_count",
]
