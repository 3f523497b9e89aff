"""SQL counterparts of the registered queries: shared table expressions and a small assembler.

``sql(body)`` prefixes a statement with exactly those shared expressions it mentions.
"""

from __future__ import annotations

import re

_SHARED: dict[str, str] = {}


def shared(name: str, body: str) -> None:
    _SHARED[name] = body.strip()


def sql(body: str) -> str:
    """A complete statement: the needed shared expressions, then ``body`` (which may start with WITH)."""
    body = body.strip()
    order: list[str] = []

    def need(text: str) -> None:
        for name in _SHARED:
            if name not in order and re.search(rf"\b{name}\b", text):
                need(_SHARED[name])
                if name not in order:
                    order.append(name)

    need(body)
    parts = [f"{name} AS MATERIALIZED ({_SHARED[name]})" for name in order]
    own = re.match(r"(?is)with\s+(recursive\s+)?(.*)", body)
    if own:
        return f"WITH {own.group(1) or ''}" + ",\n".join([*parts, own.group(2)])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


CLASS_CASE = """CASE k % 11 WHEN 0 THEN 'amount_anomaly' WHEN 1 THEN 'benign_high_volume' WHEN 2 THEN 'coordinated_activity'
 WHEN 3 THEN 'high_fan_in' WHEN 4 THEN 'high_fan_out' WHEN 5 THEN 'mixing_like' WHEN 6 THEN 'normal' WHEN 7 THEN 'peeling_chain'
 WHEN 8 THEN 'rapid_multihop' WHEN 9 THEN 'temporal_anomaly' ELSE 'transaction_burst' END"""

LEVEL_CASE = "CASE WHEN {0} >= 0.67 THEN 'critical' WHEN {0} >= 0.50 THEN 'high' WHEN {0} >= 0.32 THEN 'medium' ELSE 'low' END"

# ---- canonical tables ---------------------------------------------------------------------------

shared("b_ord", """SELECT DISTINCT o_orderkey, o_custkey, o_orderdate, o_orderpriority FROM orders
 WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
shared("b_out", """SELECT sha256(CAST(l_orderkey AS VARCHAR)) AS transaction_id, l_orderkey AS k,
 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS INTEGER) AS output_index, l_returnflag = 'R' AS is_change,
 CASE WHEN l_returnflag = 'R' AND l_linenumber <= 2 THEN 'C' || CAST(o_custkey AS VARCHAR)
  WHEN l_returnflag = 'R' THEN 'C' || CAST(o_custkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR)
  ELSE 'P' || CAST(l_partkey AS VARCHAR) END AS output_address,
 CAST(round(l_extendedprice * 100) AS BIGINT) AS output_value_satoshi
 FROM lineitem JOIN b_ord ON l_orderkey = o_orderkey""")
shared("b_tx", """SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS transaction_id, o_orderkey AS k, o_custkey, o_orderpriority,
 o_orderdate + (o_orderkey % 1440) * INTERVAL 1 MINUTE AS timestamp,
 CAST(epoch(o_orderdate + (o_orderkey % 1440) * INTERVAL 1 MINUTE) AS BIGINT) AS ts,
 CAST(n AS INTEGER) AS output_count, CAST(s AS BIGINT) AS total_output_value_satoshi,
 CAST(1000 + o_orderkey % 9000 AS BIGINT) AS fee_satoshi
 FROM b_ord JOIN (SELECT k, count(*) n, sum(output_value_satoshi) s FROM b_out GROUP BY k) ON k = o_orderkey""")
shared("c_tx", """SELECT transaction_id, 'bench' AS dataset_id, k, CAST(k // 10 AS INTEGER) AS block_height, timestamp, ts,
 CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END AS input_count, output_count,
 total_output_value_satoshi + fee_satoshi AS total_input_value_satoshi, total_output_value_satoshi, fee_satoshi,
 CAST(10 + 148 * (CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END) + 34 * output_count AS INTEGER) AS transaction_size_bytes
 FROM b_tx""")
shared("c_in", """SELECT transaction_id, k, 0 AS input_index, 'C' || CAST(o_custkey AS VARCHAR) AS input_address,
 CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN (total_output_value_satoshi + fee_satoshi) - (total_output_value_satoshi + fee_satoshi) // 3
  ELSE total_output_value_satoshi + fee_satoshi END AS BIGINT) AS input_value_satoshi FROM b_tx
 UNION ALL SELECT transaction_id, k, 1, CASE WHEN k % 97 = 0 THEN 'C' || CAST(o_custkey + 1 AS VARCHAR)
  ELSE 'C' || CAST(o_custkey AS VARCHAR) || '_' || CAST(1 + k % 7 AS VARCHAR) END,
  CAST((total_output_value_satoshi + fee_satoshi) // 3 AS BIGINT) FROM b_tx WHERE o_orderpriority = '1-URGENT'""")
shared("c_out", "SELECT * FROM b_out")
shared("c_net", """SELECT 'EVT_' || CAST(event_id AS VARCHAR) AS event_id, event_id AS e, t.transaction_id,
 CASE WHEN event_id % 10 = 0 THEN t.timestamp + INTERVAL 5 SECOND ELSE t.timestamp - (event_id % 3) * INTERVAL 1 SECOND END AS timestamp,
 t.ts + CASE WHEN event_id % 10 = 0 THEN 5 ELSE -(event_id % 3) END AS ts,
 CAST(1 + user_id % 200 AS VARCHAR) || '.' || CAST(user_id % 251 AS VARCHAR) || '.' || CAST(event_id % 3 AS VARCHAR) || '.10' AS src_ip,
 CAST(1024 + event_id % 60000 AS INTEGER) AS src_port,
 '51.109.' || CAST(event_id % 16 AS VARCHAR) || '.' || CAST(user_id % 8 AS VARCHAR) AS dst_ip,
 CASE WHEN event_type = 'error' THEN 18333 ELSE 8333 END AS dst_port,
 CASE user_id % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'NL' WHEN 3 THEN 'SG' ELSE NULL END AS country,
 CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(13000 + user_id % 28 AS BIGINT) END AS asn
 FROM events JOIN b_tx t ON t.k = event_id""")
shared("c_lab", f"""SELECT transaction_id, k, {CLASS_CASE} AS behavior_type, CASE WHEN k % 11 IN (1, 6) THEN 0 ELSE 1 END AS ground_truth_label
 FROM b_tx""")
shared("c_res", f"""SELECT 'r' || CAST(v AS VARCHAR) || '_' || CAST(k AS VARCHAR) AS result_id, 'an' || CAST(v AS VARCHAR) AS analysis_id,
 transaction_id AS entity_id, 'transaction' AS entity_type, ((k * 7919 + v * 131) % 1000) / 1000.0::DOUBLE AS risk_score,
 {CLASS_CASE} AS prediction_label, (500 + (k * 31) % 500) / 1000.0::DOUBLE AS confidence, timestamp + v * INTERVAL 1 DAY AS predicted_at,
 {LEVEL_CASE.format("(((k * 7919 + v * 131) % 1000) / 1000.0::DOUBLE)")} AS risk_level
 FROM b_tx CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2) vv""")
shared("c_addr", """SELECT a AS address_id, min(timestamp) AS first_seen_timestamp, max(timestamp) AS last_seen_timestamp,
 CAST(sum(r) AS BIGINT) AS total_received_satoshi, CAST(sum(s) AS BIGINT) AS total_sent_satoshi,
 count(DISTINCT transaction_id) AS transaction_count FROM (
 SELECT output_address AS a, transaction_id, output_value_satoshi AS r, 0 AS s FROM c_out UNION ALL
 SELECT input_address, transaction_id, 0, input_value_satoshi FROM c_in) m JOIN c_tx USING (transaction_id) GROUP BY a""")
# the newest result of every entity
shared("c_new", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY predicted_at DESC NULLS LAST, result_id DESC) AS rn
 FROM c_res) WHERE rn = 1""")

# ---- features -----------------------------------------------------------------------------------

shared("f_snd", "SELECT transaction_id, arg_min(input_address, input_index) AS sender FROM c_in GROUP BY transaction_id")
shared("f_key", """SELECT t.transaction_id, t.ts, t.total_output_value_satoshi AS v, coalesce(sender, 'unknown_sender_' || t.transaction_id) AS sender
 FROM c_tx t LEFT JOIN f_snd USING (transaction_id)""")
shared("f_rec", """SELECT DISTINCT o.transaction_id, o.output_address AS a, f.ts, f.sender, f.v,
 count(DISTINCT o.output_address) OVER (PARTITION BY o.transaction_id) AS n FROM
 (SELECT DISTINCT transaction_id, output_address FROM c_out) o JOIN f_key f USING (transaction_id)""")
shared("f_addr", """SELECT t.transaction_id, count(*) FILTER (e.kind = 's') AS n,
 CAST(coalesce(sum(e.sent), 0) AS BIGINT) AS sent, CAST(coalesce(sum(e.recv), 0) AS BIGINT) AS recv, min(e.ts) AS first_seen,
 max(e.ts) FILTER (e.kind = 's') AS last_send, any_value(t.ts) AS ts
 FROM f_key t LEFT JOIN (
  SELECT sender AS a, ts, transaction_id, 's' AS kind, v AS sent, 0 AS recv FROM f_key UNION ALL
  SELECT a, ts, transaction_id, 'r', 0, v // n FROM f_rec) e
 ON e.a = t.sender AND (e.ts < t.ts OR (e.ts = t.ts AND e.transaction_id < t.transaction_id)) GROUP BY t.transaction_id""")
shared("f_cp", """SELECT t.transaction_id, count(DISTINCT e.b) AS n FROM f_key t LEFT JOIN (
  SELECT sender AS a, a AS b, ts, transaction_id FROM f_rec UNION ALL SELECT a, sender, ts, transaction_id FROM f_rec) e
 ON e.a = t.sender AND (e.ts < t.ts OR (e.ts = t.ts AND e.transaction_id < t.transaction_id)) GROUP BY t.transaction_id""")
shared("f_vel", """SELECT transaction_id, timestamp, ts,
 CAST(coalesce(ts - lag(ts) OVER (ORDER BY ts, transaction_id), 0) AS DOUBLE) AS gap,
 count(*) OVER (ORDER BY ts RANGE BETWEEN 60 PRECEDING AND 1 PRECEDING) AS m1,
 count(*) OVER (ORDER BY ts RANGE BETWEEN 300 PRECEDING AND 1 PRECEDING) AS m5,
 count(*) OVER (ORDER BY ts RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS h1 FROM c_tx""")
shared("f_nev", """SELECT n.*, f.sender FROM c_net n JOIN f_key f USING (transaction_id)""")
shared("f_ips", """SELECT n.event_id, count(DISTINCT p.src_ip) AS ips FROM f_nev n LEFT JOIN f_nev p ON p.sender = n.sender
 AND (p.ts, p.transaction_id, p.event_id) < (n.ts, n.transaction_id, n.event_id) GROUP BY n.event_id""")
shared("f_net", """SELECT transaction_id, coalesce(src_port, 0) AS net_src_port, coalesce(dst_port, 8333) AS net_dst_port,
 CASE WHEN coalesce(dst_port, 8333) = 8333 THEN 1 ELSE 0 END AS net_is_standard_bitcoin_port, coalesce(asn, 0) AS net_asn,
 ips AS net_hist_unique_ips_for_addr, coalesce(country, 'UNKNOWN') AS net_country FROM (
 SELECT n.*, i.ips, row_number() OVER (PARTITION BY n.transaction_id ORDER BY n.ts DESC, n.event_id DESC) AS rn
 FROM c_net n JOIN f_ips i USING (event_id) JOIN c_tx t USING (transaction_id) WHERE n.ts <= t.ts) WHERE rn = 1""")
shared("f_i", """SELECT transaction_id, avg(input_value_satoshi) AS a, max(input_value_satoshi) AS m, count(DISTINCT input_address) AS f
 FROM c_in GROUP BY transaction_id""")
shared("f_o", """SELECT transaction_id, avg(output_value_satoshi) AS a, max(output_value_satoshi) AS m, count(DISTINCT output_address) AS f,
 sum(output_value_satoshi) FILTER (is_change) AS c FROM c_out GROUP BY transaction_id""")
shared("f_all", """SELECT t.transaction_id,
 t.input_count AS tx_input_count, t.output_count AS tx_output_count, t.input_count / greatest(t.output_count, 1)::DOUBLE AS tx_input_output_ratio,
 t.total_input_value_satoshi AS tx_total_input_sats, t.total_output_value_satoshi AS tx_total_output_sats, t.fee_satoshi AS tx_fee_sats,
 coalesce(transaction_size_bytes, 250) AS tx_size_bytes,
 t.fee_satoshi::DOUBLE / greatest(coalesce(transaction_size_bytes, 250), 1) AS tx_fee_rate_sat_per_byte,
 least(1.0, greatest(0.0, t.total_output_value_satoshi::DOUBLE / greatest(t.total_input_value_satoshi, 1))) AS tx_value_balance_ratio,
 coalesce(i.a, 0) AS tx_avg_input_value_sats, coalesce(i.m, 0) AS tx_max_input_value_sats,
 coalesce(o.a, 0) AS tx_avg_output_value_sats, coalesce(o.m, 0) AS tx_max_output_value_sats,
 ln(1 + greatest(t.total_output_value_satoshi, 0)::DOUBLE) AS tx_log_total_value, ln(1 + greatest(t.fee_satoshi, 0)::DOUBLE) AS tx_log_fee,
 h.n AS addr_hist_tx_count, h.sent AS addr_hist_total_sent_sats, h.recv AS addr_hist_total_received_sats,
 CASE WHEN h.n > 0 THEN h.sent::DOUBLE / h.n ELSE 0.0 END AS addr_hist_avg_tx_val_sats, cp.n AS addr_hist_unique_counterparties,
 CASE WHEN h.n > 0 THEN greatest(0.0, (h.ts - h.first_seen) / 86400.0::DOUBLE) ELSE 0.0 END AS addr_hist_active_days,
 CASE WHEN h.n > 0 THEN h.n / greatest((h.ts - h.first_seen) / 86400.0::DOUBLE, 1.0) ELSE 0.0 END AS addr_hist_tx_per_day,
 h.n AS addr_reuse_count, CAST(hour(v.timestamp) AS INTEGER) AS time_hour_of_day, CAST(isodow(v.timestamp) - 1 AS INTEGER) AS time_day_of_week,
 v.gap AS time_since_prev_global_tx_sec, v.m1 AS time_txs_last_1m, v.m5 AS time_txs_last_5m, v.h1 AS time_txs_last_1h,
 coalesce((h.ts - h.last_send)::DOUBLE, 86400.0) AS time_since_prev_addr_tx_sec,
 net_src_port, net_dst_port, net_is_standard_bitcoin_port, net_asn, net_hist_unique_ips_for_addr, net_country,
 coalesce(i.f, 1) AS rel_fan_in, coalesce(o.f, 1) AS rel_fan_out, CASE WHEN o.c IS NULL THEN 0 ELSE 1 END AS rel_has_change_output,
 least(1.0, greatest(0.0, coalesce(o.c, 0)::DOUBLE / greatest(t.total_output_value_satoshi, 1))) AS rel_change_value_ratio
 FROM c_tx t LEFT JOIN f_i i USING (transaction_id) LEFT JOIN f_o o USING (transaction_id) LEFT JOIN f_addr h USING (transaction_id)
 LEFT JOIN f_cp cp USING (transaction_id) LEFT JOIN f_vel v USING (transaction_id) LEFT JOIN f_net USING (transaction_id)""")

# ---- graph --------------------------------------------------------------------------------------

shared("g_edge", """SELECT 'in_' || transaction_id || '_' || CAST(input_index AS VARCHAR) AS edge_id, 'addr_' || input_address AS source,
 'tx_' || transaction_id AS target, 'INPUT_TO' AS edge_type, input_value_satoshi AS amount_satoshi, input_index AS index, false AS is_change,
 ts AS timestamp_epoch_sec FROM c_in JOIN c_tx USING (transaction_id) UNION ALL
 SELECT 'out_' || transaction_id || '_' || CAST(output_index AS VARCHAR), 'tx_' || transaction_id, 'addr_' || output_address, 'OUTPUT_TO',
 output_value_satoshi, output_index, is_change, ts FROM c_out JOIN c_tx USING (transaction_id)""")
shared("g_node", """SELECT 'tx_' || transaction_id AS node_id, 'transaction' AS node_type, transaction_id AS identifier, ts AS timestamp_epoch_sec FROM c_tx
 UNION ALL SELECT CASE WHEN edge_type = 'INPUT_TO' THEN source ELSE target END AS n, 'address', substring(any_value(CASE WHEN edge_type = 'INPUT_TO' THEN source ELSE target END), 6), min(timestamp_epoch_sec)
 FROM g_edge GROUP BY n""")
shared("g_deg", """SELECT n.*, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) + coalesce(o.c, 0) AS total_degree FROM g_node n
 LEFT JOIN (SELECT target, count(DISTINCT source) c FROM g_edge GROUP BY target) i ON i.target = node_id
 LEFT JOIN (SELECT source, count(DISTINCT target) c FROM g_edge GROUP BY source) o ON o.source = node_id""")
shared("g_app", """SELECT output_address AS a, transaction_id, ts, 0 AS i, 1 AS o FROM c_out JOIN c_tx USING (transaction_id) UNION ALL
 SELECT input_address, transaction_id, ts, 1, 0 FROM c_in JOIN c_tx USING (transaction_id)""")
shared("g_ta", """SELECT a, transaction_id, ts, sum(i) AS i, sum(o) AS o FROM g_app GROUP BY ALL""")
shared("g_his", """SELECT x.a, x.transaction_id, any_value(x.i) AS i, any_value(x.o) AS o, count(p.a) AS prior FROM g_ta x LEFT JOIN g_app p ON p.a = x.a
 AND (p.ts < x.ts OR (p.ts = x.ts AND p.transaction_id < x.transaction_id)) GROUP BY x.a, x.transaction_id""")
shared("g_near", """SELECT transaction_id, CAST(sum(i) AS BIGINT) AS graph_fan_in, CAST(sum(o) AS BIGINT) AS graph_fan_out,
 count(*) FILTER (i > 0) AS graph_unique_in_addrs, count(*) FILTER (o > 0) AS graph_unique_out_addrs,
 round(coalesce(avg(prior) FILTER (i > 0), 0.0), 4) AS hist_in_mean_neighbor_degree,
 round(coalesce(avg(prior) FILTER (o > 0), 0.0), 4) AS hist_out_mean_neighbor_degree,
 round(CASE WHEN sum(i) > 0 THEN coalesce(sum(i) FILTER (prior > 0), 0)::DOUBLE / sum(i)::DOUBLE ELSE 0.0 END, 4) AS hist_address_reuse_ratio
 FROM g_his GROUP BY transaction_id""")
shared("m_split", """SELECT *, CASE WHEN rn < floor(n * 0.70) THEN 'train' WHEN rn < floor(n * 0.85) THEN 'val' ELSE 'test' END AS temporal_split FROM (
 SELECT t.transaction_id, t.ts, l.behavior_type, l.ground_truth_label, row_number() OVER (ORDER BY t.ts, t.transaction_id) - 1 AS rn, count(*) OVER () AS n
 FROM c_tx t JOIN c_lab l USING (transaction_id))""")
