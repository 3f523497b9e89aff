"""Listings, network intelligence and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope import schemas
from ledgerscope.functions import exprs as X
from ledgerscope.operators import alerts as al, network as net, query as q
from ledgerscope.operators.features import feature_columns
from ledgerscope.plans.bench import Bench, TX, with_empty_graph
from ledgerscope.plans.oracles import shared
from ledgerscope.plans.registry import query
from ledgerscope.sources.bench_tables import full_ids

BTC = "CAST(CAST({0} / 100000000::DECIMAL(28, 8) AS DECIMAL(28, 8)) AS VARCHAR)"

# ---- listings -----------------------------------------------------------------------------------

shared("t_joined", """SELECT t.*, r.risk_score, r.risk_level, r.prediction_label FROM c_tx t LEFT JOIN c_new r ON r.entity_id = t.transaction_id""")
_LIST = f"""transaction_id, block_height, timestamp, input_count, output_count, {BTC.format('total_input_value_satoshi')} AS total_input_value_btc,
 {BTC.format('total_output_value_satoshi')} AS total_output_value_btc, {BTC.format('fee_satoshi')} AS fee_btc, risk_score, risk_level"""


@query("t01_filtered_listing", f"""SELECT {_LIST} FROM t_joined WHERE risk_level = 'high' AND risk_score BETWEEN 0.5 AND 0.65 AND timestamp >= TIMESTAMP '1995-01-01'
 AND timestamp <= TIMESTAMP '1998-06-30' AND total_output_value_satoshi BETWEEN 10000000 AND 500000000""")
def filtered(b: Bench):
    spec = q.TransactionFilter(risk_level="high", min_risk=0.5, max_risk=0.65, from_time="1995-01-01T00:00:00Z",
                               to_time="1998-06-30T00:00:00Z", min_btc="0.1", max_btc="5")
    return q.listing_columns(q.filter_transactions(q.joined_risk(b.tx, b.results), spec))


@query("t02_by_ip", "SELECT transaction_id, risk_score FROM t_joined WHERE transaction_id IN (SELECT transaction_id FROM c_net WHERE src_ip = '51.109.3.3' OR dst_ip = '51.109.3.3')")
def by_ip(b: Bench):
    return q.filter_transactions(q.joined_risk(b.tx, b.results), q.TransactionFilter(ip=" 51.109.3.3 "), events=b.net).select(TX, "risk_score")


@query("t03_by_address", "SELECT transaction_id, risk_score FROM t_joined WHERE transaction_id IN (SELECT transaction_id FROM g_app WHERE a = 'P7')")
def by_address(b: Bench):
    return q.filter_transactions(q.joined_risk(b.tx, b.results), q.TransactionFilter(address="P7"), b.ins, b.outs).select(TX, "risk_score")


@query("t04_latest_results", "SELECT entity_id, result_id, analysis_id, risk_score, predicted_at FROM c_new")
def latest(b: Bench):
    return q.latest_results(b.results).select("entity_id", "result_id", "analysis_id", "risk_score", "predicted_at")


@query("t05_one_run", "SELECT transaction_id, risk_score, risk_level FROM c_tx LEFT JOIN c_res ON entity_id = transaction_id AND analysis_id = 'an1'")
def one_run(b: Bench):
    return q.joined_risk(b.tx, b.results, "an1").select(TX, "risk_score", "risk_level")


@query("t06_page", f"SELECT {_LIST} FROM t_joined ORDER BY risk_score DESC NULLS LAST, transaction_id LIMIT 50 OFFSET 100")
def page(b: Bench):
    return q.listing_columns(q.page(q.joined_risk(b.tx, b.results), q.sort_column(q.TX_SORTS, "riskScore"), TX, number=3, size=50))


@query("t06_page_meta", """SELECT 3 AS page, 50 AS page_size, count(*) AS total_items, CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages, 3 < ceil(count(*) / 50.0) AS has_next,
 true AS has_previous FROM c_tx""")
def page_meta(b: Bench):
    return q.page_meta(b.tx, 3, 50)


@query("t08_btc_text", f"SELECT transaction_id, {BTC.format('fee_satoshi')} AS fee_btc FROM c_tx")
def btc_text(b: Bench):
    return b.tx.select(TX, X.btc_text("fee_satoshi").alias("fee_btc"))


@query("t09_transaction_detail", """WITH ids AS (SELECT transaction_id, prediction_label, total_output_value_satoshi FROM t_joined WHERE risk_score >= 0.9)
 SELECT transaction_id, 'header' AS part, 0 AS position, prediction_label AS ref, total_output_value_satoshi AS value_satoshi FROM ids UNION ALL
 SELECT transaction_id, 'input', input_index, input_address, input_value_satoshi FROM c_in WHERE transaction_id IN (SELECT transaction_id FROM ids) UNION ALL
 SELECT transaction_id, 'output', output_index, output_address, output_value_satoshi FROM c_out WHERE transaction_id IN (SELECT transaction_id FROM ids) UNION ALL
 SELECT transaction_id, 'event', row_number() OVER (PARTITION BY transaction_id ORDER BY timestamp, event_id), event_id, NULL FROM c_net WHERE transaction_id IN (SELECT transaction_id FROM ids)""")
def detail(b: Bench):
    ids = q.joined_risk(b.tx, b.results).where(F.col("risk_score") >= 0.9).select(TX)
    return q.detail_rows(q.transaction_detail(b.tx, b.ins, b.outs, b.net, b.results, ids))


@query("t10_address_listing", """SELECT address_id, total_received_satoshi, total_sent_satoshi, transaction_count, risk_score, risk_level
 FROM c_addr LEFT JOIN r_lev USING (address_id) ORDER BY transaction_count DESC NULLS LAST, address_id LIMIT 100""")
def address_listing(b: Bench):
    """The flagship listing: address rollup, latest risk per address, one page by activity."""
    from ledgerscope.operators import graph as g
    rows = b.attributed_risk
    return q.page(rows, q.sort_column(q.ADDRESS_SORTS, "transactionCount"), "address_id", size=100).select(
        "address_id", "total_received_satoshi", "total_sent_satoshi", "transaction_count", "risk_score", "risk_level")


@query("t11_address_profile", f"""SELECT address_id, first_seen_timestamp, last_seen_timestamp,
 greatest(1, (CAST(epoch(last_seen_timestamp) AS BIGINT) - CAST(epoch(first_seen_timestamp) AS BIGINT)) // 86400 + 1) AS active_days,
 {BTC.format('total_received_satoshi')} AS total_received_btc, {BTC.format('total_sent_satoshi')} AS total_sent_btc,
 {BTC.format('(total_received_satoshi - total_sent_satoshi)')} AS balance_btc, transaction_count, NULL::DOUBLE AS risk_score, NULL::VARCHAR AS risk_level FROM c_addr""")
def address_profile(b: Bench):
    return q.address_profile(b.addresses, b.results)


@query("t12_result_listing", "SELECT entity_id, risk_score, risk_level FROM c_res WHERE analysis_id = 'an2' AND risk_level = 'critical' AND risk_score >= 0.9")
def result_listing(b: Bench):
    return q.result_listing(b.results, "an2", "critical", 0.9, "transaction").select("entity_id", "risk_score", "risk_level")


@query("t13_result_detail", "SELECT result_id, entity_id, risk_score, prediction_label, confidence FROM c_res WHERE analysis_id = 'an1' AND entity_id = sha256('1')")
def result_detail(b: Bench):
    from hashlib import sha256
    return q.result_detail(b.results, "an1", sha256(b"1").hexdigest()).select("result_id", "entity_id", "risk_score", "prediction_label", "confidence")


def _runs(b: Bench):
    return b.results.groupBy("dataset_id", "analysis_id").agg(
        F.min("predicted_at").alias("started_at"), F.max("predicted_at").alias("completed_at"),
        F.count(F.lit(1)).alias("entity_count")).withColumn("status", F.lit("completed"))


@query("t14_dataset_listing", "SELECT 'bench' AS dataset_id, max(predicted_at) AS uploaded_at, count(*) AS n FROM c_res")
def datasets(b: Bench):
    d = b.results.groupBy("dataset_id").agg(F.max("predicted_at").alias("uploaded_at"), F.count(F.lit(1)).alias("n"))
    return q.dataset_listing(d)


@query("t15_runs", "SELECT analysis_id, min(predicted_at) AS started_at, count(*) AS entity_count FROM c_res GROUP BY analysis_id")
def runs(b: Bench):
    return q.runs_of_dataset(_runs(b), "bench").select("analysis_id", "started_at", "entity_count")


@query("t15_latest_completed", "SELECT 'bench' AS dataset_id, 'an2' AS analysis_id, max(predicted_at) AS completed_at FROM c_res")
def latest_run(b: Bench):
    return q.latest_completed_runs(_runs(b)).select("dataset_id", "analysis_id", "completed_at")


@query("t16_more_filters", """SELECT transaction_id, prediction_label FROM t_joined WHERE prediction_label = 'peeling_chain' AND transaction_id LIKE '%ab%'
 AND transaction_id IN (SELECT transaction_id FROM c_net WHERE country = 'DE') """)
def more_filters(b: Bench):
    spec = q.TransactionFilter(behavior="peeling_chain", country="DE", id_contains="AB")
    return q.filter_transactions(q.joined_risk(b.tx, b.results), spec, events=b.net).select(TX, "prediction_label")


@query("t16_by_asn", "SELECT transaction_id FROM c_tx WHERE transaction_id IN (SELECT transaction_id FROM c_net WHERE asn = 13005)")
def by_asn(b: Bench):
    return q.filter_transactions(q.joined_risk(b.tx, b.results), q.TransactionFilter(asn=13005), events=b.net).select(TX)


@query("t17_search", """SELECT kind, id, lower(id) = 'c12' AS is_exact FROM (SELECT 'transaction' AS kind, transaction_id AS id FROM c_tx UNION ALL SELECT 'address', address_id FROM c_addr)
 WHERE lower(id) LIKE '%c12%' ORDER BY lower(id) = 'c12' DESC, kind, id LIMIT 8""")
def search(b: Bench):
    return q.search(b.tx, b.addresses, "C12")


@query("t18_investigation_timeline", """WITH ids AS (SELECT transaction_id FROM c_in WHERE input_address = 'C1')
 SELECT transaction_id, timestamp AS at, 'transaction' AS kind, transaction_id AS ref FROM c_tx WHERE transaction_id IN (SELECT * FROM ids)
 UNION ALL SELECT transaction_id, timestamp, 'network', event_id FROM c_net WHERE transaction_id IN (SELECT * FROM ids)""")
def timeline(b: Bench):
    ids = b.ins.where(F.col("input_address") == "C1").select(TX)
    return q.timeline(b.tx, b.net, None, ids).drop("detail")


@query("t18_whole_timeline", f"""WITH ids AS (SELECT DISTINCT transaction_id FROM c_in WHERE input_address LIKE 'C%')
 SELECT transaction_id, timestamp AS at, 'transaction' AS kind, transaction_id AS ref, {BTC.format('total_output_value_satoshi')} AS detail FROM c_tx WHERE transaction_id IN (SELECT * FROM ids)
 UNION ALL SELECT transaction_id, timestamp, 'network', event_id, src_ip || ' -> ' || dst_ip FROM c_net WHERE transaction_id IN (SELECT * FROM ids)
 UNION ALL SELECT transaction_id, first_seen_at, 'alert', alert_id, alert_type FROM a_alert WHERE transaction_id IN (SELECT * FROM ids)""")
def whole_timeline(b: Bench):
    """Transactions, network events and alerts with their details, of every spending customer."""
    ids = b.ins.where(F.col("input_address").startswith("C")).select(TX).distinct()
    return q.timeline(b.tx, b.net, b.tabular_alerts, ids)


# ---- network ------------------------------------------------------------------------------------

shared("w_ep", """SELECT ip, count(DISTINCT event_id) AS event_count, count(DISTINCT transaction_id) AS transaction_count, CAST(sum(s) AS BIGINT) AS source_event_count,
 CAST(sum(1 - s) AS BIGINT) AS destination_event_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen, max(country) AS dataset_country, max(asn) FILTER (asn > 0) AS dataset_asn
 FROM (SELECT src_ip AS ip, event_id, transaction_id, timestamp, country, asn, 1 AS s FROM c_net UNION ALL SELECT dst_ip, event_id, transaction_id, timestamp, NULL, NULL, 0 FROM c_net) GROUP BY ip""")
shared("w_flow", """SELECT src_ip, dst_ip, count(*) AS event_count, count(DISTINCT transaction_id) AS transaction_count FROM c_net WHERE src_ip <> dst_ip GROUP BY src_ip, dst_ip""")


@query("w01_endpoints", "SELECT * FROM w_ep")
def endpoints(b: Bench):
    return net.endpoints(b.net)


@query("w02_flows", "SELECT * FROM w_flow ORDER BY event_count DESC, src_ip, dst_ip LIMIT 500")
def flows(b: Bench):
    return net.flows(b.net, 500)


def ip_ranges(b: Bench):
    """Address ranges per supplier: one per first octet, named after its nation."""
    s = b.source("supplier").join(b.source("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    start = (k % 223 + 1) * 16777216 + (k % 7) * 65536
    text = lambda c: c.cast("string")
    return s.select(
        start.alias("start_ip"), (start + 65536 * (k % 40 + 110) - 1).alias("end_ip"), F.col("n_name").alias("country"),
        F.substring("n_name", 1, 2).alias("country_code"), F.concat(F.lit("R"), text(k)).alias("region"), F.concat(F.lit("T"), text(k)).alias("city"),
        (k % 90).cast("double").alias("latitude"), (k % 180).cast("double").alias("longitude"), (k + 60000).alias("asn"),
        F.concat(F.lit("N"), text(k)).alias("as_name"), F.concat(F.lit("d"), text(k), F.lit(".net")).alias("as_domain"))


shared("w_rng", """SELECT (s_suppkey % 223 + 1) * 16777216 + (s_suppkey % 7) * 65536 AS a, (s_suppkey % 223 + 1) * 16777216 + (s_suppkey % 7) * 65536 + 65536 * (s_suppkey % 40 + 110) - 1 AS z,
 n_name AS country, substring(n_name, 1, 2) AS country_code, 'R' || CAST(s_suppkey AS VARCHAR) AS region, 'T' || CAST(s_suppkey AS VARCHAR) AS city, (s_suppkey % 90)::DOUBLE AS latitude,
 (s_suppkey % 180)::DOUBLE AS longitude, s_suppkey + 60000 AS asn, 'N' || CAST(s_suppkey AS VARCHAR) AS as_name, 'd' || CAST(s_suppkey AS VARCHAR) || '.net' AS as_domain
 FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
shared("w_ip", """SELECT ip, split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536 + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT AS n,
 split_part(ip, '.', 1) IN ('10', '127', '0') OR split_part(ip, '.', 1)::INT >= 224 OR ip LIKE '192.168.%' OR ip LIKE '169.254.%' OR (ip LIKE '172.%' AND split_part(ip, '.', 2)::INT BETWEEN 16 AND 31)
 OR (ip LIKE '100.%' AND split_part(ip, '.', 2)::INT BETWEEN 64 AND 127) OR ip LIKE '192.0.0.%' OR ip LIKE '192.0.2.%' OR (ip LIKE '198.18.%' OR ip LIKE '198.19.%') OR ip LIKE '198.51.100.%' OR ip LIKE '203.0.113.%' AS p
 FROM (SELECT src_ip AS ip FROM c_net UNION SELECT dst_ip FROM c_net)""")
shared("w_geo", """SELECT i.ip, CASE WHEN p THEN 'Private / Reserved' ELSE r.country END AS country, CASE WHEN p THEN 'ZZ' ELSE r.country_code END AS country_code, r.region, r.city, r.latitude, r.longitude, r.asn,
 r.as_name, r.as_domain, p AS is_private, r.latitude IS NOT NULL AS is_mapped FROM w_ip i LEFT JOIN (SELECT * FROM (SELECT ip, g.*, row_number() OVER (PARTITION BY ip ORDER BY z - a, a) AS rn
 FROM w_ip JOIN w_rng g ON n BETWEEN a AND z WHERE NOT p) WHERE rn = 1) r ON r.ip = i.ip""")
shared("w_pt", """SELECT ip, coalesce(dataset_country, g.country) AS country, coalesce(dataset_country, upper(g.country_code)) AS country_code, region, city, latitude, longitude,
 'AS' || CAST(coalesce(dataset_asn, g.asn) AS VARCHAR) AS asn, CASE WHEN coalesce(dataset_asn, g.asn) IS NOT NULL THEN coalesce(as_name, 'AS' || CAST(coalesce(dataset_asn, g.asn) AS VARCHAR)) END AS as_name, as_domain,
 event_count, transaction_count, source_event_count, destination_event_count, first_seen, last_seen, is_mapped FROM w_ep JOIN w_geo g USING (ip)""")


def _points(b: Bench):
    def build():
        points = net.endpoints(b.net)
        return net.map_points(points, net.enrich_ips(points, ip_ranges(b)))
    return b.stored("points", build)


@query("w03_map_points", "SELECT * FROM w_pt")
def points(b: Bench):
    found = net.endpoints(b.net)
    return net.map_points(found, net.enrich_ips(found, ip_ranges(b)))


@query("w04_map_metrics", """SELECT count(*) AS total_ips, count(*) FILTER (is_mapped) AS mapped_ips, count(*) FILTER (NOT is_mapped) AS unmapped_ips,
 count(DISTINCT coalesce(country_code, country)) AS unique_countries, count(DISTINCT asn) AS unique_asns, (SELECT count(*) FROM c_net) AS total_events FROM w_pt""")
def map_metrics(b: Bench):
    return net.map_metrics(_points(b), b.net)


@query("w05_w06_ip_enrichment", "SELECT * FROM w_geo")
def enrichment(b: Bench):
    return net.enrich_ips(net.endpoints(b.net), ip_ranges(b))


# IPv6 addresses and networks made of keys of the given tables, some reserved, some in nested networks
shared("w_six", """SELECT DISTINCT printf('2a%02x:%x::%x', user_id % 40, event_id % 9, event_id % 5) AS ip, printf('2a%02x%04x00000000000000000000%04x', user_id % 40, event_id % 9, event_id % 5) AS key, false AS p FROM events
 UNION SELECT DISTINCT printf('fe80::%x', user_id % 50), printf('fe80000000000000000000000000%04x', user_id % 50), true FROM events""")
shared("w_net6", """SELECT s_suppkey, printf('2a%02x%04x', s_suppkey % 40, s_suppkey % 9) AS prefix, 32 AS bits FROM supplier WHERE s_suppkey % 3 = 0
 UNION ALL SELECT s_suppkey, printf('2a%02x', s_suppkey % 40), 16 FROM supplier WHERE s_suppkey % 3 = 1""")


@query("w05_ipv6_enrichment", """SELECT i.ip, CASE WHEN p THEN 'Private / Reserved' ELSE r.country END AS country, p AS is_private, r.asn, r.asn IS NOT NULL AS is_mapped
 FROM w_six i LEFT JOIN (SELECT * FROM (SELECT i.ip, 'C' || CAST(n.s_suppkey AS VARCHAR) AS country, n.s_suppkey AS asn, row_number() OVER (PARTITION BY i.ip ORDER BY bits DESC, n.s_suppkey) AS rn
  FROM w_six i JOIN (SELECT min(s_suppkey) AS s_suppkey, prefix, bits FROM w_net6 GROUP BY prefix, bits) n ON starts_with(i.key, n.prefix) WHERE NOT p) WHERE rn = 1) r ON r.ip = i.ip""")
def ipv6(b: Bench):
    """Addresses and nested networks of IPv6, by the longest prefix."""
    ev = b.source("events")
    text = lambda *c: F.format_string(*c)
    u, e = F.col("user_id"), F.col("event_id")
    ips = ev.select(text("2a%02x:%x::%x", u % 40, e % 9, e % 5).alias("ip")).union(ev.select(text("fe80::%x", u % 50).alias("ip"))).distinct()
    k = F.col("s_suppkey")
    named = b.source("supplier").where(k % 3 < 2).select(
        F.when(k % 3 == 0, text("2a%02x:%x::/32", k % 40, k % 9)).otherwise(text("2a%02x::/16", k % 40)).alias("network"), "s_suppkey")
    first = named.groupBy("network").agg(F.min("s_suppkey").alias("k"))
    none = F.lit(None).cast("string")
    networks = first.select("network", F.concat(F.lit("C"), F.col("k").cast("string")).alias("country"), none.alias("country_code"), none.alias("region"), none.alias("city"),
                            F.lit(1.0).alias("latitude"), F.lit(1.0).alias("longitude"), F.col("k").cast("bigint").alias("asn"), none.alias("as_name"), none.alias("as_domain"))
    return net.enrich_ips(ips, networks=networks).select("ip", "country", "is_private", "asn", "is_mapped")


shared("w_row", """SELECT n.*, total_output_value_satoshi, risk_score, risk_level FROM c_net n JOIN c_tx USING (transaction_id) JOIN c_res r ON r.entity_id = n.transaction_id AND analysis_id = 'an1'""")


def _rows(b: Bench):
    return net.with_transaction_risk(b.net, b.tx, b.run())


@query("w07_by_country", """SELECT coalesce(country, 'UNKNOWN') AS country, count(*) AS event_count, CAST(sum(total_output_value_satoshi) AS BIGINT) AS value_satoshi,
 count(*) FILTER (risk_score >= 0.65 OR risk_level IN ('high', 'critical')) AS risk_count, count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()::DOUBLE AS share_pct FROM w_row GROUP BY 1""")
def by_country(b: Bench):
    return net.by_country(_rows(b))


@query("w07_by_asn", "SELECT asn, count(*) AS event_count, count(*) FILTER (risk_score >= 0.65 OR risk_level IN ('high', 'critical')) AS risk_count FROM w_row WHERE asn > 0 GROUP BY asn")
def by_asn_rollup(b: Bench):
    return net.by_asn(_rows(b))


@query("w07_top_ips", "SELECT src_ip, count(*) AS event_count, max(risk_score) AS max_risk FROM w_row GROUP BY src_ip ORDER BY 2 DESC, 1 LIMIT 10")
def top_ips(b: Bench):
    return net.top_source_ips(_rows(b))


@query("w07_by_port", """SELECT 'src' AS "end", src_port AS port, count(*) AS event_count FROM w_row GROUP BY 2 UNION ALL SELECT 'dst', dst_port, count(*) FROM w_row GROUP BY 2""")
def by_port(b: Bench):
    return net.by_port(_rows(b))


@query("w07_port_standard", "SELECT count(*) FILTER (dst_port = 8333) AS standard_port, count(*) FILTER (dst_port <> 8333) AS other_port FROM w_row")
def port_standard(b: Bench):
    return net.port_standard(_rows(b))


@query("w07_suspicious_events", "SELECT event_id, risk_score FROM w_row WHERE risk_score >= 0.65 OR risk_level IN ('high', 'critical')")
def suspicious(b: Bench):
    return net.suspicious_events(_rows(b)).select("event_id", "risk_score")


@query("w08_top_countries", "SELECT country, count(*) AS n FROM c_net WHERE country IS NOT NULL GROUP BY country ORDER BY n DESC, country LIMIT 10")
def top_countries(b: Bench):
    return net.top_values(b.net, "country")


@query("w08_top_asns", "SELECT asn, count(*) AS n FROM c_net WHERE asn IS NOT NULL GROUP BY asn ORDER BY n DESC, asn LIMIT 10")
def top_asns(b: Bench):
    return net.top_values(b.net, "asn")


@query("w09_ports_by_label", """SELECT dst_port, count(*) FILTER (ground_truth_label = 0) AS licit, count(*) FILTER (ground_truth_label = 1) AS illicit, count(*) AS total
 FROM c_net JOIN c_lab USING (transaction_id) GROUP BY dst_port""")
def ports_by_label(b: Bench):
    return net.ports_by_label(b.net, b.labels)


@query("w09_standard_port_share", """SELECT ground_truth_label, count(*) AS events, count(*) FILTER (dst_port = 8333) * 100.0::DOUBLE / count(*) AS standard_pct
 FROM c_net JOIN c_lab USING (transaction_id) GROUP BY 1""")
def standard_share(b: Bench):
    return net.standard_port_share(b.net, b.labels)


@query("w10_point_filter", "SELECT ip, asn, country FROM w_pt WHERE is_mapped AND (ip LIKE '%3%' OR lower(asn) LIKE '%3%' OR lower(as_name) LIKE '%3%' OR lower(country) LIKE '%3%') AND coalesce(country_code, country) = 'DE'")
def point_filter(b: Bench):
    return net.filter_points(_points(b), country="DE", mapped=True, text="3").select("ip", "asn", "country")


@query("w10_filter_values", "SELECT 'country' AS field, coalesce(country_code, country) AS value FROM w_pt WHERE coalesce(country_code, country) IS NOT NULL UNION SELECT 'asn', asn FROM w_pt WHERE asn IS NOT NULL")
def filter_values(b: Bench):
    return net.filter_values(_points(b))


@query("w11_country_rollup", """SELECT CASE WHEN is_mapped THEN coalesce(country_code, country, 'Unmapped / Private') ELSE 'Unmapped / Private' END AS country, count(*) AS ip_count,
 CAST(sum(event_count) AS BIGINT) AS event_count FROM w_pt GROUP BY 1""")
def country_rollup(b: Bench):
    return net.country_rollup(_points(b))


@query("w12_peers", """SELECT src_ip, dst_ip, event_count, transaction_count FROM w_flow WHERE src_ip IN (SELECT ip FROM w_pt WHERE is_mapped)
 AND dst_ip IN (SELECT ip FROM w_pt WHERE is_mapped) ORDER BY event_count DESC, src_ip, dst_ip LIMIT 35""")
def peers(b: Bench):
    return net.peers(net.flows(b.net), _points(b), top=35)


@query("w12_peers_of_one", """SELECT src_ip, dst_ip, event_count, transaction_count, CASE WHEN src_ip = m.ip THEN 'outgoing' ELSE 'incoming' END AS direction
 FROM w_flow, (SELECT min(ip) AS ip FROM w_pt WHERE is_mapped) m WHERE src_ip IN (SELECT ip FROM w_pt WHERE is_mapped)
 AND dst_ip IN (SELECT ip FROM w_pt WHERE is_mapped) AND (src_ip = m.ip OR dst_ip = m.ip)""")
def peers_of_one(b: Bench):
    """Both directions of one chosen IP, out of all flows."""
    points = _points(b)
    return net.peers(net.flows(b.net), points, points.where("is_mapped").agg(F.min("ip")).first()[0])


# ---- alerts -------------------------------------------------------------------------------------

SUSPICIOUS = ", ".join(f"'{c}'" for c in schemas.SUSPICIOUS_TYPOLOGIES)
shared("a_row", """SELECT r.entity_id AS transaction_id, r.risk_score, r.risk_level, r.prediction_label AS label, r.confidence, t.timestamp, t.ts, f.* EXCLUDE (transaction_id)
 FROM c_res r JOIN c_tx t ON t.transaction_id = r.entity_id JOIN f_all f ON f.transaction_id = r.entity_id WHERE analysis_id = 'an1'""")
shared("a_sig", f"""SELECT *, risk_score >= 0.5 AS s_ml, label IN ({SUSPICIOUS}) AND confidence >= 0.55 AS s_type,
 time_txs_last_1m >= 5 OR time_txs_last_5m >= 12 OR label = 'transaction_burst' AS s_time,
 rel_fan_in >= 8 OR rel_fan_out >= 8 OR label IN ('high_fan_in', 'high_fan_out') AS s_graph,
 coalesce(net_is_standard_bitcoin_port = 0, false) OR coalesce(net_src_port <> 8333, false) OR coalesce(net_dst_port <> 8333, false) AS s_net FROM a_row""")
shared("a_cat", """SELECT *, (s_ml::INT + s_type::INT + s_time::INT + s_graph::INT + s_net::INT) AS n,
 concat_ws(', ', CASE WHEN s_type THEN 'catboost_typology' END, CASE WHEN s_graph THEN 'graph_topology' END, CASE WHEN s_ml THEN 'ml_xgboost' END,
  CASE WHEN s_net THEN 'network_telemetry' END, CASE WHEN s_time THEN 'temporal_engine' END) AS cats FROM a_sig WHERE s_ml OR s_type OR s_time OR s_graph OR s_net""")
shared("a_cls", """SELECT *, CASE WHEN n >= 2 THEN 'MULTI_SIGNAL' WHEN s_type THEN 'BEHAVIOR_ANOMALY' WHEN s_ml THEN 'HIGH_RISK_TRANSACTION' WHEN s_time THEN 'TEMPORAL_BURST'
  WHEN s_graph THEN 'GRAPH_ANOMALY' ELSE 'NETWORK_ANOMALY' END AS alert_type,
 CASE WHEN n >= 2 THEN 'composite' WHEN s_type THEN 'catboost_typology' WHEN s_ml THEN 'ml_xgboost' WHEN s_time THEN 'temporal_engine' WHEN s_graph THEN 'graph_topology' ELSE 'network_telemetry' END AS trigger_source,
 CASE WHEN n >= 2 OR (s_ml AND NOT s_type) THEN CASE WHEN risk_score >= 0.67 THEN 'critical' ELSE 'high' END WHEN s_type THEN 'high' WHEN s_time THEN CASE WHEN risk_score >= 0.5 THEN 'high' ELSE 'medium' END ELSE 'medium' END AS severity,
 CASE WHEN n >= 2 THEN 'P1' WHEN s_type THEN 'P2' WHEN s_ml THEN CASE WHEN risk_score >= 0.85 THEN 'P1' ELSE 'P2' END WHEN s_time THEN CASE WHEN risk_score >= 0.5 THEN 'P2' ELSE 'P3' END ELSE 'P3' END AS priority FROM a_cat""")
shared("a_key", """SELECT *, CASE WHEN alert_type = 'TEMPORAL_BURST' THEN 'burst:' || CAST(ts // 300 * 300 AS VARCHAR) || ':' || label
 WHEN alert_type = 'NETWORK_ANOMALY' THEN 'net:' || coalesce(net_country, 'UNKNOWN') || ':' || CASE WHEN coalesce(net_asn, 0) = 0 THEN 'UNKNOWN' ELSE CAST(net_asn AS VARCHAR) END
 ELSE 'tx:' || transaction_id END AS grouping_key FROM a_cls""")
shared("a_grp", """SELECT alert_type, grouping_key, count(*) AS transaction_count, arg_max(transaction_id, (risk_score, transaction_id)) AS anchor, max(risk_score) AS risk_score,
 arg_max(severity, (risk_score, transaction_id)) AS sev, arg_max(priority, (risk_score, transaction_id)) AS pri, arg_max(label, (risk_score, transaction_id)) AS behavior_type,
 arg_max(trigger_source, (risk_score, transaction_id)) AS trigger_source, min(timestamp) AS first_seen_at, max(timestamp) AS last_seen_at FROM a_key GROUP BY alert_type, grouping_key""")
shared("a_alert", """SELECT 'alt-' || substring(sha256('an1:' || alert_type || ':' || grouping_key), 1, 16) AS alert_id, 'an1' AS analysis_id, substring(sha256('an1:' || alert_type || ':' || grouping_key), 1, 32) AS fingerprint,
 grouping_key, anchor AS transaction_id, CASE WHEN transaction_count > 1 THEN 'cluster:' || grouping_key ELSE anchor END AS entity_id, CASE WHEN transaction_count > 1 THEN 'cluster' ELSE 'transaction' END AS entity_type,
 alert_type, CASE WHEN risk_score >= 0.67 THEN 'critical' ELSE sev END AS severity, CASE WHEN risk_score >= 0.67 OR sev = 'critical' THEN 'P1' ELSE pri END AS priority, risk_score, behavior_type, trigger_source,
 'NEW' AS status, first_seen_at, last_seen_at, transaction_count FROM a_grp""")


def _candidates(b: Bench):
    return b.tabular_candidates


@query("a01_features_map", "SELECT transaction_id, CAST(rel_fan_in AS VARCHAR) AS rel_fan_in, CAST(net_asn AS VARCHAR) AS net_asn, 3 AS n FROM f_all")
def features_map(b: Bench):
    names = ["rel_fan_in", "net_asn", "net_country"]
    rows = feature_columns(b.short, names)
    m = full_ids(rows.select(TX, al.features_map(al.feature_snapshot(rows, names)).alias("m")))
    return m.select(TX, F.col("m")["rel_fan_in"].alias("rel_fan_in"), F.col("m")["net_asn"].alias("net_asn"), F.size("m").alias("n"))


@query("a02_signals", "SELECT transaction_id, coalesce(cats, '') AS categories FROM a_sig LEFT JOIN (SELECT transaction_id, cats FROM a_cat) USING (transaction_id)")
def signals(b: Bench):
    run = b.short["results"].where(F.col("analysis_id") == "an1")
    rows = run.select(F.col("entity_id").alias(TX), "risk_score", "risk_level", "prediction_label", "confidence").join(with_empty_graph(b.alert_features), TX)
    return al.signals(full_ids(rows)).select(TX, F.array_join(F.array_sort(F.transform("signals", lambda s: s["category"])), ", ").alias("categories"))


@query("a03_classification", """SELECT transaction_id, alert_type, severity, priority, trigger_source, CASE WHEN n >= 2 THEN 'Compound alert: ' || CAST(n AS VARCHAR) || ' independent signals (' || cats || ') fired on transaction'
 WHEN s_ml THEN printf('XGBoost risk score is %.3f (severity: %s)', risk_score, risk_level) WHEN s_type THEN printf('Classified as suspicious typology ''%s'' (confidence: %.1f%%)', label, confidence * 100)
 WHEN s_time THEN printf('High temporal transaction velocity (%d tx/1m, %d tx/5m)', time_txs_last_1m, time_txs_last_5m)
 WHEN s_graph THEN printf('Graph metric anomaly (fan_in=%d, fan_out=%d, comp_size=0, reuse=0.00)', rel_fan_in, rel_fan_out)
 ELSE 'Broadcast via non-standard peer port (src: ' || coalesce(CAST(net_src_port AS VARCHAR), 'None') || ', dst: ' || coalesce(CAST(net_dst_port AS VARCHAR), 'None') || ')' END AS trigger_reason FROM a_cls""")
def classification(b: Bench):
    return _candidates(b).select(TX, "alert_type", "severity", "priority", "trigger_source", "trigger_reason")


@query("a04_grouping_key", "SELECT transaction_id, alert_type, grouping_key FROM a_key")
def grouping_key(b: Bench):
    return _candidates(b).select(TX, "alert_type", "grouping_key")


@query("a05_a06_alerts", "SELECT * FROM a_alert")
def grouped(b: Bench):
    out = al.group(_candidates(b), "an1", "bench")
    return out.drop("dataset_id", "metadata", "trigger_reason")


@query("a05_alert_members", "SELECT alert_id, k.transaction_id, k.risk_score FROM a_key k JOIN a_alert a USING (alert_type, grouping_key)")
def members(b: Bench):
    return al.alert_members(_candidates(b), b.tabular_alerts)


@query("a07_evidence", """SELECT alert_id, concat_ws(',', CASE WHEN bool_or(s_type) THEN 'catboost_typology' END, CASE WHEN bool_or(s_graph) THEN 'graph_topology' END, CASE WHEN bool_or(s_ml) THEN 'ml_xgboost' END,
  CASE WHEN bool_or(s_net) THEN 'network_telemetry' END, CASE WHEN bool_or(s_time) THEN 'temporal_engine' END) AS triggering_signals, arg_max(rel_fan_out, (k.risk_score, k.transaction_id)) AS rel_fan_out,
 arg_max(tx_fee_sats, (k.risk_score, k.transaction_id)) AS tx_fee_sats FROM a_key k JOIN a_alert a USING (alert_type, grouping_key) GROUP BY alert_id""")
def evidence(b: Bench):
    return b.tabular_alerts.select("alert_id", F.array_join("metadata.triggering_signals", ",").alias("triggering_signals"),
                                   F.col("metadata.source_features.rel_fan_out").alias("rel_fan_out"),
                                   F.col("metadata.source_features.tx_fee_sats").alias("tx_fee_sats"))


@query("a02_a07_alerts_with_graph")
def alerts_with_graph(b: Bench):
    joined = b.alert_features.join(b.alert_history, TX)
    return al.group(b.candidates(joined), "an1", "bench").drop("metadata")


@query("a08_alert_listing", """SELECT alert_id, severity, risk_score FROM a_alert WHERE severity = 'critical' AND priority = 'P1' AND alert_type = 'MULTI_SIGNAL' AND risk_score >= 0.8
 AND (alert_id LIKE '%ab%' OR entity_id LIKE '%ab%' OR transaction_id LIKE '%ab%' OR behavior_type LIKE '%ab%')""")
def listing(b: Bench):
    return al.listing(b.tabular_alerts, "active", "critical", "multi_signal", "p1", 0.8).where(
        F.col("alert_id").contains("ab") | F.col("entity_id").contains("ab") | F.col(TX).contains("ab") | F.col("behavior_type").contains("ab")
    ).select("alert_id", "severity", "risk_score")


@query("a08_alert_page", """SELECT alert_id, severity, priority FROM a_alert ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, alert_id LIMIT 50""")
def alert_page(b: Bench):
    return al.sorted_alerts(al.listing(b.tabular_alerts, status="NEW,INVESTIGATING"), "severity").limit(50).select("alert_id", "severity", "priority")


@query("a09_alert_summary", """SELECT 'total' AS dimension, 'all' AS value, count(*) AS n FROM a_alert UNION ALL SELECT 'active', 'all', count(*) FROM a_alert UNION ALL SELECT 'severity', severity, count(*) FROM a_alert GROUP BY severity
 UNION ALL SELECT 'status', status, count(*) FROM a_alert GROUP BY status UNION ALL SELECT 'type', alert_type, count(*) FROM a_alert GROUP BY alert_type""")
def alert_summary(b: Bench):
    return al.summary(b.tabular_alerts)


_AT = "2001-01-01 00:00:00"


@query("a10_alert_updates", f"""SELECT alert_id, CASE WHEN alert_type = 'NETWORK_ANOMALY' THEN 'DISMISSED' WHEN alert_type = 'GRAPH_ANOMALY' THEN 'INVESTIGATING' ELSE 'NEW' END AS status,
 CASE WHEN alert_type = 'GRAPH_ANOMALY' THEN 'P4' ELSE priority END AS priority, CASE WHEN alert_type = 'GRAPH_ANOMALY' THEN TIMESTAMP '{_AT}' END AS acknowledged_at,
 CASE WHEN alert_type = 'NETWORK_ANOMALY' THEN TIMESTAMP '{_AT}' END AS resolved_at FROM a_alert""")
def updates(b: Bench):
    kind = F.col("alert_type")
    changes = b.tabular_alerts.where(kind.isin("NETWORK_ANOMALY", "GRAPH_ANOMALY")).select(
        "alert_id", F.when(kind == "NETWORK_ANOMALY", "dismissed").otherwise("Investigating").alias("new_status"),
        F.when(kind == "GRAPH_ANOMALY", "p4").alias("new_priority"), F.lit(_AT).cast("timestamp").alias("at"))
    return al.apply_updates(b.tabular_alerts, changes).select("alert_id", "status", "priority", "acknowledged_at", "resolved_at")


@query("a11_delete_run", "SELECT count(*) AS n FROM a_alert WHERE analysis_id <> 'an1'")
def delete_run(b: Bench):
    return al.delete_run(b.tabular_alerts, "an1").agg(F.count(F.lit(1)).alias("n"))


@query("a12_alert_matches", """SELECT 'bench' AS dataset_id, count(*) AS alerts, count(*) FILTER (transaction_id IN (SELECT transaction_id FROM c_tx) OR entity_id IN (SELECT transaction_id FROM c_tx)) AS matched_alerts,
 count(*) FILTER (transaction_id IN (SELECT transaction_id FROM c_tx)) AS matches FROM a_alert""")
def alert_matches(b: Bench):
    return al.matches(b.tabular_alerts, b.tx)


@query("a13_latest_per_entity", """SELECT entity_id, count(*) AS n_alerts, arg_max(alert_id, (last_seen_at, alert_id)) AS latest_alert, max(last_seen_at) AS latest_at, max(risk_score) AS max_risk
 FROM a_alert GROUP BY entity_id""")
def latest_alerts(b: Bench):
    return al.latest_per_entity(b.tabular_alerts)


@query("a14_alert_queue", """SELECT alert_id, risk_score FROM a_alert WHERE entity_type = 'cluster' AND risk_score >= 0.2 AND (lower(entity_id) LIKE '%net:%' OR lower(alert_id) LIKE '%net:%')""")
def queue(b: Bench):
    return al.queue(b.tabular_alerts, "cluster", 0.2, "NET:").select("alert_id", "risk_score")


@query("s13_s14_alert_save", "SELECT alert_id, CASE WHEN severity = 'critical' THEN 'ESCALATED' ELSE status END AS status FROM a_alert")
def save(b: Bench):
    old = b.tabular_alerts.drop("metadata")
    return al.save(old, old.where(F.col("severity") == "critical").withColumn("status", F.lit("ESCALATED"))).select("alert_id", "status")
