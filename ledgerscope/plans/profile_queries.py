"""Exploration audits and dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope.operators import dashboard as d, profile as p, quality
from ledgerscope.plans.bench import Bench, TX
from ledgerscope.plans.oracles import shared
from ledgerscope.plans.registry import query
from ledgerscope.schemas import MATRIX_FEATURES

_NAMES = ["tx_fee_sats", "tx_size_bytes", "tx_total_output_sats", "addr_hist_tx_count", "net_src_port", "rel_change_value_ratio"]
#: All columns of the matrix that are numbers.
_ALL = [c for c in MATRIX_FEATURES if c not in ("net_country", "net_asn")]


def _round(df, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("e01_row_counts", """SELECT 'transactions' AS table_name, count(*) AS n_rows FROM c_tx UNION ALL SELECT 'transaction_inputs', count(*) FROM c_in UNION ALL
 SELECT 'transaction_outputs', count(*) FROM c_out UNION ALL SELECT 'network_events', count(*) FROM c_net UNION ALL SELECT 'labels', count(*) FROM c_lab UNION ALL SELECT 'results', count(*) FROM c_res""")
def row_counts(b: Bench):
    return p.row_counts(b.tables)


@query("e02_column_profile", " UNION ALL ".join(f"""SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(min({c})::DOUBLE, 6) AS min, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25,
 round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75, round(quantile_cont({c}::DOUBLE, 0.95), 6) AS p95, round(max({c})::DOUBLE, 6) AS max,
 round(skewness({c}::DOUBLE), 5) AS skew FROM f_all""" for c in _ALL))
def column_profile(b: Bench):
    out = p.column_profile(b.features, _ALL)
    return _round(out.drop("std", "skew")).join(out.select("feature", F.round("skew", 5).alias("skew")), "feature")


@query("e02_column_spread", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(stddev_samp({c}::DOUBLE), 3) AS std FROM f_all" for c in _NAMES))
def column_spread(b: Bench):
    return _round(p.column_profile(b.features, _NAMES).select("feature", "std"), 3)


@query("e03_cardinality", " UNION ALL ".join(f"""SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct, CASE WHEN count(DISTINCT {c}) = 2 THEN 'Binary' WHEN count(DISTINCT {c}) < 50 THEN 'Discrete'
 ELSE 'Continuous' END AS kind FROM f_all""" for c in _ALL))
def cardinality(b: Bench):
    return p.cardinality(b.features, _ALL)


@query("e04_iqr_outliers", " UNION ALL ".join(f"""SELECT '{c}' AS feature, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers,
 count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) * 100.0::DOUBLE / count({c}) AS outlier_pct
 FROM f_all, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM f_all)""" for c in _ALL))
def outliers(b: Bench):
    return p.iqr_outliers(b.features, _ALL)


@query("e05_correlations", " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, round(corr({x}::DOUBLE, {y}::DOUBLE), 6) AS r FROM f_all"
                                              for i, x in enumerate(_NAMES) for y in _NAMES[i + 1:]))
def correlations(b: Bench):
    return _round(p.correlations(b.features, _NAMES))


@query("e05_redundant_pairs", """SELECT 'addr_hist_tx_count' AS a, 'addr_reuse_count' AS b""")
def redundant(b: Bench):
    names = ["addr_hist_tx_count", "addr_reuse_count", "tx_fee_sats", "rel_fan_in"]
    return p.redundant_pairs(p.correlations(b.features, names)).select("a", "b")


@query("e06_group_comparison", " UNION ALL ".join(f"""SELECT ground_truth_label, '{c}' AS feature, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median, round(avg({c}), 6) AS mean
 FROM f_all JOIN c_lab USING (transaction_id) GROUP BY 1""" for c in _ALL))
def comparison(b: Bench):
    return _round(p.group_comparison(b.features.join(b.labels.select(TX, "ground_truth_label"), TX), _ALL, "ground_truth_label"))


@query("e07_ledger_span", """SELECT count(*) AS n_transactions, min(timestamp) AS first_at, max(timestamp) AS last_at, CAST(sum(total_output_value_satoshi) AS BIGINT) AS volume_satoshi,
 CAST(sum(fee_satoshi) AS BIGINT) AS fees_satoshi, avg(fee_satoshi) AS avg_fee, min(fee_satoshi) AS min_fee, max(fee_satoshi) AS max_fee FROM c_tx""")
def span(b: Bench):
    return p.ledger_span(b.tx)


@query("e08_histograms", """SELECT 'fee' AS series, CASE WHEN fee_satoshi < 1000 THEN 0 WHEN fee_satoshi >= 10000 THEN 21 ELSE CAST(floor((fee_satoshi - 1000) / 450.0::DOUBLE) + 1 AS BIGINT) END AS bin, count(*) AS n FROM c_tx GROUP BY 2
 UNION ALL SELECT 'fan_out', CASE WHEN output_count < 0 THEN 0 WHEN output_count >= 20 THEN 11 ELSE CAST(floor(output_count / 2.0::DOUBLE) + 1 AS BIGINT) END, count(*) FROM c_tx GROUP BY 2""")
def histograms(b: Bench):
    fee = p.histogram(b.tx, "fee_satoshi", 1000, 10000, 20).select(F.lit("fee").alias("series"), "bin", "n")
    return fee.unionByName(p.histogram(b.tx, "output_count", 0, 20, 10).select(F.lit("fan_out").alias("series"), "bin", "n"))


@query("e08_degree_histograms", """SELECT 'in_degree' AS series, least(in_degree, 19)::BIGINT AS degree, count(*) AS n FROM g_deg GROUP BY 2
 UNION ALL SELECT 'out_degree', least(out_degree, 19)::BIGINT, count(*) FROM g_deg GROUP BY 2""")
def degree_histograms(b: Bench):
    return p.degree_histograms(b.nodes)


@query("e08_fan_in_histogram", """SELECT CASE WHEN n >= 20 THEN 11 ELSE CAST(floor(n / 2.0::DOUBLE) + 1 AS BIGINT) END AS bin, count(*) AS n FROM (SELECT count(DISTINCT input_address) AS n FROM c_in GROUP BY transaction_id) GROUP BY 1""")
def fan_in_histogram(b: Bench):
    fan = b.ins.groupBy(TX).agg(F.count_distinct("input_address").alias("fan_in"))
    return p.histogram(fan, "fan_in", 0, 20, 10)


@query("e08_log_value_histogram", """SELECT CASE WHEN v < 4 THEN 0 WHEN v >= 9 THEN 26 ELSE CAST(floor(25 * (v - 4) / 5.0::DOUBLE) + 1 AS BIGINT) END AS bin, count(*) AS n
 FROM (SELECT log10(total_output_value_satoshi::DOUBLE) AS v FROM c_tx) GROUP BY 1""")
def log_histogram(b: Bench):
    return p.histogram(b.tx, "total_output_value_satoshi", 4, 9, 25, log10=True)


@query("e09_class_counts", "SELECT behavior_type, ground_truth_label, count(*) AS n FROM c_lab GROUP BY 1, 2")
def class_counts(b: Bench):
    return p.class_counts(b.labels)


@query("e10_compare_classes", """WITH s AS (SELECT * FROM m_split), a AS (SELECT behavior_type, count(*) AS n FROM s WHERE temporal_split = 'train' GROUP BY 1), b AS (SELECT behavior_type, count(*) AS n FROM s WHERE temporal_split = 'test' AND behavior_type <> 'normal' GROUP BY 1)
 SELECT behavior_type, coalesce(a.n, 0) AS n_first, round(coalesce(a.n / (SELECT sum(n) FROM a)::DOUBLE * 100, 0), 9) AS pct_first, coalesce(b.n, 0) AS n_second, round(coalesce(b.n / (SELECT sum(n) FROM b)::DOUBLE * 100, 0), 9) AS pct_second FROM a FULL JOIN b USING (behavior_type)""")
def compare_classes(b: Bench):
    first, second = (b.split.where(F.col("temporal_split") == x) for x in ("train", "test"))
    return _round(p.compare_classes(first, second.where(F.col("behavior_type") != "normal")), 9)


@query("e11_class_shape", """SELECT behavior_type, count(*) AS n, round(avg(rel_change_value_ratio), 9) AS avg_change_ratio, min(rel_change_value_ratio) AS min_change_ratio, max(rel_change_value_ratio) AS max_change_ratio,
 avg(tx_input_count) AS avg_inputs, avg(tx_output_count) AS avg_outputs, max(tx_input_count) AS max_inputs, max(tx_output_count) AS max_outputs FROM f_all JOIN c_lab USING (transaction_id) GROUP BY 1""")
def class_shape(b: Bench):
    return p.class_shape(b.features, b.labels).withColumn("avg_change_ratio", F.round("avg_change_ratio", 9))


@query("e11_compare_shapes", """SELECT behavior_type, count(*) FILTER (temporal_split = 'train') AS n_first, count(*) FILTER (temporal_split = 'test') AS n_second,
 avg(tx_output_count) FILTER (temporal_split = 'train') AS avg_outputs_first, avg(tx_output_count) FILTER (temporal_split = 'test') AS avg_outputs_second
 FROM f_all JOIN m_split USING (transaction_id) GROUP BY 1""")
def compare_shapes(b: Bench):
    one = lambda x: p.class_shape(b.features, b.split.where(F.col("temporal_split") == x))
    return p.compare_shapes(one("train"), one("test")).select("behavior_type", "n_first", "n_second", "avg_outputs_first", "avg_outputs_second")


@query("e12_null_and_duplicate_audit", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS null_count, 0 AS inf_count, 0 AS duplicates FROM f_all" for c in [*_ALL, "net_asn"]))
def audit(b: Bench):
    a = quality.feature_audit(b.features, [*_ALL, "net_asn"]).drop("is_constant")
    twice = quality.duplicate_keys(b.features, [TX], "x").select(F.col("violations").alias("duplicates"), F.lit(1).alias("_j"))
    return a.withColumn("_j", F.lit(1)).join(twice, "_j").drop("_j")


@query("e13_class_shares", "SELECT behavior_type, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM c_lab GROUP BY 1")
def class_shares(b: Bench):
    return p.class_shares(b.labels)


# ---- dashboard ----------------------------------------------------------------------------------

shared("d_ov", """SELECT prediction_label AS behavior_type, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM c_res WHERE analysis_id = 'an1') AS pct, round(avg(risk_score) * 100, 6) AS average_risk,
 count(*) FILTER (risk_level = 'low') AS low_count, count(*) FILTER (risk_level = 'medium') AS medium_count, count(*) FILTER (risk_level = 'high') AS high_count, count(*) FILTER (risk_level = 'critical') AS critical_count,
 prediction_label NOT IN ('normal', 'benign_high_volume') AS is_suspicious FROM c_res WHERE analysis_id = 'an1' GROUP BY prediction_label""")


@query("d01_behaviour_overview", "SELECT * FROM d_ov")
def overview(b: Bench):
    return d.behaviour_overview(b.run()).withColumn("average_risk", F.round("average_risk", 6))


@query("d01_empty_classes", """SELECT behavior_type, CASE WHEN behavior_type = 'normal' THEN n ELSE 0 END AS n, CASE behavior_type WHEN 'normal' THEN average_risk WHEN 'benign_high_volume' THEN 12.0 ELSE 75.0 END AS average_risk FROM d_ov""")
def empty_classes(b: Bench):
    return d.behaviour_overview(b.run().where(F.col("prediction_label") == "normal")).select(
        "behavior_type", "n", F.round("average_risk", 6).alias("average_risk"))


@query("d01_behaviour_top", """SELECT prediction_label AS behavior_type, CAST(rn AS INTEGER) AS rank, entity_id, risk_score, risk_level, predicted_at, CAST(CAST(total_output_value_satoshi / 100000000::DECIMAL(28, 8) AS DECIMAL(28, 8)) AS VARCHAR) AS amount_btc FROM (
 SELECT *, row_number() OVER (PARTITION BY prediction_label ORDER BY risk_score DESC, entity_id) AS rn FROM c_res WHERE analysis_id = 'an1') JOIN c_tx ON transaction_id = entity_id WHERE rn <= 5""")
def top(b: Bench):
    return d.behaviour_top(b.run(), b.tx)


@query("d01_top_addresses", """SELECT prediction_label AS behavior_type, CAST(rn AS INTEGER) AS rank, a AS entity_id, r.risk_score AS risk_score, r.risk_level AS risk_level, r.predicted_at AS predicted_at FROM (
 SELECT *, row_number() OVER (PARTITION BY prediction_label ORDER BY r.risk_score DESC, a) AS rn FROM (SELECT prediction_label, a, max({'risk_score': risk_score, 'transaction_id': transaction_id, 'risk_level': risk_level, 'predicted_at': predicted_at}) AS r
  FROM g_app JOIN c_res ON entity_id = transaction_id AND analysis_id = 'an1' GROUP BY ALL)) WHERE rn <= 5""")
def top_addresses(b: Bench):
    """The five riskiest addresses of every class."""
    return d.behaviour_top(d.address_results(b.run(), b.ins, b.outs), b.tx, "address")


@query("d02_kpis", """SELECT (SELECT count(*) FROM c_tx) AS total_transactions, (SELECT count(*) FROM c_addr) AS total_entities, count(*) FILTER (risk_level IN ('high', 'critical')) AS high_risk_entities,
 max(predicted_at) AS last_processed, (SELECT count(*) FROM a_alert) AS active_alerts, (SELECT count(*) FROM a_alert) AS anomalies_detected FROM c_res WHERE analysis_id = 'an1'""")
def kpis(b: Bench):
    return d.kpis(b.tx, b.addresses, b.run(), b.tabular_alerts)


@query("d03_anomaly_series", """WITH t AS (SELECT transaction_id, ts * 1000 AS t, risk_level IN ('high', 'critical') AS bad FROM c_tx JOIN c_res ON entity_id = transaction_id AND analysis_id = 'an1'),
 s AS (SELECT min(t) AS a, (max(t) - min(t)) / 10.0::DOUBLE AS w FROM t)
 SELECT b AS bucket, CAST(floor((a + b * w) / 1000) AS BIGINT) AS bucket_start_sec, count(transaction_id) AS transactions, count(*) FILTER (bad) AS anomalies
 FROM range(10) g(b) CROSS JOIN s LEFT JOIN t ON least(CAST(floor((t - a) / w) AS BIGINT), 9) = b GROUP BY b, a, w""")
def series(b: Bench):
    return d.anomaly_series(b.tx, b.run())


@query("d04_dataset_profile", """SELECT count(*) AS total_transactions, (SELECT count(*) FROM c_addr) AS total_addresses, min(timestamp) AS first_at, max(timestamp) AS last_at, (SELECT count(DISTINCT country) FROM c_net) AS country_count,
 (SELECT count(DISTINCT asn) FROM c_net) AS asn_count, (SELECT count(*) FILTER (risk_level IN ('high', 'critical')) * 100.0::DOUBLE / count(*) FROM c_res WHERE analysis_id = 'an1') AS suspicious_pct,
 count(*) + (SELECT count(*) FROM c_addr) AS graph_nodes, (SELECT count(*) FROM g_edge) AS graph_edges, (SELECT count(*) FROM c_res WHERE analysis_id = 'an1') AS scored_count, 1.0::DOUBLE AS scored_share FROM c_tx""")
def dataset_profile(b: Bench):
    return d.dataset_profile(b.tables, b.addresses, b.run())


@query("d04_class_distribution", "SELECT prediction_label AS behavior_type, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM c_res WHERE analysis_id = 'an1' GROUP BY 1")
def class_distribution(b: Bench):
    return d.class_distribution(b.run())


@query("d05_dataset_info", """WITH h AS (SELECT count(*) AS n, count(DISTINCT block_height) AS blocks, CAST(round((max(ts) - min(ts)) / 3600.0::DOUBLE) AS BIGINT) AS hours FROM c_tx),
 r AS (SELECT count(*) AS e, count(*) FILTER (risk_level IN ('high', 'critical')) AS f FROM c_res WHERE analysis_id = 'an1')
 SELECT n AS transactions, blocks, (SELECT count(*) FROM c_addr) AS addresses, e AS entities, f AS flagged, e - f AS lower_risk, CAST(CAST(round(hours / 24.0::DOUBLE) AS BIGINT) AS VARCHAR) || 'd' AS span FROM h, r""")
def info(b: Bench):
    return d.dataset_info(b.tx, b.addresses, b.run())


@query("d06_behaviour_totals", """SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) FILTER (is_suspicious) AS BIGINT) AS suspicious, CAST(sum(n) FILTER (NOT is_suspicious) AS BIGINT) AS benign,
 (sum(n) FILTER (is_suspicious))::DOUBLE * 100.0::DOUBLE / sum(n)::DOUBLE AS suspicious_pct, arg_max(behavior_type, (n, behavior_type)) AS top_behavior FROM d_ov""")
def totals(b: Bench):
    return d.behaviour_totals(d.behaviour_overview(b.run()))


@query("d06_behaviour_list", "SELECT behavior_type, n, average_risk FROM d_ov WHERE is_suspicious AND behavior_type LIKE '%in%'")
def listing(b: Bench):
    return d.behaviour_list(d.behaviour_overview(b.run()), "suspicious", "IN", by_risk=True).select(
        "behavior_type", "n", F.round("average_risk", 6).alias("average_risk"))


@query("d07_cluster_filter")
def cluster_filter(b: Bench):
    from ledgerscope.operators import graph as g
    found = b.stored("inferred", lambda: g.inferred_clusters(b.payment_groups, b.tables, b.addresses, b.run(), b.tabular_alerts))
    return d.filter_clusters(found, b.payment_groups, text="c1")
