"""Sources, upload mapping, cleaning, normalisation and data quality."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions import exprs as X
from ledgerscope.operators import clean, ingest, quality
from ledgerscope.plans.bench import Bench, TX, money
from ledgerscope.plans.oracles import shared
from ledgerscope.plans.registry import query
from ledgerscope.sources.bench_tables import full_ids
from ledgerscope.session import shared_folder
from ledgerscope.sources import readers, sinks

text = lambda c: c.cast("string")
_SHIFT = 631_152_000  # moves order dates into the range of plausible epoch seconds


# ---- uploads written the way people send them ---------------------------------------------------

def flat_upload(b: Bench) -> DataFrame:
    """Orders as one flat file: mixed time spellings, mixed amount units, messy labels and ASNs."""
    k = F.col("o_orderkey")
    sec = F.unix_timestamp("o_orderdate") + _SHIFT
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return b.source("orders").select(
        F.when(k % 50 != 0, F.concat(F.lit("T"), text(k))).alias("Hash"),
        F.when(k % 4 == 0, text(sec)).when(k % 4 == 1, text(sec * 1000)).when(
            k % 4 == 2, F.date_format(F.timestamp_seconds(sec), "yyyy-MM-dd HH:mm:ss")).otherwise("soon").alias("Time"),
        F.when(k % 3 == 0, F.concat(text(F.expr("cast(round(o_totalprice * 100) as bigint) div 100000000")), F.lit("."),
                                    F.lpad(text(cents % 100000000), 8, "0")))
        .when(k % 3 == 1, text(cents)).otherwise(F.concat(text(k % 90 + 10), F.lit("e-6"))).alias("amount"),
        F.when(k % 7 != 0, text(k % 1000 + 100)).alias("fee_satoshi"),
        F.concat(F.lit("C"), text(F.col("o_custkey"))).alias("sender"),
        F.when(k % 13 != 0, F.concat(F.lit("S"), text(k % 100))).alias("receiver"),
        F.when(k % 5 == 0, "1").when(k % 5 == 1, "licit").when(k % 5 == 2, "True").when(k % 5 == 3, "0").otherwise("?").alias("class"),
        F.concat(F.lit("9."), text(k % 250), F.lit(".1."), text(k % 9)).alias("source_ip"),
        text(k % 60000 + 1).alias("source_port"), F.lit("8333").alias("dest_port"),
        F.when(k % 6 == 0, " us ").otherwise("de").alias("country"),
        F.when(k % 4 == 0, F.concat(F.lit("AS"), text(k % 500))).when(k % 4 == 1, F.concat(F.lit(" as"), text(k % 500), F.lit(" ")))
        .when(k % 4 == 2, "-5").otherwise("none").alias("asn"))


shared("u_flat", f"""SELECT CASE WHEN o_orderkey % 50 <> 0 THEN 'T' || CAST(o_orderkey AS VARCHAR) END AS id, o_orderkey AS k,
 CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_orderdate + INTERVAL {_SHIFT} SECOND END AS ts,
 CAST(CASE o_orderkey % 3 WHEN 2 THEN round((o_orderkey % 90 + 10) * 100) ELSE round(o_totalprice * 100) END AS BIGINT) AS amount,
 CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 1000 + 100 END AS fee, 'C' || CAST(o_custkey AS VARCHAR) AS sender,
 CASE WHEN o_orderkey % 13 <> 0 THEN 'S' || CAST(o_orderkey % 100 AS VARCHAR) END AS receiver,
 CASE o_orderkey % 5 WHEN 0 THEN 'illicit' WHEN 1 THEN 'licit' WHEN 2 THEN 'illicit' WHEN 3 THEN 'licit' ELSE 'unknown' END AS label,
 '9.' || CAST(o_orderkey % 250 AS VARCHAR) || '.1.' || CAST(o_orderkey % 9 AS VARCHAR) AS src_ip, o_orderkey % 60000 + 1 AS src_port,
 CASE WHEN o_orderkey % 6 = 0 THEN 'US' ELSE 'DE' END AS country,
 CASE WHEN o_orderkey % 4 IN (0, 1) AND o_orderkey % 500 > 0 THEN o_orderkey % 500 END AS asn FROM orders""")


def nested_upload(b: Bench) -> DataFrame:
    """Orders with one to five recipients as quoted lists in text columns; some amount lists are one short."""
    k = F.col("o_orderkey")
    n = (k % 5 + 1).cast("int")
    m = F.when((k % 9 == 0) & (n > 1), n - 1).otherwise(n)
    listed = lambda items: F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    return b.source("orders").select(
        F.sha2(text(k), 256).alias("txid"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"),
        listed(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("'A"), text(k * i % 1000), F.lit("'")))).alias("output_addresses"),
        listed(F.transform(F.sequence(F.lit(1), m), lambda i: text(k * i * 37 % 100000 + 1))).alias("output_amounts"),
        F.concat(F.lit("['C"), text(F.col("o_custkey")), F.lit("']")).alias("input_addresses"), F.lit("[5000000000]").alias("input_amounts"),
        (k % 1000).alias("fee"))


def consolidated(b: Bench) -> DataFrame:
    """The same nested rows with real lists and network fields."""
    up = nested_upload(b)
    return up.select(
        F.upper("txid").alias("txid"), F.col("timestamp").cast("timestamp").alias("timestamp"),
        X.parse_list("input_addresses", "string").alias("input_addresses"), X.parse_list("input_amounts", "bigint").alias("input_amounts"),
        X.parse_list("output_addresses", "string").alias("output_addresses"), X.parse_list("output_amounts", "bigint").alias("output_amounts"),
        "fee", F.lit("p2pkh").alias("script_type"), F.lit(" 9.9.9.9 ").alias("src_ip"), F.lit(8333).alias("src_port"),
        F.lit("8.8.8.8").alias("dst_ip"), F.lit(8333).alias("dst_port"), F.lit("nl").alias("country"), F.lit("AS99").alias("asn"),
        F.lit("scenario").alias("scenario_id"))


shared("u_nest", """SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS transaction_id, o_orderkey AS k, o_orderdate AS timestamp, o_orderkey % 1000 AS fee_satoshi, o_orderkey % 5 + 1 AS n,
 unnest(range(o_orderkey % 5 + 1)) AS output_index FROM orders""")
shared("u_pair", """SELECT transaction_id, CAST(output_index AS INTEGER) AS output_index, 'A' || CAST(k * (output_index + 1) % 1000 AS VARCHAR) AS output_address,
 k * (output_index + 1) * 37 % 100000 + 1 AS output_value_satoshi FROM u_nest WHERE NOT (k % 9 = 0 AND n > 1 AND output_index = n - 1)""")


# ---- sources and sinks --------------------------------------------------------------------------

@query("s01_table_directory", """SELECT 'labels' AS table_name, count(*) AS n_rows FROM labels UNION ALL
 SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events
 UNION ALL SELECT 'transactions', 0""")
def s01(b):
    from ledgerscope import schemas
    wanted = {"labels": schemas.RAW_LABELS, "transactions": schemas.RAW_TRANSACTIONS, "orders": schemas.ADDRESSES,
              "lineitem": schemas.ADDRESSES, "events": schemas.ADDRESSES}
    return sinks.table_counts(readers.read_table_directory(b.spark, b.folder, wanted))


@query("s05_parquet_scan", """SELECT event_id, event_type, value FROM events WHERE event_type = 'error'""")
def s05(b):
    return readers.read_upload(b.spark, f"{b.folder}/events.parquet").where(F.col("event_type") == "error").select(
        "event_id", "event_type", "value")


@query("s07_dataset_scan", """SELECT 'transactions' AS table_name, count(*) AS n_rows FROM c_tx UNION ALL SELECT 'transaction_inputs', count(*) FROM c_in
 UNION ALL SELECT 'transaction_outputs', count(*) FROM c_out UNION ALL SELECT 'network_events', count(*) FROM c_net""")
def s07(b):
    names = ["transactions", "transaction_inputs", "transaction_outputs", "network_events"]
    return sinks.table_counts(readers.read_dataset({n: b.tables[n] for n in names}, "bench"))


def _two_datasets(b, label: str) -> str:
    """Two datasets written one after the other into the same folder, the second with fees raised by one."""
    folder = f"{shared_folder(b.spark)}/{label}-{uuid.uuid4().hex}"
    other = b.tx.withColumn("dataset_id", F.lit("other")).withColumn("fee_satoshi", F.col("fee_satoshi") + 1)
    sinks.write_tables({"transactions": b.tx, "network_events": b.net}, folder, sort_by={"transactions": [TX]})
    sinks.write_tables({"transactions": other}, folder, sort_by={"transactions": [TX]})
    return folder


@query("s09_parquet_sink", """SELECT 'bench' AS dataset_id, transaction_id, timestamp, fee_satoshi FROM c_tx
 UNION ALL SELECT 'other', transaction_id, timestamp, fee_satoshi + 1 FROM c_tx""")
def s09(b):
    return b.spark.read.parquet(f"{_two_datasets(b, 'sink')}/transactions.parquet").select("dataset_id", TX, "timestamp", "fee_satoshi")


@query("s11_artifact_folder", "SELECT 'transactions' AS table_name, 2 * count(*) AS n_rows FROM c_tx UNION ALL SELECT 'network_events', count(*) FROM c_net")
def s11(b):
    folder = _two_datasets(b, "artifacts")
    return sinks.table_counts({n: b.spark.read.parquet(f"{folder}/{n}.parquet") for n in ("transactions", "network_events")})


@query("s13_upsert", """SELECT transaction_id, CASE WHEN k % 3 = 0 THEN fee_satoshi + 1 ELSE fee_satoshi END AS fee_satoshi FROM c_tx""")
def s13(b):
    old = b.tx.select(TX, "fee_satoshi")
    new = old.where(F.substring(TX, 1, 1) >= "0").join(
        b.source("orders").where(F.col("o_orderkey") % 3 == 0).select(F.sha2(text(F.col("o_orderkey")), 256).alias(TX)), TX, "left_semi")
    return sinks.upsert(old, new.withColumn("fee_satoshi", F.col("fee_satoshi") + 1), [TX])


@query("s14_delete_then_insert", """SELECT analysis_id, entity_id, CASE WHEN analysis_id = 'an1' AND risk_score >= 0.5 THEN 1.0 ELSE risk_score END AS risk_score
 FROM c_res""")
def s14(b):
    old = b.results.select("analysis_id", "entity_id", "risk_score")
    new = old.where((F.col("analysis_id") == "an1") & (F.col("risk_score") >= 0.5)).withColumn("risk_score", F.lit(1.0))
    return sinks.replace_by_key(old, new, ["analysis_id", "entity_id"])


@query("s15_dataset_delete", "SELECT 'transactions' AS table_name, 'bench' AS dataset_id, count(*) AS n_rows, sum(fee_satoshi) AS fees FROM c_tx")
def s15(b):
    """Of two stored datasets one is dropped; the other must be whole."""
    folder = _two_datasets(b, "drop")
    sinks.drop_dataset(b.spark, folder, ["transactions", "network_events"], "other")
    left = b.spark.read.parquet(f"{folder}/transactions.parquet")
    return left.groupBy(F.lit("transactions").alias("table_name"), "dataset_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("fee_satoshi").alias("fees"))


@query("s16_load_all_or_nothing", "SELECT 'transactions' AS table_name, 2 * count(*) AS n_rows FROM c_tx UNION ALL SELECT 'network_events', count(*) FROM c_net")
def s16_load(b):
    """The load itself, run twice onto the same target."""
    folder, target = _two_datasets(b, "load"), f"{shared_folder(b.spark)}/loaded-{uuid.uuid4().hex}"
    sinks.load_all_or_nothing(b.spark, folder, target, ["transactions", "network_events"])
    return sinks.load_all_or_nothing(b.spark, folder, target, ["transactions", "network_events"])


@query("s16_load_counts_and_labels", """SELECT 'transactions' AS entity, 'rows' AS metric, count(*) AS n FROM c_tx UNION ALL
 SELECT 'labels', behavior_type, count(*) FROM c_lab GROUP BY behavior_type""")
def s16(b):
    rows = b.tx.groupBy(F.lit("transactions").alias("entity"), F.lit("rows").alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(b.labels.groupBy(F.lit("labels").alias("entity"), F.col("behavior_type").alias("metric")).agg(
        F.count(F.lit(1)).alias("n")))


# ---- upload mapping -----------------------------------------------------------------------------

@query("n01_n13_upload_transactions", """SELECT id AS transaction_id, ts AS timestamp, 1 AS input_count, 1 AS output_count, amount AS total_input_value_satoshi,
 amount AS total_output_value_satoshi, fee AS fee_satoshi, label FROM u_flat WHERE id IS NOT NULL""")
def n13(b):
    return ingest.transactions(ingest.Upload(flat_upload(b), "up")).drop("dataset_id", "block_height")


@query("n02_surrogate_ids")
def n02(b):
    return ingest.transactions(ingest.Upload(flat_upload(b).drop("Hash"), "up")).select(TX, "timestamp", "fee_satoshi")


@query("n03_timestamp_parse", "SELECT k, ts AS parsed FROM u_flat")
def n03(b):
    orders = b.source("orders").select(F.col("o_orderkey").alias("k"), (F.unix_timestamp("o_orderdate") + _SHIFT).alias("sec"))
    kk = F.col("k")
    spelled = F.when(kk % 4 == 0, text(F.col("sec"))).when(kk % 4 == 1, text(F.col("sec") * 1000)).when(
        kk % 4 == 2, F.date_format(F.timestamp_seconds("sec"), "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return orders.select("k", X.parse_timestamp(spelled).alias("parsed"))


@query("n04_amount_units", """SELECT l_orderkey AS k, l_linenumber AS line, CAST(round(l_extendedprice * 100) AS BIGINT) AS from_sat_name,
 CAST(round(l_quantity) * 100000000 AS BIGINT) AS from_btc_name, CAST(round(l_quantity) * 10000000 + 100000000 AS BIGINT) AS from_dotted,
 CAST(round(l_quantity) AS BIGINT) AS from_plain FROM lineitem""")
def n04(b):
    q = F.round("l_quantity").cast("bigint")
    return b.source("lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"),
        X.parse_amount(F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), "value_sat").alias("from_sat_name"),
        X.parse_amount(q.cast("string"), "value_btc").alias("from_btc_name"),
        X.parse_amount((q.cast("decimal(20,1)") / 10 + 1).cast("decimal(20,4)").cast("string"), "amount").alias("from_dotted"),
        X.parse_amount(q.cast("string"), "amount").alias("from_plain"))


@query("n05_amount_lists", """SELECT transaction_id, CAST(count(*) AS INTEGER) AS output_count, CAST(sum(output_value_satoshi) AS BIGINT) AS total
 FROM u_pair GROUP BY transaction_id""")
def n05(b):
    up = ingest.Upload(nested_upload(b), "up")
    n, total = up.side("output")
    return up.raw.select(up.id.alias(TX), n.alias("output_count"), total.alias("total"))


@query("n06_labels", "SELECT id AS transaction_id, label FROM u_flat WHERE id IS NOT NULL")
def n06(b):
    return flat_upload(b).where(F.col("Hash").isNotNull()).select(F.col("Hash").alias(TX), X.normal_label("class").alias("label"))


@query("n07_nested_outputs", """SELECT transaction_id || ':' || CAST(output_index AS VARCHAR) AS output_id, transaction_id, output_index, output_address,
 output_value_satoshi FROM u_pair""")
def n07(b):
    return ingest.children(ingest.Upload(nested_upload(b), "up"), "output").drop("dataset_id")


@query("n08_flat_children", """SELECT id || ':0' AS output_id, id AS transaction_id, 0 AS output_index, receiver AS output_address,
 amount AS output_value_satoshi FROM u_flat WHERE receiver IS NOT NULL AND id IS NOT NULL""")
def n08(b):
    return ingest.children(ingest.Upload(flat_upload(b), "up"), "output").drop("dataset_id").where(F.col(TX).isNotNull())


@query("n09_upload_network_events", """SELECT id AS transaction_id, ts AS timestamp, CAST(coalesce(epoch(ts), 0) AS BIGINT) AS timestamp_epoch_sec, src_ip, CAST(src_port AS INTEGER) AS src_port,
 8333 AS dst_port, country, asn FROM u_flat WHERE id IS NOT NULL""")
def n09(b):
    return ingest.network_events(ingest.Upload(flat_upload(b), "up")).drop("event_id", "dataset_id", "dst_ip")


@query("n10_asn_variants", """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id > 0 THEN user_id END AS strict,
 CASE WHEN user_id % 3 = 0 THEN 12 ELSE user_id END AS first_digits FROM events""")
def n10(b):
    u = F.col("user_id")
    shown = F.when(u % 3 == 0, "AS12-34").when(u % 3 == 1, F.concat(F.lit("as"), text(u))).otherwise(F.concat(F.lit(" "), text(u)))
    return b.source("events").select("event_id", X.asn_number(shown).alias("strict"), X.asn_first_digits(shown).alias("first_digits"))


@query("n11_address_rollup", "SELECT * FROM c_addr")
def n11(b):
    return ingest.address_rollup(*money(b.short))


@query("n12_ingest_summary", """SELECT count(*) AS raw_rows, count(DISTINCT id) AS canonical_rows, count(*) - count(DISTINCT id) AS rejected_rows,
 (SELECT count(*) FROM (SELECT sender AS a FROM u_flat WHERE id IS NOT NULL UNION SELECT receiver FROM u_flat WHERE id IS NOT NULL AND receiver IS NOT NULL)) AS address_count,
 'transactionId,timestamp,totalOutputValueBtc,feeBtc,label,outputAddress,inputAddress,networkEvents' AS covered_fields, true AS graph_analysis,
 true AS temporal_analysis, true AS network_analysis FROM u_flat""")
def n12(b):
    raw = flat_upload(b)
    return ingest.ingest_summary(ingest.Upload(raw, "up"), ingest.ingest(raw, "up"))


# ---- cleaning -----------------------------------------------------------------------------------

def messy(b: Bench) -> dict[str, DataFrame]:
    """Raw tables with padded, upper-cased, repeated, null-keyed and orphaned rows mixed in."""
    raw = b.raw
    number = F.conv(F.substring("txid", 1, 6), 16, 10).cast("bigint")
    pad = lambda df: df.withColumn("txid", F.concat(F.lit(" "), F.upper("txid"), F.lit(" ")))
    tx = raw["transactions"].withColumn("fee_satoshi", F.when(number % 7 != 0, F.col("fee_satoshi")))
    twice = pad(tx.where(number % 10 == 0)).withColumn("block_height", F.col("block_height") + 1)
    lost = tx.where(number % 20 == 1).withColumn("txid", F.lit(None).cast("string"))
    outs = raw["transaction_outputs"]
    again = pad(outs.where(number % 10 == 2)).withColumn("address", F.concat(F.lit("~"), "address"))
    stray = outs.where(number % 10 == 3).withColumn("txid", F.concat(F.lit("zz"), "txid"))
    net = raw["network_events"].withColumn("dst_port", F.when(number % 5 != 0, F.col("dst_port"))).withColumn(
        "country", F.concat(F.lit(" "), F.lower("country")))
    return {"transactions": tx.unionByName(twice).unionByName(lost), "transaction_inputs": raw["transaction_inputs"],
            "transaction_outputs": outs.unionByName(again).unionByName(stray),
            "network_events": net.unionByName(net.where(number % 10 == 4))}


shared("d_tx", "SELECT *, CAST('0x' || substring(transaction_id, 1, 6) AS BIGINT) AS h FROM c_tx")


@query("n14_quarantine", """SELECT transaction_id AS txid, behavior_type, ground_truth_label FROM c_lab""")
def n14(b):
    wide = b.raw["transactions"].join(b.raw["labels"], "txid")
    kept, side = clean.quarantine(wide)
    assert not set(kept.columns) & {"behavior_type", "ground_truth_label"}
    return side


@query("n15_clean_transactions", """SELECT transaction_id AS txid, block_height, fee_satoshi, total_output_value_satoshi FROM d_tx""")
def n15(b):
    out = clean.clean_transactions(messy(b)["transactions"], ["block_height"])
    return out.select("txid", "block_height", "fee_satoshi", "total_output_value_satoshi")


@query("n16_clean_inputs", "SELECT transaction_id AS txid, input_index, input_address AS address, input_value_satoshi AS amount_satoshi FROM c_in")
def n16(b):
    m = messy(b)
    return clean.clean_children(m["transaction_inputs"], "input_index", clean.clean_transactions(m["transactions"])).select(
        "txid", "input_index", "address", "amount_satoshi")


@query("n17_clean_outputs", "SELECT transaction_id AS txid, output_index, output_address AS address, output_value_satoshi AS amount_satoshi, is_change FROM c_out")
def n17(b):
    m = messy(b)
    return clean.clean_children(m["transaction_outputs"], "output_index", clean.clean_transactions(m["transactions"]), ["address"]).select(
        "txid", "output_index", "address", "amount_satoshi", "is_change")


@query("n18_clean_network_events", """SELECT event_id, transaction_id AS txid, src_ip, dst_ip, CASE WHEN CAST('0x' || substring(transaction_id, 1, 6) AS BIGINT) % 5 = 0 THEN 8333 ELSE dst_port END AS dst_port,
 country FROM c_net""")
def n18(b):
    m = messy(b)
    return clean.clean_network_events(m["network_events"], clean.clean_transactions(m["transactions"])).select(
        "event_id", "txid", "src_ip", "dst_ip", "dst_port", "country")


@query("n19_cleaning_statistics", """WITH r AS (SELECT h % 10 = 0 AS dup, h % 20 = 1 AS lost, h % 7 = 0 AS nofee FROM d_tx),
 o AS (SELECT CAST('0x' || substring(transaction_id, 1, 6) AS BIGINT) AS h FROM c_out), n AS (SELECT CAST('0x' || substring(transaction_id, 1, 6) AS BIGINT) AS h FROM c_net)
 SELECT 'transactions' AS entity, 'dropped' AS metric, count(*) FILTER (dup) + count(*) FILTER (lost) AS n FROM r
 UNION ALL SELECT 'transactions', 'imputed_fee_satoshi', count(*) FILTER (nofee) FROM r UNION ALL SELECT 'transaction_inputs', 'dropped', 0
 UNION ALL SELECT 'transaction_outputs', 'dropped', count(*) FILTER (h % 10 = 2) FROM o
 UNION ALL SELECT 'network_events', 'dropped', count(*) FILTER (h % 10 = 4) FROM n
 UNION ALL SELECT 'network_events', 'imputed_dst_port', count(*) FILTER (h % 5 = 0) FROM n""")
def n19(b):
    return clean.cleaning_statistics(messy(b))


# ---- normalisation ------------------------------------------------------------------------------

@query("n20_normalize_transactions", """SELECT transaction_id, timestamp, ts AS timestamp_epoch_sec, total_input_value_satoshi / 1e8 AS total_input_btc,
 total_output_value_satoshi / 1e8 AS total_output_btc, fee_satoshi / 1e8 AS fee_btc, fee_satoshi / transaction_size_bytes::DOUBLE AS fee_rate_sat_per_byte,
 round(least(1.0, total_output_value_satoshi / greatest(total_input_value_satoshi, 1)::DOUBLE), 9) AS value_balance_ratio,
 round(ln(1 + total_output_value_satoshi::DOUBLE), 9) AS log_total_value_satoshi, round(ln(1 + fee_satoshi::DOUBLE), 9) AS log_fee_satoshi FROM c_tx""")
def n20(b):
    rounded = ["value_balance_ratio", "log_total_value_satoshi", "log_fee_satoshi"]
    out = clean.normalize_transactions(clean.clean_transactions(b.raw["transactions"]), "bench")
    return out.select(TX, "timestamp", "timestamp_epoch_sec", "total_input_btc", "total_output_btc", "fee_btc", "fee_rate_sat_per_byte",
                      *[F.round(c, 9).alias(c) for c in rounded])


@query("n21_normalize_inputs", """SELECT transaction_id || ':' || CAST(input_index AS VARCHAR) AS input_id, transaction_id, input_index, input_address,
 input_value_satoshi, input_value_satoshi / 1e8 AS input_value_btc FROM c_in""")
def n21(b):
    return clean.normalize_inputs(b.raw["transaction_inputs"], "bench").drop("dataset_id", "prev_txid", "prev_output_index")


@query("n22_normalize_outputs", """SELECT transaction_id || ':' || CAST(output_index AS VARCHAR) AS output_id, transaction_id, output_index, output_address,
 output_value_satoshi, output_value_satoshi / 1e8 AS output_value_btc, is_change FROM c_out""")
def n22(b):
    return clean.normalize_outputs(b.raw["transaction_outputs"], "bench").drop("dataset_id", "script_type")


@query("n23_normalize_network_events", """SELECT event_id, transaction_id, timestamp, ts AS timestamp_epoch_sec, src_ip, src_port, dst_ip, dst_port, country, asn FROM c_net""")
def n23(b):
    return clean.normalize_network_events(b.raw["network_events"], "bench").drop("dataset_id")


@query("n24_decompose_transactions", """SELECT transaction_id, any_value(timestamp) AS timestamp, 1 AS input_count, CAST(any_value(n) AS INTEGER) AS output_count,
 5000000000 AS total_input_value_satoshi, CAST(sum(CASE WHEN k % 9 = 0 AND n > 1 AND output_index = n - 1 THEN 0 ELSE k * (output_index + 1) * 37 % 100000 + 1 END) AS BIGINT) AS total_output_value_satoshi,
 any_value(fee_satoshi) AS fee_satoshi, CAST(10 + 148 + 34 * any_value(n) AS INTEGER) AS transaction_size_bytes FROM u_nest GROUP BY transaction_id""")
def n24(b):
    return clean.decompose_consolidated(consolidated(b), "up")["transactions"].select(
        TX, "timestamp", "input_count", "output_count", "total_input_value_satoshi", "total_output_value_satoshi", "fee_satoshi",
        "transaction_size_bytes")


@query("n24_decompose_outputs", "SELECT transaction_id, output_index, output_address, output_value_satoshi FROM u_pair")
def n24_outputs(b):
    return clean.decompose_consolidated(consolidated(b), "up")["transaction_outputs"].select(
        TX, "output_index", "output_address", "output_value_satoshi")


@query("n24_decompose_events", """SELECT 'EVT_' || substring(transaction_id, 1, 16) AS event_id, transaction_id, '9.9.9.9' AS src_ip, 'NL' AS country, 99 AS asn FROM (SELECT DISTINCT transaction_id FROM u_nest)""")
def n24_events(b):
    return clean.decompose_consolidated(consolidated(b), "up")["network_events"].select("event_id", TX, "src_ip", "country", "asn")


@query("n25_alias_columns", "SELECT transaction_id, transaction_size_bytes AS size_bytes, transaction_size_bytes FROM c_tx")
def n25(b):
    df = b.raw["transactions"].withColumnRenamed("transaction_size_bytes", "size_bytes")
    return clean.alias_columns(df, [TX, "transaction_size_bytes"]).select(TX, "size_bytes", "transaction_size_bytes")


@query("n26_fill_child_counts", """SELECT transaction_id, input_count, output_count, CASE WHEN ts % 2 = 0 THEN 'input_count' ELSE '' END AS imputed FROM c_tx""")
def n26(b):
    tx = b.tx.select(TX, F.when(F.col("timestamp_epoch_sec") % 2 != 0, F.col("input_count")).alias("input_count"), "output_count")
    return clean.fill_child_counts(tx, b.ins, b.outs).withColumn("imputed", F.array_join("imputed", ","))


@query("n27_running_child_index", """SELECT transaction_id, output_address, output_value_satoshi,
 CAST(row_number() OVER (PARTITION BY transaction_id ORDER BY output_value_satoshi, output_address) - 1 AS INTEGER) AS output_index FROM c_out""")
def n27(b):
    df = b.short["transaction_outputs"].select(TX, "output_address", "output_value_satoshi")
    return full_ids(clean.running_child_index(df, "output", ["output_value_satoshi", "output_address"]))


@query("n28_repair_network_types", """SELECT event_id, CASE WHEN e % 3 = 0 THEN 0 ELSE src_port END AS src_port, CASE WHEN e % 4 = 0 THEN 8333 ELSE dst_port END AS dst_port,
 coalesce(country, 'UNKNOWN') AS country, coalesce(asn, 0) AS asn FROM c_net""")
def n28(b):
    e = F.substring("event_id", 5, 20).cast("bigint")
    df = b.net.select("event_id", F.when(e % 3 == 0, "x").otherwise(text(F.col("src_port"))).alias("src_port"),
                      F.when(e % 4 != 0, text(F.col("dst_port"))).alias("dst_port"), "country", F.concat(F.lit("AS"), text(F.col("asn"))).alias("asn"))
    return clean.repair_network_types(df)


# ---- quality ------------------------------------------------------------------------------------

shared("d_bad", """SELECT *, CAST('0x' || substring(transaction_id, 1, 6) AS BIGINT) AS h FROM c_tx""")


def broken(b: Bench) -> dict[str, DataFrame]:
    """Raw tables with every kind of violation planted by a hash of the id."""
    raw = b.raw
    h = F.conv(F.substring("txid", 1, 6), 16, 10).cast("bigint")
    tx = raw["transactions"].withColumn("_h", h)
    tx = (tx.withColumn("txid", F.when(F.col("_h") % 31 == 0, F.concat(F.lit("x"), "txid")).otherwise(F.col("txid")))
          .withColumn("fee_satoshi", F.when(F.col("_h") % 29 == 0, -F.col("fee_satoshi")).otherwise(F.col("fee_satoshi")))
          .withColumn("input_count", F.when(F.col("_h") % 23 == 0, 0).otherwise(F.col("input_count"))))
    tx = tx.unionByName(tx.where(F.col("_h") % 37 == 0)).drop("_h")
    outs = raw["transaction_outputs"].withColumn("amount_satoshi", F.when(h % 19 == 0, 100).when(h % 17 == 0, -1).otherwise(F.col("amount_satoshi")))
    net = raw["network_events"].withColumn("_h", h).withColumn("src_ip", F.when(F.col("_h") % 13 == 0, "bad").otherwise(F.col("src_ip")))
    net = net.withColumn("src_port", F.when(F.col("_h") % 11 == 0, 70000).otherwise(F.col("src_port"))).withColumn(
        "asn", F.when(F.col("_h") % 7 == 0, -1).otherwise(F.col("asn"))).drop("_h")
    return {**raw, "transactions": tx, "transaction_outputs": outs, "network_events": net}


@query("q01_q15_validation_report", """WITH base AS (SELECT *, CASE WHEN h % 31 = 0 THEN 'x' || transaction_id ELSE transaction_id END AS txid, CASE WHEN h % 29 = 0 THEN -fee_satoshi ELSE fee_satoshi END AS fee,
  CASE WHEN h % 23 = 0 THEN 0 ELSE input_count END AS nin FROM d_bad),
 tx AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE h % 37 = 0),
 o AS (SELECT c.*, CASE WHEN h % 19 = 0 THEN 100 WHEN h % 17 = 0 THEN -1 ELSE output_value_satoshi END AS v FROM (SELECT *, CAST('0x' || substring(transaction_id, 1, 6) AS BIGINT) AS h FROM c_out) c),
 n AS (SELECT c.*, CASE WHEN h % 13 = 0 THEN 'bad' ELSE src_ip END AS sip, CASE WHEN h % 11 = 0 THEN 70000 ELSE src_port END AS sp, CASE WHEN h % 7 = 0 THEN -1 ELSE asn END AS an
  FROM (SELECT *, CAST('0x' || substring(transaction_id, 1, 6) AS BIGINT) AS h FROM c_net) c),
 si AS (SELECT transaction_id AS txid, sum(input_value_satoshi) AS s FROM c_in GROUP BY 1), so AS (SELECT transaction_id AS txid, sum(v) AS s FROM o GROUP BY 1),
 ci AS (SELECT t.txid AS a, i.txid AS b, t.total_input_value_satoshi AS x, i.s AS y FROM tx t FULL JOIN si i ON i.txid = t.txid),
 co AS (SELECT t.txid AS a, i.txid AS b, t.total_output_value_satoshi AS x, i.s AS y FROM tx t FULL JOIN so i ON i.txid = t.txid)
 SELECT 'tx_duplicate_id' AS rule_id, 'error' AS severity, count(*) - count(DISTINCT txid) AS violations, count(*) AS checked FROM tx
 UNION ALL SELECT 'tx_id_format', 'error', count(*) FILTER (NOT regexp_full_match(txid, '[0-9a-fA-F]{64}')), count(*) FROM tx
 UNION ALL SELECT 'tx_negative_fee', 'error', count(*) FILTER (fee < 0), count(*) FROM tx
 UNION ALL SELECT 'tx_non_positive_input_total', 'error', count(*) FILTER (total_input_value_satoshi <= 0), count(*) FROM tx
 UNION ALL SELECT 'tx_non_positive_output_total', 'error', count(*) FILTER (total_output_value_satoshi <= 0), count(*) FROM tx
 UNION ALL SELECT 'tx_input_count_below_one', 'error', count(*) FILTER (nin < 1), count(*) FROM tx
 UNION ALL SELECT 'tx_output_count_below_one', 'error', count(*) FILTER (output_count < 1), count(*) FROM tx
 UNION ALL SELECT 'tx_header_conservation', 'error', count(*) FILTER (total_input_value_satoshi <> total_output_value_satoshi + fee), count(*) FROM tx
 UNION ALL SELECT 'input_duplicate_key', 'error', count(*) - count(DISTINCT (transaction_id, input_index)), count(*) FROM c_in
 UNION ALL SELECT 'input_orphan', 'error', count(DISTINCT transaction_id) FILTER (transaction_id NOT IN (SELECT txid FROM tx)), count(DISTINCT transaction_id) FROM c_in
 UNION ALL SELECT 'input_non_positive_value', 'error', count(*) FILTER (input_value_satoshi <= 0), count(*) FROM c_in
 UNION ALL SELECT 'output_duplicate_key', 'error', count(*) - count(DISTINCT (transaction_id, output_index)), count(*) FROM o
 UNION ALL SELECT 'output_orphan', 'error', count(DISTINCT transaction_id) FILTER (transaction_id NOT IN (SELECT txid FROM tx)), count(DISTINCT transaction_id) FROM o
 UNION ALL SELECT 'output_non_positive_value', 'error', count(*) FILTER (v <= 0), count(*) FROM o
 UNION ALL SELECT 'output_dust', 'warning', count(*) FILTER (v > 0 AND v < 546), count(*) FROM o
 UNION ALL SELECT 'net_duplicate_id', 'error', count(*) - count(DISTINCT event_id), count(*) FROM n
 UNION ALL SELECT 'net_orphan', 'error', count(DISTINCT transaction_id) FILTER (transaction_id NOT IN (SELECT txid FROM tx)), count(DISTINCT transaction_id) FROM n
 UNION ALL SELECT 'net_src_ip_format', 'error', count(*) FILTER (NOT regexp_full_match(sip, '([0-9]{1,3}\\.){3}[0-9]{1,3}')), count(*) FROM n
 UNION ALL SELECT 'net_dst_ip_format', 'error', count(*) FILTER (NOT regexp_full_match(dst_ip, '([0-9]{1,3}\\.){3}[0-9]{1,3}')), count(*) FROM n
 UNION ALL SELECT 'net_src_port_range', 'error', count(*) FILTER (sp NOT BETWEEN 1 AND 65535), count(*) FROM n
 UNION ALL SELECT 'net_dst_port_range', 'error', count(*) FILTER (dst_port NOT BETWEEN 1 AND 65535), count(*) FROM n
 UNION ALL SELECT 'net_country_length', 'error', count(*) FILTER (coalesce(length(country), 0) <> 2), count(*) FROM n
 UNION ALL SELECT 'net_asn_positive', 'error', count(*) FILTER (an IS NOT NULL AND an <= 0), count(*) FROM n
 UNION ALL SELECT 'conservation_inputs', 'error', count(*) FILTER (a IS NULL OR b IS NULL OR x <> y), count(*) FROM ci
 UNION ALL SELECT 'conservation_outputs', 'error', count(*) FILTER (a IS NULL OR b IS NULL OR x <> y), count(*) FROM co""".replace("\\\\", "\\"))
def q15(b):
    return quality.validation_report(broken(b), dust=True)


@query("q15_report_summary", """SELECT 24 AS n_rules, count(*) FILTER (v > 0) AS n_broken, CAST(sum(v) AS BIGINT) AS violations, false AS is_valid FROM (
 SELECT count(*) FILTER (country IS NULL) AS v FROM c_net)""")
def q15_summary(b):
    return quality.report_summary(quality.validation_report(b.raw))


@query("q16_coverage", """SELECT 'tx_without_event' AS rule_id, 'warning' AS severity, count(*) FILTER (n IS NULL) AS violations, count(*) AS checked FROM c_tx LEFT JOIN (SELECT transaction_id, count(*) n FROM c_net GROUP BY 1) USING (transaction_id)
 UNION ALL SELECT 'event_without_tx', 'error', 0, count(*) FROM c_tx
 UNION ALL SELECT 'tx_with_several_events', 'warning', (SELECT count(*) FROM (SELECT transaction_id FROM c_net GROUP BY 1 HAVING count(*) > 1)), count(*) FROM c_tx
 UNION ALL SELECT 'tx_without_label', 'warning', 0, count(*) FROM c_tx UNION ALL SELECT 'label_without_tx', 'error', 0, count(*) FROM c_tx
 UNION ALL SELECT 'tx_with_several_labels', 'warning', 0, count(*) FROM c_tx""")
def q16(b):
    return quality.coverage(b.raw["transactions"], b.raw["network_events"], b.raw["labels"])


@query("q18_timestamps_parse", "SELECT 'timestamp_parses' AS rule_id, 'error' AS severity, count(*) FILTER (k % 4 <> 2) AS violations, count(*) AS checked FROM u_flat")
def q18(b):
    return quality.timestamp_rule(flat_upload(b).withColumnRenamed("Time", "timestamp"))


@query("q19_label_sanity", """SELECT 'both_classes_present' AS rule_id, 'error' AS severity, 0 AS violations, count(*) AS checked FROM c_lab
 UNION ALL SELECT 'benign_labelled_zero', 'error', count(*) FILTER (behavior_type IN ('normal', 'benign_high_volume') AND ground_truth_label <> 0), count(*) FROM c_lab""")
def q19(b):
    return quality.label_rules(b.labels)


@query("q20_graph_not_trivial", "SELECT 'graph_not_trivial' AS rule_id, 'error' AS severity, 0 AS violations, count(*) AS checked FROM g_node")
def q20(b):
    return quality.graph_rule(b.weak)


@query("q23_result_contract", """SELECT 'result_entity_id' AS rule_id, 'error' AS severity, 0 AS violations, count(*) AS checked FROM c_res
 UNION ALL SELECT 'result_entity_type', 'error', 0, count(*) FROM c_res UNION ALL SELECT 'result_risk_score', 'error', count(*) FILTER (risk_score > 0.9), count(*) FROM c_res
 UNION ALL SELECT 'result_confidence', 'error', 0, count(*) FROM c_res UNION ALL SELECT 'result_risk_level', 'error', count(*) FILTER (risk_score < 0.1), count(*) FROM c_res""")
def q23(b):
    r, s = b.results, F.col("risk_score")
    return quality.result_rules(r.withColumn("risk_level", F.when(s >= 0.1, F.col("risk_level"))).withColumn(
        "risk_score", F.when(s > 0.9, s + 1).otherwise(s)))
