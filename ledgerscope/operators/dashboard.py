"""Dashboard aggregates over whole tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope import schemas
from ledgerscope.functions import exprs as X
from ledgerscope.operators.alerts import ACTIVE_STATUSES

TX = "transaction_id"
LEVELS = ["low", "medium", "high", "critical"]


def _beside(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    out = frames[0].withColumn("_j", F.lit(1))
    for df in frames[1:]:
        out = out.join(df.withColumn("_j", F.lit(1)), "_j")
    return out.drop("_j")


def behaviour_overview(results: DataFrame) -> DataFrame:
    """All eleven classes: count, share, average risk (12 or 75 when empty), results per level."""
    spark = results.sparkSession
    classes = spark.createDataFrame([(c,) for c in schemas.BEHAVIOR_CLASSES], "behavior_type string")
    level = F.coalesce(F.lower("risk_level"), F.lit("low"))
    per = results.groupBy(F.col("prediction_label").alias("behavior_type")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("risk_score").alias("r"),
        *[F.count(F.when(level == x, 1)).alias(x) for x in LEVELS])
    total = results.agg(F.count(F.lit(1)).alias("total"))
    j = _beside_each(F.broadcast(classes).join(per, "behavior_type", "left"), total)
    n = F.coalesce("n", F.lit(0))
    default = F.when(F.col("behavior_type").isin(schemas.BENIGN_CLASSES), 12).otherwise(75)
    zero = F.lit(0).cast("bigint")
    return j.select(
        "behavior_type", n.alias("n"), (n * 100.0 / F.greatest("total", F.lit(1))).alias("pct"),
        F.coalesce(F.col("r") * 100, default.cast("double")).alias("average_risk"),
        *[F.coalesce(x, zero).alias(f"{x}_count") for x in LEVELS],
        (~F.col("behavior_type").isin(schemas.BENIGN_CLASSES)).alias("is_suspicious"))


def _beside_each(rows: DataFrame, one: DataFrame) -> DataFrame:
    return rows.withColumn("_j", F.lit(1)).join(F.broadcast(one.withColumn("_j", F.lit(1))), "_j").drop("_j")


def behaviour_top(results: DataFrame, transactions: DataFrame, entity_type: str = "transaction", k: int = 5) -> DataFrame:
    """The k riskiest entities of each class. ``row_number`` under a rank filter is cut per task before the shuffle."""
    w = Window.partitionBy("prediction_label").orderBy(F.desc_nulls_last("risk_score"), "entity_id")
    top = results.where(F.col("entity_type") == entity_type).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    top = top.select(F.col("prediction_label").alias("behavior_type"), "rank", "entity_id", "risk_score", "risk_level", "predicted_at")
    if entity_type != "transaction":
        return top
    return top.join(transactions.select(F.col(TX).alias("entity_id"), "total_output_value_satoshi"), "entity_id", "left").select(
        "behavior_type", "rank", "entity_id", "risk_score", "risk_level", "predicted_at",
        X.btc_text("total_output_value_satoshi").alias("amount_btc"))


def address_results(results: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Results of addresses: per class the riskiest of the transactions that an address takes part in, as an address's own row.

    The riskiest one is a combined maximum, so a busy address is no single group of rows.
    """
    parts = inputs.select(TX, F.trim("input_address").alias("a")).union(outputs.select(TX, F.trim("output_address").alias("a")))
    parts = parts.where(F.col("a").isNotNull() & (F.col("a") != "")).distinct()
    own = results.where(F.col("entity_type") == "transaction").select(F.col("entity_id").alias(TX), "prediction_label", "risk_score", "risk_level", "predicted_at")
    top = parts.join(own, TX).groupBy("prediction_label", "a").agg(F.max(F.struct("risk_score", TX, "risk_level", "predicted_at")).alias("r"))
    return top.select(F.col("a").alias("entity_id"), F.lit("address").alias("entity_type"), "prediction_label", "r.risk_score", "r.risk_level", "r.predicted_at")


def class_distribution(results: DataFrame) -> DataFrame:
    """Results per predicted class and their share."""
    per = results.groupBy(F.coalesce("prediction_label", F.lit("unknown")).alias("behavior_type")).agg(F.count(F.lit(1)).alias("n"))
    return _beside_each(per, results.agg(F.count(F.lit(1)).alias("total"))).select("behavior_type", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def kpis(transactions: DataFrame, addresses: DataFrame, results: DataFrame, alerts: DataFrame) -> DataFrame:
    """Totals, high plus critical results, active and all alerts, last processing time."""
    return _beside(
        transactions.agg(F.count(F.lit(1)).alias("total_transactions")), addresses.agg(F.count(F.lit(1)).alias("total_entities")),
        results.agg(F.count(F.when(F.col("risk_level").isin("high", "critical"), 1)).alias("high_risk_entities"),
                    F.max("predicted_at").alias("last_processed")),
        alerts.agg(F.count(F.when(F.col("status").isin(ACTIVE_STATUSES), 1)).alias("active_alerts"),
                   F.count(F.lit(1)).alias("anomalies_detected")))


def anomaly_series(transactions: DataFrame, results: DataFrame) -> DataFrame:
    """Transactions and risky ones in 3 to 10 equal time buckets, empty ones kept, the last one closed."""
    risky = results.where(F.col("risk_level").isin("high", "critical")).select(F.col("entity_id").alias(TX), F.lit(1).alias("hit"))
    timed = transactions.where(F.col("timestamp").isNotNull()).select(TX, F.unix_millis("timestamp").alias("t"))
    span = timed.agg(F.min("t").alias("a"), F.max("t").alias("z"), F.count(F.lit(1)).alias("n"))
    span = span.select("a", F.least(F.lit(10), F.greatest(F.lit(3).cast("bigint"), F.col("n"))).alias("k"),
                       F.when(F.col("z") > F.col("a"), F.col("z") - F.col("a")).alias("d"))
    span = span.select("a", "k", F.coalesce(F.col("d") / F.col("k"), F.lit(3600000.0)).alias("w"))
    placed = _beside_each(timed.join(risky.distinct(), TX, "left"), span).groupBy(
        F.least(F.floor((F.col("t") - F.col("a")) / F.col("w")), F.col("k") - 1).alias("bucket")).agg(
        F.count(F.lit(1)).alias("transactions"), F.count("hit").alias("anomalies"))
    grid = span.select("a", "w", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k").cast("bigint") - 1)).alias("bucket"))
    zero = F.lit(0).cast("bigint")
    return grid.join(placed, "bucket", "left").select(
        "bucket", F.floor((F.col("a") + F.col("bucket") * F.col("w")) / 1000).alias("bucket_start_sec"),
        F.coalesce("transactions", zero).alias("transactions"), F.coalesce("anomalies", zero).alias("anomalies"))


def dataset_profile(tables: Mapping[str, DataFrame], addresses: DataFrame, results: DataFrame) -> DataFrame:
    """Sizes, range, countries, ASNs, suspicious share, graph size and scored share of one dataset."""
    tx, net = tables["transactions"], tables["network_events"]
    edges = _beside(tables["transaction_inputs"].agg(F.count(F.lit(1)).alias("i")),
                    tables["transaction_outputs"].agg(F.count(F.lit(1)).alias("o"))).select((F.col("i") + F.col("o")).alias("graph_edges"))
    scored = results.agg(F.count(F.lit(1)).alias("scored_count"),
                         F.count(F.when(F.col("risk_level").isin("high", "critical"), 1)).alias("s"))
    one = _beside(
        tx.agg(F.count(F.lit(1)).alias("total_transactions"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at")),
        addresses.agg(F.count(F.lit(1)).alias("total_addresses")),
        net.agg(F.count_distinct("country").alias("country_count")), net.agg(F.count_distinct("asn").alias("asn_count")),
        edges, scored)
    n = F.col("scored_count")
    return one.select(
        "total_transactions", "total_addresses", "first_at", "last_at", "country_count", "asn_count",
        F.when(n > 0, F.col("s") * 100.0 / n).otherwise(0.0).alias("suspicious_pct"),
        (F.col("total_transactions") + F.col("total_addresses")).alias("graph_nodes"), "graph_edges", "scored_count",
        F.when(F.col("total_transactions") > 0, n / F.col("total_transactions")).otherwise(0.0).alias("scored_share"))


def dataset_info(transactions: DataFrame, addresses: DataFrame, results: DataFrame) -> DataFrame:
    """Span text, flagged and lower-risk counts."""
    t = transactions.agg(F.count(F.lit(1)).alias("transactions"), F.count_distinct("block_height").alias("blocks"),
                         F.round((F.max(F.unix_timestamp("timestamp")) - F.min(F.unix_timestamp("timestamp"))) / 3600).cast(
                             "bigint").alias("hours"))
    r = results.agg(F.count(F.lit(1)).alias("entities"),
                    F.count(F.when(F.col("risk_level").isin("high", "critical"), 1)).alias("flagged"))
    one = _beside(t, addresses.agg(F.count(F.lit(1)).alias("addresses")), r)
    h = F.col("hours")
    span = F.when(h > 24, F.concat(F.round(h / 24).cast("bigint").cast("string"), F.lit("d"))).otherwise(
        F.concat(F.greatest(F.lit(1).cast("bigint"), h).cast("string"), F.lit("h")))
    return one.select("transactions", "blocks", "addresses", "entities", "flagged",
                      F.greatest(F.lit(0).cast("bigint"), F.col("entities") - F.col("flagged")).alias("lower_risk"), span.alias("span"))


def behaviour_totals(overview: DataFrame) -> DataFrame:
    """Suspicious against benign counts and the most frequent class."""
    one = overview.agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("is_suspicious"), F.col("n")).otherwise(0)).alias("suspicious"),
        F.max_by("behavior_type", F.struct("n", "behavior_type")).alias("top_behavior"))
    return one.select("total", "suspicious", (F.col("total") - F.col("suspicious")).alias("benign"), F.when(
        F.col("total") > 0, F.col("suspicious") * 100.0 / F.col("total")).otherwise(0.0).alias("suspicious_pct"), "top_behavior")


def behaviour_list(overview: DataFrame, kind: str | None = None, text: str | None = None, by_risk: bool = False) -> DataFrame:
    """The class list filtered by kind and text, by count or by risk."""
    out = overview
    if kind in ("suspicious", "benign"):
        out = out.where(F.col("is_suspicious") == (kind == "suspicious"))
    if text:
        out = out.where(F.lower("behavior_type").contains(text.lower()))
    return out.orderBy(F.desc("average_risk" if by_risk else "n"), "behavior_type")


def filter_clusters(clusters: DataFrame, labels: DataFrame, severity: str | None = None, text: str | None = None) -> DataFrame:
    """Inferred clusters by severity and by id, lead or member address; members are matched by a semi join."""
    out = clusters
    if severity:
        out = out.where(F.col("severity") == severity.lower())
    if text:
        needle = text.lower()
        hit = labels.where(F.lower("address_id").contains(needle)).select("component").distinct()
        by_name = out.where(F.lower("component").contains(needle) | F.lower("lead_address").contains(needle)).select("component")
        out = out.join(hit.union(by_name), "component", "left_semi")
    return out
