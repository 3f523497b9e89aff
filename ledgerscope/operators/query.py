"""Investigation listings and lookups."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions import exprs as X

TX = "transaction_id"
LEVELS = ("low", "medium", "high", "critical")
# Columns a listing may be sorted by.
TX_SORTS = {
    "timestamp": "timestamp", "riskScore": "risk_score", "totalOutputValueBtc": "total_output_value_satoshi",
    "feeBtc": "fee_satoshi", "blockHeight": "block_height", "transactionId": "transaction_id",
}
ADDRESS_SORTS = {
    "addressId": "address_id", "riskScore": "risk_score", "transactionCount": "transaction_count",
    "totalReceivedBtc": "total_received_satoshi", "totalSentBtc": "total_sent_satoshi",
    "firstSeen": "first_seen_timestamp", "lastSeen": "last_seen_timestamp",
}


class InvalidFilter(ValueError):
    """A listing filter is out of range or inconsistent."""


def latest_results(results: DataFrame, entity_type: str | None = None) -> DataFrame:
    """The newest result per entity, as a grouped maximum (combines before the shuffle)."""
    df = results if entity_type is None else results.where(F.col("entity_type") == entity_type)
    rest = [c for c in df.columns if c != "entity_id"]
    newest = df.groupBy("entity_id").agg(
        F.max_by(F.struct(*rest), F.struct(F.col("predicted_at").isNotNull(), "predicted_at", "result_id")).alias("r"))
    return newest.select("entity_id", "r.*")


def run_results(results: DataFrame, analysis_id: str) -> DataFrame:
    return results.where(F.col("analysis_id") == analysis_id)


def btc_to_satoshi(text: str) -> int:
    return int((Decimal(text) * X.SAT_PER_BTC).to_integral_value())


def _when(value: str | dt.datetime, name: str) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    try:
        return dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
    except ValueError as exc:
        raise InvalidFilter(f"{name} is no timestamp: {value}") from exc


@dataclass
class TransactionFilter:
    """Filters of the transaction listing. Bad combinations raise before any plan is built."""

    risk_level: str | None = None
    min_risk: float | None = None
    max_risk: float | None = None
    from_time: str | dt.datetime | None = None
    to_time: str | dt.datetime | None = None
    min_btc: str | None = None
    max_btc: str | None = None
    transaction_id: str | None = None
    id_contains: str | None = None
    ip: str | None = None
    address: str | None = None
    behavior: str | None = None
    country: str | None = None
    asn: int | None = None

    def __post_init__(self) -> None:
        if self.risk_level is not None and self.risk_level.lower() not in LEVELS:
            raise InvalidFilter(f"risk level must be one of {LEVELS}")
        for name in ("min_risk", "max_risk"):
            value = getattr(self, name)
            if value is not None and not 0 <= value <= 1:
                raise InvalidFilter(f"{name} must lie in 0..1")
        if self.min_risk is not None and self.max_risk is not None and self.min_risk > self.max_risk:
            raise InvalidFilter("min_risk exceeds max_risk")
        a = _when(self.from_time, "from_time") if self.from_time else None
        z = _when(self.to_time, "to_time") if self.to_time else None
        if a and z and a > z:
            raise InvalidFilter("from_time is later than to_time")
        try:
            low = btc_to_satoshi(self.min_btc) if self.min_btc is not None else None
            high = btc_to_satoshi(self.max_btc) if self.max_btc is not None else None
        except ArithmeticError as exc:
            raise InvalidFilter("BTC amounts must be decimal text") from exc
        if (low is not None and low < 0) or (high is not None and high < 0):
            raise InvalidFilter("BTC amounts must not be negative")
        if low is not None and high is not None and low > high:
            raise InvalidFilter("min_btc exceeds max_btc")


def joined_risk(transactions: DataFrame, results: DataFrame, analysis_id: str | None = None) -> DataFrame:
    """Transactions with the result of one run, or with their latest result."""
    slim = results.select("entity_id", "entity_type", "analysis_id", "result_id", "predicted_at", "risk_score", "risk_level",
                          "prediction_label")
    picked = run_results(slim, analysis_id) if analysis_id else latest_results(slim, "transaction")
    picked = picked.select(F.col("entity_id").alias(TX), "risk_score", "risk_level", "prediction_label")
    return transactions.join(picked, TX, "left")


def filter_transactions(rows: DataFrame, spec: TransactionFilter, inputs: DataFrame | None = None,
                        outputs: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """Apply a filter to ``joined_risk`` rows. Existence filters become semi joins."""
    conditions: list[Column] = []
    c = F.col
    if spec.risk_level:
        conditions.append(c("risk_level") == spec.risk_level.lower())
    if spec.min_risk is not None:
        conditions.append(c("risk_score") >= spec.min_risk)
    if spec.max_risk is not None:
        conditions.append(c("risk_score") <= spec.max_risk)
    if spec.from_time:
        conditions.append(c("timestamp") >= F.lit(_when(spec.from_time, "from_time").isoformat(" ")).cast("timestamp"))
    if spec.to_time:
        conditions.append(c("timestamp") <= F.lit(_when(spec.to_time, "to_time").isoformat(" ")).cast("timestamp"))
    if spec.min_btc is not None:
        conditions.append(c("total_output_value_satoshi") >= btc_to_satoshi(spec.min_btc))
    if spec.max_btc is not None:
        conditions.append(c("total_output_value_satoshi") <= btc_to_satoshi(spec.max_btc))
    if spec.transaction_id and spec.transaction_id.strip():
        conditions.append(c(TX) == spec.transaction_id.strip())
    if spec.id_contains:
        conditions.append(F.lower(c(TX)).contains(spec.id_contains.lower()))
    if spec.behavior:
        conditions.append(c("prediction_label") == spec.behavior)
    for condition in conditions:
        rows = rows.where(condition)
    if spec.ip and spec.ip.strip():
        ip = spec.ip.strip()
        rows = rows.join(events.where((c("src_ip") == ip) | (c("dst_ip") == ip)).select(TX), TX, "left_semi")
    if spec.country:
        rows = rows.join(events.where(c("country") == spec.country).select(TX), TX, "left_semi")
    if spec.asn is not None:
        rows = rows.join(events.where(c("asn") == spec.asn).select(TX), TX, "left_semi")
    if spec.address and spec.address.strip():
        a = spec.address.strip()
        hits = inputs.where(c("input_address") == a).select(TX).union(outputs.where(c("output_address") == a).select(TX))
        rows = rows.join(hits, TX, "left_semi")
    return rows


def page(rows: DataFrame, sort: str, key: str, descending: bool = True, number: int = 1, size: int = 50) -> DataFrame:
    """One page in a total order: nulls last, ties by key."""
    if number < 1 or size < 1:
        raise InvalidFilter("page number and size start at 1")
    first = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return rows.orderBy(first, F.asc(key)).offset((number - 1) * size).limit(size)


def page_meta(rows: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """One row with total items, total pages and whether neighbours exist."""
    n = rows.agg(F.count(F.lit(1)).alias("total_items"))
    pages = F.ceil(F.col("total_items") / size).cast("bigint")
    return n.select(F.lit(number).alias("page"), F.lit(size).alias("page_size"), "total_items", pages.alias("total_pages"),
                    (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_previous"))


def sort_column(sorts: dict[str, str], name: str) -> str:
    if name not in sorts:
        raise InvalidFilter(f"sort must be one of {sorted(sorts)}")
    return sorts[name]


def listing_columns(rows: DataFrame) -> DataFrame:
    """The columns of a transaction listing, amounts as exact BTC text."""
    return rows.select(
        TX, "block_height", "timestamp", "input_count", "output_count",
        X.btc_text("total_input_value_satoshi").alias("total_input_value_btc"),
        X.btc_text("total_output_value_satoshi").alias("total_output_value_btc"),
        X.btc_text("fee_satoshi").alias("fee_btc"), "risk_score", "risk_level")


def transaction_detail(transactions: DataFrame, inputs: DataFrame, outputs: DataFrame, events: DataFrame,
                       results: DataFrame, ids: DataFrame, max_events: int = 10) -> dict[str, DataFrame]:
    """The parts of a transaction sheet: ``header`` with its latest result, ``inputs``, ``outputs``, first ``events``.

    The parts stay rows, each with its own position, so a transaction with very many children is never
    packed into one value. ``ids`` cuts every table first.
    """
    cut = lambda df: df.join(ids.select(TX), TX, "left_semi")
    risk = latest_results(results.join(ids.select(F.col(TX).alias("entity_id")), "entity_id", "left_semi"), "transaction")
    risk = risk.select(F.col("entity_id").alias(TX), "risk_score", "risk_level", "prediction_label", "confidence")
    first = Window.partitionBy(TX).orderBy("timestamp", "event_id")
    net = cut(events).withColumn("position", F.row_number().over(first)).where(F.col("position") <= max_events)
    return {"header": cut(transactions).join(risk, TX, "left"), "inputs": cut(inputs), "outputs": cut(outputs), "events": net}


def detail_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """A sheet as one listing: header, inputs, outputs, events."""
    null = F.lit(None).cast("bigint")
    head = parts["header"].select(TX, F.lit("header").alias("part"), F.lit(0).alias("position"),
                                  F.col("prediction_label").alias("ref"), F.col("total_output_value_satoshi").alias("value_satoshi"))
    sides = [parts[f"{s}s"].select(TX, F.lit(s).alias("part"), F.col(f"{s}_index").alias("position"), F.col(f"{s}_address").alias("ref"),
                                   F.col(f"{s}_value_satoshi").alias("value_satoshi")) for s in ("input", "output")]
    net = parts["events"].select(TX, F.lit("event").alias("part"), "position", F.col("event_id").alias("ref"), null.alias("value_satoshi"))
    return head.unionByName(sides[0]).unionByName(sides[1]).unionByName(net)


def address_listing(addresses: DataFrame, results: DataFrame, min_risk: float | None = None,
                    risk_level: str | None = None, analysis_id: str | None = None) -> DataFrame:
    """Addresses with their latest risk, ready for sorting and paging."""
    slim = results.select("entity_id", "entity_type", "analysis_id", "result_id", "predicted_at", "risk_score", "risk_level")
    picked = run_results(slim, analysis_id) if analysis_id else latest_results(slim, "address")
    rows = addresses.join(picked.select(F.col("entity_id").alias("address_id"), "risk_score", "risk_level"),
                          "address_id", "left")
    if risk_level:
        rows = rows.where(F.col("risk_level") == risk_level.lower())
    if min_risk is not None:
        rows = rows.where(F.col("risk_score") >= min_risk)
    return rows


def address_profile(addresses: DataFrame, results: DataFrame) -> DataFrame:
    """Address profiles with active days and BTC text."""
    return address_listing(addresses, results).select(
        "address_id", "first_seen_timestamp", "last_seen_timestamp",
        X.active_days("first_seen_timestamp", "last_seen_timestamp").alias("active_days"),
        X.btc_text("total_received_satoshi").alias("total_received_btc"),
        X.btc_text("total_sent_satoshi").alias("total_sent_btc"),
        X.btc_text(F.col("total_received_satoshi") - F.col("total_sent_satoshi")).alias("balance_btc"),
        "transaction_count", "risk_score", "risk_level")


def result_listing(results: DataFrame, analysis_id: str, risk_level: str | None = None, min_risk: float | None = None,
                   entity_type: str | None = None) -> DataFrame:
    rows = run_results(results, analysis_id)
    if risk_level:
        rows = rows.where(F.col("risk_level") == risk_level.lower())
    if min_risk is not None:
        rows = rows.where(F.col("risk_score") >= min_risk)
    if entity_type:
        rows = rows.where(F.col("entity_type") == entity_type)
    return rows


def result_detail(results: DataFrame, analysis_id: str, entity_id: str) -> DataFrame:
    return run_results(results, analysis_id).where(F.col("entity_id") == entity_id)


def dataset_listing(datasets: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    return page(datasets, "uploaded_at", "dataset_id", True, number, size)


def runs_of_dataset(runs: DataFrame, dataset_id: str) -> DataFrame:
    return runs.where(F.col("dataset_id") == dataset_id).orderBy(F.desc_nulls_last("started_at"), "analysis_id")


def latest_completed_runs(runs: DataFrame) -> DataFrame:
    """The newest completed run of every dataset."""
    rest = [c for c in runs.columns if c != "dataset_id"]
    return runs.where(F.col("status") == "completed").groupBy("dataset_id").agg(
        F.max_by(F.struct(*rest), F.struct("completed_at", "analysis_id")).alias("r")).select("dataset_id", "r.*")


def search(transactions: DataFrame, addresses: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """Transactions and addresses whose id equals or contains the text; exact hits first."""
    needle = text.strip().lower()
    tx = transactions.select(F.lit("transaction").alias("kind"), F.col(TX).alias("id"))
    addr = addresses.select(F.lit("address").alias("kind"), F.col("address_id").alias("id"))
    hits = tx.unionByName(addr).where(F.lower("id").contains(needle))
    return hits.withColumn("is_exact", F.lower("id") == needle).orderBy(F.desc("is_exact"), "kind", "id").limit(limit)


def timeline(transactions: DataFrame, events: DataFrame, alerts: DataFrame | None, ids: DataFrame) -> DataFrame:
    """Everything dated about the given transactions, in time order."""
    cut = lambda df: df.join(ids.select(TX), TX, "left_semi")
    parts = cut(transactions).select(
        TX, F.col("timestamp").alias("at"), F.lit("transaction").alias("kind"), F.col(TX).alias("ref"),
        X.btc_text("total_output_value_satoshi").alias("detail"))
    parts = parts.unionByName(cut(events).select(
        TX, F.col("timestamp").alias("at"), F.lit("network").alias("kind"), F.col("event_id").alias("ref"),
        F.concat_ws(" -> ", "src_ip", "dst_ip").alias("detail")))
    if alerts is not None:
        parts = parts.unionByName(cut(alerts).select(
            TX, F.col("first_seen_at").alias("at"), F.lit("alert").alias("kind"), F.col("alert_id").alias("ref"),
            F.col("alert_type").alias("detail")))
    return parts.orderBy("at", "kind", "ref")
