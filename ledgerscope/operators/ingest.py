"""Map one uploaded flat or nested file onto the canonical tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions import exprs as X

# Accepted spellings per field, first hit wins.
FIELD_ALIASES = {
    "transaction_id": ["transaction_id", "txid", "tx_id", "transactionid", "hash"],
    "timestamp": ["timestamp", "time", "block_time"],
    "value": ["total_output_value_satoshi", "value", "amount", "val"],
    "fee": ["fee_satoshi", "fee"],
    "block_height": ["block_height", "block", "height"],
    "input_address": ["input_address", "sender", "from_address"],
    "output_address": ["output_address", "receiver", "to_address"],
    "input_addresses": ["input_addresses"],
    "output_addresses": ["output_addresses"],
    "input_amounts": ["input_amounts"],
    "output_amounts": ["output_amounts"],
    "label": ["label", "class", "is_illicit", "category"],
    "src_ip": ["src_ip", "source_ip"],
    "src_port": ["src_port", "source_port"],
    "dst_ip": ["dst_ip", "dest_ip", "destination_ip"],
    "dst_port": ["dst_port", "dest_port", "destination_port"],
    "country": ["country", "net_country"],
    "asn": ["asn", "net_asn"],
}
NETWORK_FIELDS = ["src_ip", "src_port", "dst_ip", "dst_port", "country", "asn"]


def resolve_fields(columns: list[str]) -> dict[str, str]:
    """Which raw column holds which field, ignoring case."""
    by_lower = {c.lower(): c for c in columns}
    found = {}
    for name, spellings in FIELD_ALIASES.items():
        hit = next((by_lower[s] for s in spellings if s in by_lower), None)
        if hit is not None:
            found[name] = hit
    return found


@dataclass
class Upload:
    """A raw frame together with its resolved columns."""

    raw: DataFrame
    dataset_id: str
    fields: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.fields = self.fields or resolve_fields(self.raw.columns)

    def has(self, *names: str) -> bool:
        return all(n in self.fields for n in names)

    def column(self, name: str) -> Column:
        return F.col(f"`{self.fields[name]}`")

    @property
    def id(self) -> Column:
        if self.has("transaction_id"):
            return self.column("transaction_id").cast("string")
        return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in self.raw.columns])), 256)

    @property
    def timestamp(self) -> Column:
        return X.parse_timestamp(self.column("timestamp")) if self.has("timestamp") else F.lit(None).cast("timestamp")

    def amount(self, name: str) -> Column:
        if not self.has(name):
            return F.lit(None).cast("bigint")
        return X.parse_amount(self.column(name), self.fields[name])

    def side(self, side: str) -> tuple[Column, Column]:
        """Count and total of one side: from the nested amounts, else one child of the row's value."""
        if self.has(f"{side}_amounts"):
            amounts = _as_array(self, f"{side}_amounts", "bigint")
            return F.size(amounts), X.list_total(amounts)
        return F.lit(1), self.amount("value")


def _as_array(up: Upload, name: str, element: str) -> Column:
    kind = dict(up.raw.dtypes)[up.fields[name]]
    if kind.startswith("array"):
        return up.column(name).cast(f"array<{element}>")
    return X.parse_list(up.column(name), element)


def transactions(up: Upload) -> DataFrame:
    """Canonical transactions, one row per id."""
    (n_in, total_in), (n_out, total_out) = up.side("input"), up.side("output")
    rows = up.raw.select(
        up.id.alias("transaction_id"), F.lit(up.dataset_id).alias("dataset_id"),
        (X.whole_number(up.column("block_height")).cast("int") if up.has("block_height")
         else F.lit(None).cast("int")).alias("block_height"),
        up.timestamp.alias("timestamp"), n_in.alias("input_count"), n_out.alias("output_count"),
        total_in.alias("total_input_value_satoshi"), total_out.alias("total_output_value_satoshi"),
        up.amount("fee").alias("fee_satoshi"),
        (X.normal_label(up.column("label")) if up.has("label") else F.lit(None).cast("string")).alias("label"),
    ).where(F.col("transaction_id").isNotNull())
    rest = [c for c in rows.columns if c != "transaction_id"]
    best = rows.groupBy("transaction_id").agg(F.max(F.struct(*rest)).alias("_row"))
    return best.select("transaction_id", "_row.*")


def children(up: Upload, side: str) -> DataFrame:
    """Inputs or outputs from nested lists when present, else from the flat address column."""
    shape = [f"{side}_id string", "transaction_id string", "dataset_id string", f"{side}_index int",
             f"{side}_address string", f"{side}_value_satoshi bigint"]
    if up.has(f"{side}_addresses", f"{side}_amounts"):
        nested = up.raw.select(up.id.alias("t"), _as_array(up, f"{side}_addresses", "string").alias("a"),
                               _as_array(up, f"{side}_amounts", "bigint").alias("v"))
        pairs = F.slice(F.arrays_zip("a", "v"), F.lit(1), F.least(F.size("a"), F.size("v")))
        rows = nested.where(F.col("t").isNotNull() & F.col("a").isNotNull() & F.col("v").isNotNull()).select(
            "t", F.posexplode(pairs).alias("i", "p")).select("t", "i", F.col("p.a").alias("a"), F.col("p.v").alias("v"))
    elif up.has(f"{side}_address"):
        rows = up.raw.select(up.id.alias("t"), F.lit(0).alias("i"),
                             up.column(f"{side}_address").cast("string").alias("a"),
                             up.amount("value").alias("v")).where(F.col("a").isNotNull())
    else:
        return up.raw.sparkSession.createDataFrame([], ", ".join(shape))
    keyed = rows.groupBy("t", "i").agg(F.max(F.struct("a", "v")).alias("r"))
    return keyed.select(
        F.concat_ws(":", "t", F.col("i").cast("string")).alias(f"{side}_id"), F.col("t").alias("transaction_id"),
        F.lit(up.dataset_id).alias("dataset_id"), F.col("i").alias(f"{side}_index"),
        F.col("r.a").alias(f"{side}_address"), F.col("r.v").alias(f"{side}_value_satoshi"))


def network_events(up: Upload) -> DataFrame | None:
    """Network events carried on the transaction rows; ids come from the row's content."""
    if not any(up.has(n) for n in NETWORK_FIELDS):
        return None
    text = lambda n: up.column(n).cast("string") if up.has(n) else F.lit(None).cast("string")
    port = lambda n: (X.whole_number(up.column(n)).cast("int") if up.has(n)
                      else F.lit(None).cast("int"))
    rows = up.raw.select(
        up.id.alias("transaction_id"), F.lit(up.dataset_id).alias("dataset_id"), up.timestamp.alias("timestamp"),
        F.coalesce(F.unix_timestamp(up.timestamp), F.lit(0).cast("bigint")).alias("timestamp_epoch_sec"),
        text("src_ip").alias("src_ip"), port("src_port").alias("src_port"), text("dst_ip").alias("dst_ip"),
        port("dst_port").alias("dst_port"), F.upper(F.trim(text("country"))).alias("country"),
        (X.asn_number(up.column("asn")) if up.has("asn") else F.lit(None).cast("bigint")).alias("asn"),
    ).where(F.col("transaction_id").isNotNull())
    body = F.sha2(F.to_json(F.struct(*[c for c in rows.columns if c not in ("transaction_id", "dataset_id")])), 256)
    return rows.select(F.concat_ws("_", F.lit("EVT"), "dataset_id", "transaction_id",
                                   F.substring(body, 1, 16)).alias("event_id"), "*").distinct()


def address_rollup(transactions_: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per address: first/last seen, received, sent, distinct transactions.

    Rows are first reduced to one per (address, transaction), so a hub address is combined before it
    meets its final group, and the distinct count becomes a plain count.
    """
    moves = outputs.where(F.col("output_address").isNotNull()).select(
        F.col("output_address").alias("address_id"), "transaction_id",
        F.col("output_value_satoshi").alias("recv"), F.lit(0).cast("bigint").alias("sent"))
    moves = moves.unionByName(inputs.where(F.col("input_address").isNotNull()).select(
        F.col("input_address").alias("address_id"), "transaction_id",
        F.lit(0).cast("bigint").alias("recv"), F.col("input_value_satoshi").alias("sent")))
    per_tx = moves.groupBy("transaction_id", "address_id").agg(F.sum("recv").alias("recv"), F.sum("sent").alias("sent"))
    seen = per_tx.join(transactions_.select("transaction_id", "timestamp"), "transaction_id")
    return seen.groupBy("address_id").agg(
        F.min("timestamp").alias("first_seen_timestamp"), F.max("timestamp").alias("last_seen_timestamp"),
        F.sum("recv").alias("total_received_satoshi"), F.sum("sent").alias("total_sent_satoshi"),
        F.count(F.lit(1)).alias("transaction_count"))


def ingest(raw: DataFrame, dataset_id: str) -> dict[str, DataFrame]:
    """All canonical tables of one upload, as lazy plans."""
    up = Upload(raw, dataset_id)
    tables = {"transactions": transactions(up), "transaction_inputs": children(up, "input"),
              "transaction_outputs": children(up, "output")}
    events = network_events(up)
    if events is not None:
        tables["network_events"] = events
    tables["addresses"] = address_rollup(tables["transactions"], tables["transaction_inputs"],
                                         tables["transaction_outputs"]).withColumn("dataset_id", F.lit(dataset_id))
    return tables


def ingest_summary(up: Upload, tables: dict[str, DataFrame]) -> DataFrame:
    """One row: rejected rows, addresses, covered fields and which analyses the upload allows."""
    covered = ["transactionId"]
    covered += ["timestamp"] if up.has("timestamp") else []
    covered += ["totalOutputValueBtc"] if up.has("value") or up.has("output_amounts") else []
    covered += ["feeBtc"] if up.has("fee") else []
    covered += ["label"] if up.has("label") else []
    for side in ("output", "input"):
        if up.has(f"{side}_address") or up.has(f"{side}_addresses", f"{side}_amounts"):
            covered.append(f"{side}Address")
    covered += ["networkEvents"] if "network_events" in tables else []
    graph = any(up.has(n) for n in ("input_address", "output_address", "input_addresses", "output_addresses"))
    raw_n = up.raw.agg(F.count(F.lit(1)).alias("raw_rows"))
    tx_n = tables["transactions"].agg(F.count(F.lit(1)).alias("canonical_rows"))
    addr_n = tables["addresses"].agg(F.count(F.lit(1)).alias("address_count"))
    # three one-row frames side by side
    one = raw_n.withColumn("_j", F.lit(1)).join(tx_n.withColumn("_j", F.lit(1)), "_j").join(
        addr_n.withColumn("_j", F.lit(1)), "_j").drop("_j")
    return one.select(
        "raw_rows", "canonical_rows",
        F.greatest(F.lit(0).cast("bigint"), F.col("raw_rows") - F.col("canonical_rows")).alias("rejected_rows"),
        "address_count", F.lit(",".join(covered)).alias("covered_fields"), F.lit(graph).alias("graph_analysis"),
        F.lit(up.has("timestamp")).alias("temporal_analysis"),
        F.lit("network_events" in tables).alias("network_analysis"))
