"""Quarantine, cleaning, normalisation and decomposition of raw tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope import schemas
from ledgerscope.functions import exprs as X
from ledgerscope.functions.ordering import crowded, prefix_totals, value_bucket

DEFAULT_PORT, DEFAULT_SIZE = 8333, 250
# Estimated transaction size in bytes.
SIZE_BASE, SIZE_PER_INPUT, SIZE_PER_OUTPUT = 10, 148, 34


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the first by ``order``, else the smallest row. Combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    ranked = F.struct(*(order or rest))
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ranked).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def quarantine(df: DataFrame, key: str = "txid",
               columns: Sequence[str] = tuple(schemas.QUARANTINED_COLUMNS)) -> tuple[DataFrame, DataFrame]:
    """Split label-bearing columns off into a side table keyed by transaction."""
    leaked = [c for c in columns if c in df.columns]
    return df.drop(*leaked), df.select(key, *leaked)


def _tidy_key(df: DataFrame) -> DataFrame:
    return df.withColumn("txid", F.lower(F.trim("txid")))


def clean_transactions(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Drop null ids, lower-case them, keep one row per id, impute a missing fee as input minus output."""
    out = _tidy_key(df.where(F.col("txid").isNotNull()))
    if "block_hash" in out.columns:
        out = out.withColumn("block_hash", F.lower(F.trim("block_hash")))
    out = keep_first(out, ["txid"], order)
    return out.withColumn("fee_satoshi", F.coalesce(
        "fee_satoshi", F.col("total_input_value_satoshi") - F.col("total_output_value_satoshi")))


def clean_children(df: DataFrame, index: str, transactions: DataFrame | None,
                   order: Sequence[str] | None = None) -> DataFrame:
    """Inputs or outputs: drop null keys, tidy, one row per ``(txid, index)``, drop orphans."""
    out = _tidy_key(df.where(F.col("txid").isNotNull() & F.col(index).isNotNull()))
    if "address" in out.columns:
        out = out.withColumn("address", F.trim("address"))
    if "prev_txid" in out.columns:
        out = out.withColumn("prev_txid", F.lower(F.trim("prev_txid")))
    out = keep_first(out, ["txid", index], order)
    return out if transactions is None else out.join(transactions.select("txid"), "txid", "left_semi")


def clean_network_events(df: DataFrame, transactions: DataFrame | None,
                         order: Sequence[str] | None = None) -> DataFrame:
    """Drop null keys, tidy, one row per event id, default port, upper-case country, drop orphans."""
    out = _tidy_key(df.where(F.col("event_id").isNotNull() & F.col("txid").isNotNull()))
    out = (out.withColumn("event_id", F.trim("event_id")).withColumn("src_ip", F.trim("src_ip"))
           .withColumn("dst_ip", F.trim("dst_ip")).withColumn("country", F.upper(F.trim("country"))))
    out = keep_first(out, ["event_id"], order).withColumn("dst_port", F.coalesce("dst_port", F.lit(DEFAULT_PORT)))
    return out if transactions is None else out.join(transactions.select("txid"), "txid", "left_semi")


def clean(raw: Mapping[str, DataFrame], order: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """All four tables cleaned."""
    tx = clean_transactions(raw["transactions"], order)
    return {
        "transactions": tx,
        "transaction_inputs": clean_children(raw["transaction_inputs"], "input_index", tx, order),
        "transaction_outputs": clean_children(raw["transaction_outputs"], "output_index", tx, order),
        "network_events": clean_network_events(raw["network_events"], tx, order),
    }


def cleaning_statistics(raw: Mapping[str, DataFrame]) -> DataFrame:
    """``(entity, metric, n)``: rows dropped as null-keyed or duplicate, and values imputed."""
    keys = {"transactions": ["txid"], "transaction_inputs": ["txid", "input_index"],
            "transaction_outputs": ["txid", "output_index"], "network_events": ["event_id", "txid"]}
    tidy = {"txid": F.lower(F.trim("txid")), "event_id": F.trim("event_id")}
    parts = []
    for name, required in keys.items():
        df = raw[name]
        whole = F.lit(True)
        for c in required:
            whole = whole & F.col(c).isNotNull()
        unique = ["event_id"] if name == "network_events" else required
        imputed = F.lit(False)
        if name == "transactions":
            imputed = F.col("fee_satoshi").isNull() & F.col("total_input_value_satoshi").isNotNull() \
                & F.col("total_output_value_satoshi").isNotNull()
        elif name == "network_events":
            imputed = F.col("dst_port").isNull()
        per_key = (df.groupBy(whole.alias("_ok"), *[tidy.get(c, F.col(c)).alias(c) for c in unique])
                   .agg(F.count(F.lit(1)).alias("_n"), F.max(imputed.cast("int")).alias("_i")))
        per = per_key.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("_all"),
            F.coalesce(F.sum(F.when(F.col("_ok"), 1)), F.lit(0)).cast("bigint").alias("_kept"),
            F.coalesce(F.sum(F.when(F.col("_ok"), F.col("_i"))), F.lit(0)).cast("bigint").alias("_imp"))
        rows = [F.struct(F.lit("dropped").alias("metric"), (F.col("_all") - F.col("_kept")).alias("n"))]
        if name == "transactions":
            rows.append(F.struct(F.lit("imputed_fee_satoshi").alias("metric"), F.col("_imp").alias("n")))
        if name == "network_events":
            rows.append(F.struct(F.lit("imputed_dst_port").alias("metric"), F.col("_imp").alias("n")))
        parts.append(per.select(F.lit(name).alias("entity"), F.inline(F.array(*rows))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def normalize_transactions(df: DataFrame, dataset_id: str) -> DataFrame:
    total_in, total_out, fee = (F.col(c).cast("double") for c in (
        "total_input_value_satoshi", "total_output_value_satoshi", "fee_satoshi"))
    size = F.greatest(F.coalesce("transaction_size_bytes", F.lit(DEFAULT_SIZE)), F.lit(1))
    first = df.select(
        F.col("txid").alias("transaction_id"), F.lit(dataset_id).alias("dataset_id"),
        F.col("timestamp").cast("timestamp").alias("timestamp"),
        *[c for c in df.columns if c not in ("txid", "timestamp", "dataset_id")])
    return first.select(
        "*", F.unix_timestamp("timestamp").alias("timestamp_epoch_sec"),
        (total_in / X.SAT_PER_BTC).alias("total_input_btc"), (total_out / X.SAT_PER_BTC).alias("total_output_btc"),
        (fee / X.SAT_PER_BTC).alias("fee_btc"), (fee / size).alias("fee_rate_sat_per_byte"),
        X.clip(total_out / F.greatest(total_in, F.lit(1.0)), 0.0, 1.0).alias("value_balance_ratio"),
        F.log1p(total_out).alias("log_total_value_satoshi"), F.log1p(fee).alias("log_fee_satoshi"))


def _normalize_children(df: DataFrame, dataset_id: str, side: str) -> DataFrame:
    index, extra = f"{side}_index", [c for c in ("is_change", "script_type", "prev_txid", "prev_output_index")
                                     if c in df.columns]
    return df.select(
        F.concat_ws(":", "txid", F.col(index).cast("string")).alias(f"{side}_id"),
        F.col("txid").alias("transaction_id"), F.lit(dataset_id).alias("dataset_id"), index,
        F.col("address").alias(f"{side}_address"), F.col("amount_satoshi").alias(f"{side}_value_satoshi"),
        X.btc("amount_satoshi").alias(f"{side}_value_btc"), *extra)


def normalize_inputs(df: DataFrame, dataset_id: str) -> DataFrame:
    return _normalize_children(df, dataset_id, "input")


def normalize_outputs(df: DataFrame, dataset_id: str) -> DataFrame:
    return _normalize_children(df, dataset_id, "output")


def normalize_network_events(df: DataFrame, dataset_id: str) -> DataFrame:
    return df.select(
        "event_id", F.col("txid").alias("transaction_id"), F.lit(dataset_id).alias("dataset_id"),
        F.col("timestamp").cast("timestamp").alias("timestamp"),
        F.unix_timestamp(F.col("timestamp").cast("timestamp")).alias("timestamp_epoch_sec"),
        "src_ip", "src_port", "dst_ip", "dst_port", "country", F.col("asn").cast("bigint").alias("asn"))


def normalize(cleaned: Mapping[str, DataFrame], dataset_id: str) -> dict[str, DataFrame]:
    return {
        "transactions": normalize_transactions(cleaned["transactions"], dataset_id),
        "transaction_inputs": normalize_inputs(cleaned["transaction_inputs"], dataset_id),
        "transaction_outputs": normalize_outputs(cleaned["transaction_outputs"], dataset_id),
        "network_events": normalize_network_events(cleaned["network_events"], dataset_id),
    }


def _zipped(addresses: str, amounts: str) -> object:
    """Pairs of the two lists, cut to the shorter one."""
    return F.slice(F.arrays_zip(F.col(addresses).alias("a"), F.col(amounts).alias("v")), F.lit(1),
                   F.least(F.size(addresses), F.size(amounts)))


def explode_children(df: DataFrame, addresses: str, amounts: str, side: str) -> DataFrame:
    """One row per list position of the nested address and amount lists, index from the position."""
    pairs = df.where(F.col(addresses).isNotNull() & F.col(amounts).isNotNull()).select(
        "txid", F.posexplode(_zipped(addresses, amounts)).alias("pos", "pair"))
    return pairs.select("txid", F.col("pos").alias(f"{side}_index"),
                        F.trim("pair.a").alias("address"),
                        F.col("pair.v").cast("bigint").alias("amount_satoshi"))


def decompose_consolidated(df: DataFrame, dataset_id: str) -> dict[str, DataFrame]:
    """Nested consolidated rows to the four canonical tables, one scan per table."""
    base = _tidy_key(df.drop(*[c for c in schemas.QUARANTINED_COLUMNS if c in df.columns])
                     .withColumn("timestamp", F.col("timestamp").cast("timestamp")))
    n_in, n_out = F.size("input_addresses"), F.size("output_addresses")
    transactions = base.select(
        "txid", "timestamp", n_in.alias("input_count"), n_out.alias("output_count"),
        X.list_total(F.col("input_amounts")).alias("total_input_value_satoshi"),
        X.list_total(F.col("output_amounts")).alias("total_output_value_satoshi"),
        F.col("fee").cast("bigint").alias("fee_satoshi"),
        (n_in * SIZE_PER_INPUT + n_out * SIZE_PER_OUTPUT + SIZE_BASE).alias("transaction_size_bytes"))
    events = base.select(
        F.concat(F.lit("EVT_"), F.substring("txid", 1, 16)).alias("event_id"), "txid", "timestamp",
        F.trim("src_ip").alias("src_ip"), F.col("src_port").cast("int").alias("src_port"),
        F.trim("dst_ip").alias("dst_ip"), F.col("dst_port").cast("int").alias("dst_port"),
        F.upper(F.trim("country")).alias("country"), X.asn_number("asn").alias("asn"))
    return normalize({
        "transactions": transactions,
        "transaction_inputs": explode_children(base, "input_addresses", "input_amounts", "input"),
        "transaction_outputs": explode_children(base, "output_addresses", "output_amounts", "output"),
        "network_events": events,
    }, dataset_id)


# Names accepted for the same column.
COLUMN_ALIASES = {
    "transaction_id": ["txid"], "transaction_size_bytes": ["size_bytes"],
    "input_address": ["address"], "output_address": ["address"],
    "input_value_satoshi": ["amount_satoshi"], "output_value_satoshi": ["amount_satoshi"],
}


def alias_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Add any wanted column that is only present under another name; raise when it has none."""
    out, missing = df, []
    for name in wanted:
        if name in out.columns:
            continue
        source = next((a for a in COLUMN_ALIASES.get(name, []) if a in out.columns), None)
        if source is None:
            missing.append(name)
        else:
            out = out.withColumn(name, F.col(source))
    if missing:
        raise ValueError(f"required columns missing: {', '.join(missing)}")
    return out


def fill_child_counts(transactions: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Missing input/output counts from the child rows (1 when there are none), and which were imputed."""
    n_in = inputs.groupBy("transaction_id").agg(F.count(F.lit(1)).cast("int").alias("_in"))
    n_out = outputs.groupBy("transaction_id").agg(F.count(F.lit(1)).cast("int").alias("_out"))
    have = {c: (F.col(c) if c in transactions.columns else F.lit(None).cast("int"))
            for c in ("input_count", "output_count")}
    rest = [c for c in transactions.columns if c not in have]
    joined = transactions.join(n_in, "transaction_id", "left").join(n_out, "transaction_id", "left")
    return joined.select(
        *rest, F.coalesce(have["input_count"], "_in", F.lit(1)).alias("input_count"),
        F.coalesce(have["output_count"], "_out", F.lit(1)).alias("output_count"),
        F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in have.items()])).alias("imputed"))


def running_child_index(df: DataFrame, side: str, order: Sequence[str]) -> DataFrame:
    """Zero-based index per transaction for child rows that come without one.

    The first order column must be numeric: its values cut a transaction with very many children into
    pieces that are counted apart. All others are counted in one window each.
    """
    known = df.where(F.col("transaction_id").isNotNull() & F.col(order[0]).isNotNull())
    crowd = F.broadcast(crowded(known, ["transaction_id"]))
    index = F.row_number().over(Window.partitionBy("transaction_id").orderBy(*order)) - 1
    few = known.join(crowd, "transaction_id", "left_anti").select(*df.columns, index.cast("int").alias(f"{side}_index"))
    ones = known.join(crowd, "transaction_id", "left_semi").withColumn("_one", F.lit(1).cast("bigint"))
    ranked = prefix_totals(ones, value_bucket(F.col(order[0])), F.col(order[0]), order, ["_one"], ["transaction_id"])
    return few.unionByName(ranked.select(*df.columns, F.col("before__one").cast("int").alias(f"{side}_index")))


def repair_network_types(df: DataFrame) -> DataFrame:
    """Ports numeric else 0 / 8333, country else UNKNOWN, ASN its first digits else 0."""
    return df.select(
        *[c for c in df.columns if c not in ("src_port", "dst_port", "country", "asn")],
        F.coalesce(X.whole_number("src_port").cast("int"), F.lit(0)).alias("src_port"),
        F.coalesce(X.whole_number("dst_port").cast("int"), F.lit(DEFAULT_PORT)).alias("dst_port"),
        F.coalesce("country", F.lit("UNKNOWN")).alias("country"), X.asn_first_digits("asn").alias("asn"))
