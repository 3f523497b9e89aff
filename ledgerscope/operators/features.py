"""Point-in-time transaction features. Every ``hist`` value looks only at earlier transactions.

"Earlier" is the order K = (epoch second, transaction id) of the address, network and graph features;
the velocity counts look at strictly earlier seconds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope import schemas
from ledgerscope.functions import exprs as X
from ledgerscope.functions.ordering import DAY, before_in_piece, chronological_index, crowded, from_starts, piece_starts, pieces, running_before
from ledgerscope.session import pin

TX, TS = "transaction_id", "timestamp_epoch_sec"
NEW_ADDRESS_GAP = 86400.0
BURST_GAP = 10.0
VELOCITY_WINDOWS = {"time_txs_last_1m": 60, "time_txs_last_5m": 300, "time_txs_last_1h": 3600}


def _or_zero(c: Column | str) -> Column:
    return F.coalesce(X.as_col(c), F.lit(0))


def input_statistics(inputs: DataFrame) -> DataFrame:
    """Per transaction: average, largest and distinct inputs, and the primary sender (lowest index)."""
    # dealt by transaction first, so both groupings share one shuffle
    per_address = inputs.repartition(TX).groupBy(TX, F.trim("input_address").alias("a")).agg(
        F.sum("input_value_satoshi").alias("s"), F.count("input_value_satoshi").alias("n"),
        F.max("input_value_satoshi").alias("m"), F.min("input_index").alias("i"))
    return per_address.groupBy(TX).agg(
        (F.sum("s").cast("double") / F.sum("n")).alias("tx_avg_input_value_sats"),
        F.max("m").alias("tx_max_input_value_sats"), F.count("a").alias("rel_fan_in"),
        F.min_by("a", "i").alias("sender"))


def output_statistics(outputs: DataFrame) -> DataFrame:
    """Per transaction: average, largest and distinct outputs, and the change total (NULL without change)."""
    change = F.when(F.col("is_change"), F.col("output_value_satoshi"))
    per_address = outputs.repartition(TX).groupBy(TX, F.trim("output_address").alias("a")).agg(
        F.sum("output_value_satoshi").alias("s"), F.count("output_value_satoshi").alias("n"),
        F.max("output_value_satoshi").alias("m"), F.sum(change).alias("c"),
        F.max(F.col("is_change").cast("int")).alias("h"))
    return per_address.groupBy(TX).agg(
        (F.sum("s").cast("double") / F.sum("n")).alias("tx_avg_output_value_sats"),
        F.max("m").alias("tx_max_output_value_sats"), F.count("a").alias("rel_fan_out"),
        F.sum("c").alias("change_sats"), F.max("h").alias("has_change"))


def primary_senders(inputs: DataFrame) -> DataFrame:
    """The sender of each transaction: its address with the lowest input index."""
    return inputs.groupBy(TX).agg(F.min_by(F.trim("input_address"), "input_index").alias("sender"))


def with_sender_key(transactions: DataFrame, senders: DataFrame) -> DataFrame:
    """Transactions with ``sender`` and ``sender_key``; without inputs the key is private to the row."""
    joined = transactions.join(senders.select(TX, "sender"), TX, "left")
    return joined.withColumn("sender_key", F.coalesce("sender", F.concat(F.lit("unknown_sender_"), TX)))


def _tx_features_columns() -> list[Column]:
    t_in, t_out, fee = (F.col(c).cast("double") for c in (
        "total_input_value_satoshi", "total_output_value_satoshi", "fee_satoshi"))
    size = F.coalesce("transaction_size_bytes", F.lit(250))
    return [
        F.col("input_count").alias("tx_input_count"), F.col("output_count").alias("tx_output_count"),
        (F.col("input_count") / F.greatest("output_count", F.lit(1))).alias("tx_input_output_ratio"),
        F.col("total_input_value_satoshi").alias("tx_total_input_sats"),
        F.col("total_output_value_satoshi").alias("tx_total_output_sats"), F.col("fee_satoshi").alias("tx_fee_sats"),
        size.alias("tx_size_bytes"), (fee / F.greatest(size, F.lit(1))).alias("tx_fee_rate_sat_per_byte"),
        X.clip(t_out / F.greatest(t_in, F.lit(1.0)), 0.0, 1.0).alias("tx_value_balance_ratio"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in (
            "tx_avg_input_value_sats", "tx_max_input_value_sats", "tx_avg_output_value_sats",
            "tx_max_output_value_sats")],
        F.log1p(F.greatest(t_out, F.lit(0.0))).alias("tx_log_total_value"),
        F.log1p(F.greatest(fee, F.lit(0.0))).alias("tx_log_fee"),
    ]


def _relation_columns() -> list[Column]:
    return [
        F.coalesce("rel_fan_in", F.lit(1)).alias("rel_fan_in"), F.coalesce("rel_fan_out", F.lit(1)).alias("rel_fan_out"),
        F.coalesce("has_change", F.lit(0)).alias("rel_has_change_output"),
        X.clip(_or_zero("change_sats") / F.greatest(F.col("total_output_value_satoshi").cast("double"), F.lit(1.0)),
               0.0, 1.0).alias("rel_change_value_ratio"),
    ]


def transaction_features(transactions: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Counts, totals, rates, averages and log values of each transaction."""
    joined = transactions.join(input_statistics(inputs), TX, "left").join(output_statistics(outputs), TX, "left")
    return joined.select(TX, *_tx_features_columns())


def relation_features(transactions: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Distinct counterparts and change share of each transaction."""
    joined = transactions.join(input_statistics(inputs), TX, "left").join(output_statistics(outputs), TX, "left")
    return joined.select(TX, *_relation_columns())


_EVENT_SUMS = ("in_rows", "out_rows", "is_sender", "sent", "received", "new_cp")


def _event_rows(transactions: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """The rows that ``address_events`` sums: what each role of an address in a transaction contributes."""
    tx = with_sender_key(transactions, primary_senders(inputs)).select(
        TX, TS, "sender", "sender_key", F.col("total_output_value_satoshi").alias("out_total"))
    ins = inputs.select(TX, F.trim("input_address").alias("address")).where("address IS NOT NULL").repartition(TX)
    ins = ins.groupBy(TX, "address").agg(F.count(F.lit(1)).alias("in_rows"))
    # dealt by transaction once, for the distinct addresses, their number and the join
    outs = outputs.select(TX, F.trim("output_address").alias("address")).where("address IS NOT NULL").repartition(TX)
    outs = outs.groupBy(TX, "address").agg(F.count(F.lit(1)).alias("out_rows"))
    recipients = outs.groupBy(TX).agg(F.count(F.lit(1)).alias("n_recipients"))

    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def event(address: str, **values: Column) -> list[Column]:
        return [F.col(address).alias("address"), F.col(TS), F.col(TX), *[values.get(n, zero).alias(n) for n in _EVENT_SUMS]]

    # a sender is one of the input addresses, unless there is none
    sends = tx.where(F.col("sender").isNull()).select(*event("sender_key", is_sender=one, sent=F.col("out_total")))
    own = F.coalesce(F.col("address") == F.col("sender"), F.lit(False))
    spends = ins.join(tx, TX).select(*event("address", in_rows=F.col("in_rows"), is_sender=F.when(own, one).otherwise(zero),
                                            sent=F.when(own, F.col("out_total")).otherwise(zero)))
    received = outs.join(tx, TX).join(recipients, TX).select(
        "address", TS, TX, "sender_key", "out_rows", F.expr("out_total div n_recipients").alias("share"))
    gets = received.select(*event("address", out_rows=F.col("out_rows"), received=F.coalesce("share", zero)))
    # a counterparty counts from the first transaction that links the two addresses, in either role: once per pair, then for both of it
    a, b = F.least("address", "sender_key"), F.greatest("address", "sender_key")
    pairs = received.groupBy(a.alias("a"), b.alias("b")).agg(F.min(F.struct(TS, TX)).alias("k"))
    both = F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))
    firsts = pairs.select(F.explode(both).alias("a"), "k.*").select(*event("a", new_cp=one))
    return sends.unionByName(spends).unionByName(gets).unionByName(firsts)


def address_events(transactions: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row per (address, transaction): its roles, the value sent and received, and new counterparties."""
    return _event_rows(transactions, inputs, outputs).groupBy("address", TS, TX).agg(*[F.sum(c).alias(c) for c in _EVENT_SUMS])


def linked_events(transactions: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """``address_events`` for streams: the addresses that a transaction links an address to, in place of the count of new ones."""
    tx = with_sender_key(transactions, primary_senders(inputs)).select(TX, "sender_key")
    outs = outputs.select(TX, F.trim("output_address").alias("address")).where("address IS NOT NULL").distinct().join(tx, TX)
    links = outs.select(TX, F.explode(F.array(F.struct(F.col("address").alias("a"), F.col("sender_key").alias("b")),
                                              F.struct(F.col("sender_key").alias("a"), F.col("address").alias("b")))).alias("l"))
    others = links.groupBy(TX, F.col("l.a").alias("address")).agg(F.collect_set(F.coalesce("l.b", F.lit(""))).alias("counterparties"))
    events = address_events(transactions, inputs, outputs).drop("new_cp")
    matched = others.select(F.col(TX).alias("_t"), F.col("address").alias("_a"), "counterparties")
    return events.join(matched, (F.col(TX) == F.col("_t")) & F.col("address").eqNullSafe(F.col("_a")), "left").drop("_t", "_a")


def address_timeline(transactions: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row per (address, transaction) with everything known about the address before it.

    Roles in the transaction: ``in_rows``, ``out_rows``, ``is_sender``. Earlier activity of the address:
    ``prior_rows``, ``prior_sends``, ``prior_sent``, ``prior_received``, ``prior_counterparties``,
    ``prior_first_seen``, ``prior_last_send``.
    """
    keys, order = ["address"], [TS, TX]
    wanted = {"sums": {"prior_rows": "_rows", "prior_sends": "is_sender", "prior_sent": "sent",
                       "prior_received": "received", "prior_counterparties": "new_cp"},
              "mins": {"prior_first_seen": "_seen"}, "maxs": {"prior_last_send": "_send"}}
    # an address is in no more transactions than it has input and output rows
    seen = inputs.select(F.trim("input_address").alias("address")).unionByName(outputs.select(F.trim("output_address").alias("address")))
    rows = pieces(_event_rows(transactions, inputs, outputs), keys, F.floor(F.col(TS) / DAY), crowded(seen, keys))
    # dealt by piece, which serves the sums and the windows
    events = rows.repartition("address", "_b").groupBy("address", "_b", TS, TX).agg(*[F.sum(c).alias(c) for c in _EVENT_SUMS])
    local = before_in_piece(_with_marks(events), keys, order, **wanted)
    # read twice below, so written once; what a row itself adds is needed for the totals of pieces only
    cut = F.col("_b").isNotNull()
    local = pin(local.select("address", TS, TX, "in_rows", "out_rows", "is_sender", "_b", *[F.when(cut, F.col(c)).alias(c) for c in ("sent", "received", "new_cp")],
                             *[c for c in local.columns if c.startswith("_l_")]), "timeline")
    starts = pin(piece_starts(_with_marks(local), keys, **wanted), "timeline-starts")
    return from_starts(local, starts, keys, **wanted).drop("new_cp", "sent", "received")


def address_appearances(transactions: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """``in_rows``, ``out_rows`` and ``prior_rows`` of the timeline for transactions with inputs or outputs of the address, without counterparties and values."""
    sides = inputs.select(F.trim("input_address").alias("address"), TX, F.lit(1).alias("i")).unionByName(
        outputs.select(F.trim("output_address").alias("address"), TX, F.lit(0).alias("i"))).where("address IS NOT NULL")
    # dealt by transaction once, for the sums and the join
    rows = sides.repartition(TX).groupBy(TX, "address").agg(F.sum("i").cast("bigint").alias("in_rows"), F.sum(1 - F.col("i")).cast("bigint").alias("out_rows"))
    rows = rows.join(transactions.select(TX, TS), TX).withColumn("_rows", F.col("in_rows") + F.col("out_rows"))
    return running_before(rows, ["address"], F.floor(F.col(TS) / DAY), [TS, TX], sums={"prior_rows": "_rows"},
                          crowd=crowded(sides, ["address"])).drop("_rows")


def _with_marks(events: DataFrame) -> DataFrame:
    """Rows of an address in a transaction, and when it was seen and sent; being seen follows sends and receipts, not secondary inputs."""
    return events.select("*", (F.col("in_rows") + F.col("out_rows")).alias("_rows"),
                         F.when((F.col("is_sender") > 0) | (F.col("out_rows") > 0), F.col(TS)).alias("_seen"),
                         F.when(F.col("is_sender") > 0, F.col(TS)).alias("_send"))


def _history_columns() -> list[Column]:
    n = F.col("prior_sends")
    days = F.when(n > 0, F.greatest(F.lit(0.0), (F.col(TS) - F.coalesce("prior_first_seen", TS)) / float(DAY))
                  ).otherwise(0.0)
    return [
        n.alias("addr_hist_tx_count"), F.col("prior_sent").alias("addr_hist_total_sent_sats"),
        F.col("prior_received").alias("addr_hist_total_received_sats"),
        F.when(n > 0, F.col("prior_sent").cast("double") / n).otherwise(0.0).alias("addr_hist_avg_tx_val_sats"),
        F.col("prior_counterparties").alias("addr_hist_unique_counterparties"), days.alias("addr_hist_active_days"),
        F.when(n > 0, n / F.greatest(days, F.lit(1.0))).otherwise(0.0).alias("addr_hist_tx_per_day"),
        n.alias("addr_reuse_count"),
    ]


def _pacing_columns() -> list[Column]:
    gap = F.coalesce((F.col(TS) - F.col("prior_last_send")).cast("double"), F.lit(NEW_ADDRESS_GAP))
    return [gap.alias("time_since_prev_addr_tx_sec"), (gap < BURST_GAP).cast("int").alias("time_burst_indicator")]


def address_features(timeline: DataFrame) -> DataFrame:
    """History of the sending address, read before the transaction."""
    return timeline.where(F.col("is_sender") > 0).select(TX, *_history_columns())


def sender_pacing(timeline: DataFrame) -> DataFrame:
    """Seconds since the sender's previous transaction, one day when it is new; and the burst flag."""
    return timeline.where(F.col("is_sender") > 0).select(TX, *_pacing_columns())


def second_velocity(transactions: DataFrame) -> DataFrame:
    """Per distinct second: rows in the preceding windows, the previous busy second, its first id.

    Seconds are counted first and windowed inside hour buckets, each second also standing in the next
    bucket, so the one-hour look-back never leaves its bucket.
    """
    per_second = transactions.where(F.col(TS).isNotNull()).groupBy(TS).agg(
        F.count(F.lit(1)).alias("n"), F.min(TX).alias("first_tx"))
    hour = F.floor(F.col(TS) / 3600)
    copies = per_second.select("*", F.explode(F.array(hour, hour + 1)).alias("bucket"))
    by_time = Window.partitionBy("bucket").orderBy(TS)
    counts = {name: _or_zero(F.sum("n").over(by_time.rangeBetween(-w, -1))) for name, w in VELOCITY_WINDOWS.items()}
    inside = copies.select("*", *[c.alias(n) for n, c in counts.items()], F.lag(TS).over(by_time).alias("_prev"))
    own = inside.where(F.col("bucket") == hour)
    # the first second of a bucket looks back to the last second of any earlier bucket (one row per hour)
    last = per_second.groupBy(hour.alias("bucket")).agg(F.max(TS).alias("_last"))
    last = last.select("bucket", F.lag("_last").over(Window.orderBy("bucket")).alias("_before"))
    return own.join(last, "bucket").select(
        TS, "first_tx", *VELOCITY_WINDOWS, F.coalesce("_prev", "_before").alias("prev_second"))


def _clock_columns() -> list[Column]:
    gap = F.when(F.col(TX) != F.col("first_tx"), 0.0).otherwise(
        F.coalesce((F.col(TS) - F.col("prev_second")).cast("double"), F.lit(0.0)))
    return [
        F.hour("timestamp").alias("time_hour_of_day"), F.weekday("timestamp").alias("time_day_of_week"),
        gap.alias("time_since_prev_global_tx_sec"), *VELOCITY_WINDOWS,
    ]


def temporal_features(transactions: DataFrame, timeline: DataFrame, experimental: bool = False) -> DataFrame:
    """Clock, global pacing, velocity and sender pacing features."""
    joined = transactions.join(second_velocity(transactions), TS, "left").join(sender_pacing(timeline), TX, "left")
    extra = ["time_burst_indicator"] if experimental else []
    return joined.select(TX, *_clock_columns(), "time_since_prev_addr_tx_sec", *extra)


def network_history(transactions: DataFrame, inputs: DataFrame, events: DataFrame) -> DataFrame:
    """Events with the number of distinct source IPs its sender used in earlier events."""
    keyed = with_sender_key(events, primary_senders(inputs)).withColumn("_ip", F.trim("src_ip"))
    order = ["ev_ts", TX, "event_id"]
    keyed = keyed.withColumnRenamed(TS, "ev_ts")
    firsts = keyed.where(F.col("_ip").isNotNull()).groupBy("sender_key", "_ip").agg(
        F.min(F.struct(*order)).alias("k")).select("sender_key", "k.*", F.lit(1).cast("bigint").alias("new_ip"))
    marked = keyed.join(firsts, ["sender_key", *order], "left").withColumn("new_ip", F.coalesce("new_ip", F.lit(0)))
    return running_before(marked, ["sender_key"], F.floor(F.col("ev_ts") / DAY), order,
                          sums={"net_hist_unique_ips_for_addr": "new_ip"}, crowd=crowded(keyed, ["sender_key"])).drop("_ip", "new_ip")


def latest_event_at_or_before(transactions: DataFrame, events: DataFrame, event_ts: str = "ev_ts") -> DataFrame:
    """As-of pick: the last event of each transaction not later than the transaction itself."""
    joined = events.join(transactions.select(TX, TS), TX)
    usable = joined.where(F.col(event_ts) <= F.col(TS)).drop(TS)
    rest = [c for c in events.columns if c != TX]
    picked = usable.groupBy(TX).agg(F.max_by(F.struct(*rest), F.struct(event_ts, "event_id")).alias("e"))
    return picked.select(TX, "e.*")


def network_features(transactions: DataFrame, inputs: DataFrame, events: DataFrame, history: bool = True) -> DataFrame:
    """Ports, ASN, country and IP diversity from the picked event; no row when none qualifies. ``history`` False leaves the IP diversity out."""
    known = network_history(transactions, inputs, events) if history else events.withColumnRenamed(TS, "ev_ts")
    diversity = ["net_hist_unique_ips_for_addr"] if history else []
    picked = latest_event_at_or_before(transactions, known.select(TX, "event_id", "ev_ts", "src_port", "dst_port", "asn", "country", *diversity))
    port = F.coalesce("dst_port", F.lit(8333))
    return picked.select(
        TX, F.coalesce("src_port", F.lit(0)).alias("net_src_port"), port.alias("net_dst_port"),
        (port == 8333).cast("int").alias("net_is_standard_bitcoin_port"), F.coalesce("asn", F.lit(0)).alias("net_asn"),
        *[_or_zero(c).alias(c) for c in diversity], F.coalesce("country", F.lit("UNKNOWN")).alias("net_country"))


_OF_INPUTS = {"tx_avg_input_value_sats", "tx_max_input_value_sats", "rel_fan_in"}
_OF_OUTPUTS = {"tx_avg_output_value_sats", "tx_max_output_value_sats", "rel_fan_out", "rel_has_change_output", "rel_change_value_ratio"}
_OF_SECONDS = {"time_since_prev_global_tx_sec", *VELOCITY_WINDOWS}
_OF_SENDER = {*schemas.ADDRESS_FEATURES, "time_since_prev_addr_tx_sec"}


def feature_columns(tables: Mapping[str, DataFrame], names: Sequence[str], timeline: DataFrame | None = None) -> DataFrame:
    """Columns ``names`` of ``feature_matrix``, one row per transaction, by those steps alone that one of them comes from."""
    wanted = set(names)
    tx, ins = tables["transactions"], tables["transaction_inputs"]
    joined = tx
    if wanted & _OF_SECONDS:  # by second while the rows are short, then by transaction
        joined = joined.join(second_velocity(tx), TS, "left")
    if wanted & _OF_INPUTS:
        joined = joined.join(input_statistics(ins).drop("sender"), TX, "left")
    if wanted & _OF_OUTPUTS:
        joined = joined.join(output_statistics(tables["transaction_outputs"]), TX, "left")
    if wanted & _OF_SENDER:
        timeline = address_timeline(tx, ins, tables["transaction_outputs"]) if timeline is None else timeline
        joined = joined.join(timeline.where(F.col("is_sender") > 0).select(TX, *_history_columns(), _pacing_columns()[0]), TX, "left")
    if wanted & set(schemas.NETWORK_FEATURES):
        joined = joined.join(network_features(tx, ins, tables["network_events"], "net_hist_unique_ips_for_addr" in wanted), TX, "left")
    formed = dict(zip([*schemas.TX_FEATURES, *schemas.TIME_FEATURES[:-1], *schemas.RELATION_FEATURES],
                      [*_tx_features_columns(), *_clock_columns(), *_relation_columns()], strict=True))
    return joined.select(TX, *[formed.get(n, F.col(n)) for n in names])


def feature_matrix(tables: Mapping[str, DataFrame], timeline: DataFrame | None = None) -> DataFrame:
    """All tabular features, exactly one row per transaction."""
    return feature_columns(tables, schemas.MATRIX_FEATURES, timeline)


def modelling_table(features: DataFrame, graph: DataFrame, transactions: DataFrame, labels: DataFrame) -> DataFrame:
    """Features, graph features, time and labels of every transaction present in all four."""
    return (features.join(graph, TX).join(transactions.select(TX, "dataset_id", "timestamp", TS), TX)
            .join(labels.select(TX, "behavior_type", "ground_truth_label"), TX))


def chronological_split(df: DataFrame, train: float = 0.70, validation: float = 0.85) -> DataFrame:
    """Add ``temporal_split``: the first share of rows in time order trains, the next validates, the rest tests."""
    ranked = chronological_index(df, TS, TX)
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    sized = ranked.withColumn("_j", F.lit(1)).join(F.broadcast(total.withColumn("_j", F.lit(1))), "_j").drop("_j")
    at = lambda share: F.floor(F.col("_n") * share)
    return sized.select(
        *df.columns, F.col("position").alias("chronological_index"),
        F.when(F.col("position") < at(train), "train").when(F.col("position") < at(validation), "val")
        .otherwise("test").alias("temporal_split"))


def first_entities(df: DataFrame, limit: int) -> DataFrame:
    """The first rows in chronological order, for a capped analysis."""
    return df.orderBy(TS, TX).limit(limit)


def require_features(df: DataFrame, names: list[str]) -> DataFrame:
    """Complete a frame for a model: missing numeric columns 0.0, a missing country UNKNOWN, nulls filled alike."""
    default = lambda n: F.lit("UNKNOWN") if n == "net_country" else F.lit(0.0)
    have = set(df.columns)
    return df.select(*[c for c in df.columns if c not in names], *[
        (F.coalesce(F.col(n), default(n)) if n in have else default(n)).alias(n) for n in names])
