"""Data-quality rules. Every check ends as a row ``(rule_id, severity, violations, checked)``."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import schemas
from ledgerscope.functions import exprs as X

DUST_BELOW = 546


def _bad(condition: Column) -> Column:
    """Violations of a condition that must hold; NULL counts as a violation."""
    return F.count(F.when(~F.coalesce(condition, F.lit(False)), 1))


def _rules(agg: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One-row aggregate to rule rows; ``rules`` lists (rule id, severity, column)."""
    rows = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"),
                              F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("violations"),
                              F.coalesce(F.col("checked"), F.lit(0)).cast("bigint").alias("checked"))
                     for r, s, c in rules])
    return agg.select(F.inline(rows))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def duplicate_keys(df: DataFrame, keys: Sequence[str], rule_id: str) -> DataFrame:
    """Extra rows beyond the first of each key. Counts combine before the shuffle."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    agg = per_key.agg(F.sum(F.col("n") - 1).alias("v"), F.sum("n").alias("checked"))
    return _rules(agg, [(rule_id, "error", "v")])


def orphans(children: DataFrame, transactions: DataFrame, rule_id: str) -> DataFrame:
    """Distinct transaction ids of child rows without a transaction."""
    ids = children.select("txid").where(F.col("txid").isNotNull()).distinct()
    known = transactions.select("txid", F.lit(True).alias("known")).distinct()
    agg = ids.join(known, "txid", "left").agg(F.count(F.when(F.col("known").isNull(), 1)).alias("v"),
                                              F.count(F.lit(1)).alias("checked"))
    return _rules(agg, [(rule_id, "error", "v")])


def transaction_rules(tx: DataFrame) -> DataFrame:
    """Identifier format, signs and header conservation in one pass."""
    total_in, total_out, fee = F.col("total_input_value_satoshi"), F.col("total_output_value_satoshi"), F.col("fee_satoshi")
    agg = tx.agg(
        F.count(F.lit(1)).alias("checked"), _bad(F.col("txid").rlike(X.HEX64)).alias("hex"),
        F.count(F.when(fee < 0, 1)).alias("fee"), F.count(F.when(total_in <= 0, 1)).alias("tin"),
        F.count(F.when(total_out <= 0, 1)).alias("tout"), F.count(F.when(F.col("input_count") < 1, 1)).alias("nin"),
        F.count(F.when(F.col("output_count") < 1, 1)).alias("nout"),
        F.count(F.when(total_in != total_out + fee, 1)).alias("cons"))
    return _rules(agg, [
        ("tx_id_format", "error", "hex"), ("tx_negative_fee", "error", "fee"),
        ("tx_non_positive_input_total", "error", "tin"), ("tx_non_positive_output_total", "error", "tout"),
        ("tx_input_count_below_one", "error", "nin"), ("tx_output_count_below_one", "error", "nout"),
        ("tx_header_conservation", "error", "cons")])


def child_value_rules(df: DataFrame, name: str, dust: bool = False) -> DataFrame:
    """Non-positive amounts, and dust for outputs when asked for."""
    v = F.col("amount_satoshi")
    agg = df.agg(F.count(F.lit(1)).alias("checked"), F.count(F.when(v <= 0, 1)).alias("v"),
                 F.count(F.when((v > 0) & (v < DUST_BELOW), 1)).alias("d"))
    rules = [(f"{name}_non_positive_value", "error", "v")]
    return _rules(agg, rules + ([(f"{name}_dust", "warning", "d")] if dust else []))


def network_rules(net: DataFrame) -> DataFrame:
    """Address, port, country and ASN formats in one pass."""
    port = lambda c: F.count(F.when(~F.coalesce(F.col(c).between(1, 65535), F.lit(False)), 1))
    asn = F.col("asn").cast("string").try_cast("double")
    agg = net.agg(
        F.count(F.lit(1)).alias("checked"), _bad(F.col("src_ip").rlike(X.IPV4)).alias("src"),
        _bad(F.col("dst_ip").rlike(X.IPV4)).alias("dst"), port("src_port").alias("sp"), port("dst_port").alias("dp"),
        _bad(F.length("country") == 2).alias("cc"),
        F.count(F.when(F.col("asn").isNotNull() & ~F.coalesce(asn > 0, F.lit(False)), 1)).alias("asn_bad"))
    return _rules(agg, [
        ("net_src_ip_format", "error", "src"), ("net_dst_ip_format", "error", "dst"),
        ("net_src_port_range", "error", "sp"), ("net_dst_port_range", "error", "dp"),
        ("net_country_length", "error", "cc"), ("net_asn_positive", "error", "asn_bad")])


def conservation_by_children(tx: DataFrame, children: DataFrame, total: str, rule_id: str) -> DataFrame:
    """Transactions whose header total differs from the sum of their child rows, or lacks either side."""
    sums = children.groupBy("txid").agg(F.sum("amount_satoshi").alias("_s"), F.lit(True).alias("_c"))
    both = tx.select("txid", F.col(total).alias("_t"), F.lit(True).alias("_h")).join(sums, "txid", "full_outer")
    wrong = F.col("_c").isNull() | F.col("_h").isNull() | ~F.coalesce(F.col("_t") == F.col("_s"), F.lit(False))
    agg = both.agg(F.count(F.when(wrong, 1)).alias("v"), F.count(F.lit(1)).alias("checked"))
    return _rules(agg, [(rule_id, "error", "v")])


def validation_report(raw: Mapping[str, DataFrame], dust: bool = False) -> DataFrame:
    """All relational rules as one table."""
    tx, ins, outs, net = (raw[n] for n in (
        "transactions", "transaction_inputs", "transaction_outputs", "network_events"))
    return _union([
        duplicate_keys(tx, ["txid"], "tx_duplicate_id"), transaction_rules(tx),
        duplicate_keys(ins, ["txid", "input_index"], "input_duplicate_key"), orphans(ins, tx, "input_orphan"),
        child_value_rules(ins, "input"),
        duplicate_keys(outs, ["txid", "output_index"], "output_duplicate_key"), orphans(outs, tx, "output_orphan"),
        child_value_rules(outs, "output", dust),
        duplicate_keys(net, ["event_id"], "net_duplicate_id"), orphans(net, tx, "net_orphan"), network_rules(net),
        conservation_by_children(tx, ins, "total_input_value_satoshi", "conservation_inputs"),
        conservation_by_children(tx, outs, "total_output_value_satoshi", "conservation_outputs"),
    ])


def report_summary(report: DataFrame) -> DataFrame:
    """One row: rules run, rules broken, violations, and whether no error rule is broken."""
    broken = F.col("violations") > 0
    return report.agg(
        F.count(F.lit(1)).alias("n_rules"), F.count(F.when(broken, 1)).alias("n_broken"),
        F.sum("violations").alias("violations"),
        (F.count(F.when(broken & (F.col("severity") == "error"), 1)) == 0).alias("is_valid"))


class ValidationFailed(ValueError):
    """Raised when a table set breaks an error rule."""


def require_valid(report: DataFrame) -> None:
    """Stop a pipeline when any error rule is broken. The report has a fixed, small number of rows."""
    broken = report.where((F.col("severity") == "error") & (F.col("violations") > 0)).collect()
    if broken:
        raise ValidationFailed("; ".join(f"{r['rule_id']}: {r['violations']}" for r in broken))


def coverage(tx: DataFrame, events: DataFrame, labels: DataFrame) -> DataFrame:
    """Transactions without events or labels, rows without transaction, and several rows per transaction."""
    parts = []
    for name, df in (("event", events), ("label", labels)):
        per = df.groupBy("txid").agg(F.count(F.lit(1)).alias("n"))
        both = tx.select("txid", F.lit(True).alias("_t")).join(per, "txid", "full_outer")
        agg = both.agg(
            F.count(F.when(F.col("_t") & F.col("n").isNull(), 1)).alias("missing"),
            F.count(F.when(F.col("_t").isNull(), 1)).alias("stray"), F.count(F.when(F.col("n") > 1, 1)).alias("many"),
            F.count(F.lit(1)).alias("checked"))
        parts.append(_rules(agg, [(f"tx_without_{name}", "warning", "missing"), (f"{name}_without_tx", "error", "stray"),
                                  (f"tx_with_several_{name}s", "warning", "many")]))
    return _union(parts)


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def timestamp_rule(df: DataFrame, column: str = "timestamp") -> DataFrame:
    parsed = F.col(column).cast("string").try_cast("timestamp")
    agg = df.agg(F.count(F.when(parsed.isNull(), 1)).alias("v"), F.count(F.lit(1)).alias("checked"))
    return _rules(agg, [("timestamp_parses", "error", "v")])


def label_rules(labels: DataFrame) -> DataFrame:
    """Both classes occur, and benign classes are labelled 0."""
    one = F.col("ground_truth_label")
    agg = labels.agg(
        (F.when(F.count(F.when(one == 0, 1)) == 0, 1).otherwise(0)
         + F.when(F.count(F.when(one == 1, 1)) == 0, 1).otherwise(0)).alias("absent"),
        F.count(F.when(F.col("behavior_type").isin(schemas.BENIGN_CLASSES) & (one != 0), 1)).alias("benign"),
        F.count(F.lit(1)).alias("checked"))
    return _rules(agg, [("both_classes_present", "error", "absent"), ("benign_labelled_zero", "error", "benign")])


def graph_rule(labels: DataFrame, at_least: int = 10) -> DataFrame:
    """The largest weak component has a minimum size."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    agg = sizes.agg((F.coalesce(F.max("n"), F.lit(0)) < at_least).cast("int").alias("v"), F.sum("n").alias("checked"))
    return _rules(agg, [("graph_not_trivial", "error", "v")])


def feature_audit(matrix: DataFrame, columns: Sequence[str], forbidden: Sequence[str] = tuple(
        schemas.QUARANTINED_COLUMNS)) -> DataFrame:
    """Per feature: null and infinite values and whether it is constant; forbidden columns raise.

    One pass over the wide table; only the one-row result is turned into rows.
    """
    leaked = [c for c in matrix.columns if c in forbidden]
    if leaked:
        raise ValueError(f"forbidden columns in feature matrix: {', '.join(leaked)}")
    aggs = []
    for c in columns:
        d = F.col(c).cast("double")
        aggs.append(F.struct(
            F.lit(c).alias("feature"), F.count(F.when(d.isNull() | F.isnan(d), 1)).alias("null_count"),
            F.count(F.when(F.abs(d) == float("inf"), 1)).alias("inf_count"),
            F.coalesce(F.stddev_samp(d) < 1e-8, F.lit(False)).alias("is_constant")).alias(f"s_{c}"))
    return matrix.agg(*aggs).select(F.inline(F.array(*[f"s_{c}" for c in columns])))


def matrix_integrity(df: DataFrame, source: DataFrame, key: str = "transaction_id") -> DataFrame:
    """A modelling join must keep every source row once."""
    agg = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(
        source.select(key, F.lit(True).alias("s")).distinct(), key, "full_outer").agg(
        F.count(F.when(F.col("n").isNull(), 1)).alias("lost"), F.count(F.when(F.col("n") > 1, 1)).alias("twice"),
        F.count(F.lit(1)).alias("checked"))
    return _rules(agg, [("join_lost_rows", "error", "lost"), ("join_repeated_rows", "error", "twice")])


def split_audit(split: DataFrame) -> DataFrame:
    """Per split: rows, share, time range, positive share, number of classes."""
    per_class = split.groupBy("temporal_split", "behavior_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ground_truth_label").alias("p"),
        F.min("timestamp_epoch_sec").alias("a"), F.max("timestamp_epoch_sec").alias("z"))
    per = per_class.groupBy("temporal_split").agg(
        F.sum("n").alias("records"), F.min("a").alias("min_epoch"), F.max("z").alias("max_epoch"),
        (F.sum("p") / F.sum("n") * 100).alias("positive_pct"), F.count("behavior_type").alias("n_classes"))
    from pyspark.sql import Window
    share = F.col("records") / F.sum("records").over(Window.partitionBy()) * 100
    return per.select("temporal_split", "records", share.alias("share_pct"), "min_epoch", "max_epoch", "positive_pct",
                      "n_classes")


def order_rule(split: DataFrame) -> DataFrame:
    """Later splits never start before earlier ones end: max epoch of a split <= min epoch of the next."""
    e = F.col("timestamp_epoch_sec")
    at = lambda s, f: f(F.when(F.col("temporal_split") == s, e))
    agg = split.agg(
        F.count(F.lit(1)).alias("checked"),
        ((at("train", F.max) > at("val", F.min)).cast("int") + (at("val", F.max) > at("test", F.min)).cast("int")).alias("v"))
    return _rules(agg, [("split_order", "error", "v")])


def result_rules(results: DataFrame) -> DataFrame:
    """Contract of scored rows before they may be written."""
    filled = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    unit = lambda c: F.coalesce(F.col(c).between(0, 1) & ~F.isnan(c), F.lit(False))
    agg = results.agg(
        F.count(F.lit(1)).alias("checked"), F.count(F.when(~filled("entity_id"), 1)).alias("id"),
        F.count(F.when(~F.col("entity_type").isin("transaction", "address", "cluster") | F.col("entity_type").isNull(), 1)
                ).alias("kind"),
        F.count(F.when(~unit("risk_score"), 1)).alias("score"),
        F.count(F.when(F.col("confidence").isNotNull() & ~unit("confidence"), 1)).alias("conf"),
        F.count(F.when(~F.coalesce(F.col("risk_level").isin("low", "medium", "high", "critical"), F.lit(False)), 1)).alias("lvl"))
    return _rules(agg, [
        ("result_entity_id", "error", "id"), ("result_entity_type", "error", "kind"),
        ("result_risk_score", "error", "score"), ("result_confidence", "error", "conf"),
        ("result_risk_level", "error", "lvl")])
