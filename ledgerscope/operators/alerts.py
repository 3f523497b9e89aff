"""Rule-based alerts: signals, classification, grouping, listing, lifecycle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import schemas
from ledgerscope.functions import exprs as X
from ledgerscope.sources.sinks import replace_by_key

TX = "transaction_id"

# Alert life cycle and the features kept as evidence.
ACTIVE_STATUSES = ["NEW", "ACKNOWLEDGED", "INVESTIGATING", "ESCALATED"]
INACTIVE_STATUSES = ["RESOLVED", "DISMISSED"]
PRIORITIES = ["P1", "P2", "P3", "P4"]
EVIDENCE_FEATURES = [
    "time_txs_last_1m", "time_txs_last_5m", "time_txs_last_1h", "hist_cluster_size", "hist_cluster_tx_count",
    "hist_component_size", "hist_address_reuse_ratio", "rel_fan_in", "rel_fan_out", "net_src_port", "net_dst_port",
    "net_is_standard_bitcoin_port", "net_country", "net_asn", "tx_total_output_sats", "tx_fee_sats",
]
ALERT_SORTS = {
    "createdAt": "created_at", "updatedAt": "updated_at", "riskScore": "risk_score", "severity": "severity",
    "priority": "priority", "status": "status",
}


def features_map(snapshot: Column | str) -> Column:
    """A list of ``{feature_name, raw_value}`` to a map."""
    return F.map_from_entries(F.transform(X.as_col(snapshot), lambda f: F.struct(f["feature_name"], f["raw_value"])))


def feature_snapshot(df: DataFrame, names: Sequence[str], imputed: Sequence[str] = ()) -> Column:
    """All feature values of a row as a list, marking imputed ones."""
    return F.array(*[F.struct(
        F.lit(n).alias("feature_name"), F.col(n).cast("string").alias("raw_value"),
        F.lit(n in imputed).alias("is_imputed"),
        F.lit("derived_from_inputs_outputs" if n in imputed else None).cast("string").alias("imputation_method"))
        for n in names if n in df.columns])


def _num(name: str, default: float = 0) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def signals(rows: DataFrame, source_port_signal: bool = True) -> DataFrame:
    """Add ``signals``, an array of ``(category, reason)``, to scored rows joined with their features.

    ``source_port_signal`` keeps the rule that any source port other than 8333 counts as unusual.
    """
    risk, label = F.col("risk_score"), F.coalesce("prediction_label", F.lit("normal"))
    t1, t5 = _num("time_txs_last_1m"), _num("time_txs_last_5m")
    comp, fin, fout = _num("hist_component_size"), _num("rel_fan_in"), _num("rel_fan_out")
    reuse = _num("hist_address_reuse_ratio", 0.0)
    size, txs = _num("hist_cluster_size", 1), _num("hist_cluster_tx_count", 1)
    # an absent or zero size reads as one
    size, txs = F.when(size == 0, 1).otherwise(size), F.when(txs == 0, 1).otherwise(txs)
    src, dst = F.col("net_src_port"), F.col("net_dst_port")
    unusual = (F.coalesce(F.col("net_is_standard_bitcoin_port") == 0, F.lit(False))
               | F.coalesce(dst != 8333, F.lit(False)))
    if source_port_signal:
        unusual = unusual | F.coalesce(src != 8333, F.lit(False))
    show = lambda c: F.coalesce(c.cast("string"), F.lit("None"))

    def signal(when: Column, category: str, reason: Column) -> Column:
        return F.when(when, F.struct(F.lit(category).alias("category"), reason.alias("reason")))

    found = F.array_compact(F.array(
        signal(risk >= X.HIGH_AT, "ml_xgboost", F.format_string(
            "XGBoost risk score is %.3f (severity: %s)", risk, F.col("risk_level"))),
        signal(label.isin(schemas.SUSPICIOUS_TYPOLOGIES) & (_num("confidence", 0.0) >= 0.55), "catboost_typology",
               F.format_string("Classified as suspicious typology '%s' (confidence: %.1f%%)", label,
                               _num("confidence", 0.0) * 100)),
        signal((t1 >= 5) | (t5 >= 12) | (label == "transaction_burst"), "temporal_engine",
               F.format_string("High temporal transaction velocity (%d tx/1m, %d tx/5m)", t1.cast("bigint"), t5.cast("bigint"))),
        signal((comp >= 15) | (fin >= 8) | (fout >= 8) | (reuse >= 0.75) | label.isin("high_fan_in", "high_fan_out"),
               "graph_topology", F.format_string(
                   "Graph metric anomaly (fan_in=%d, fan_out=%d, comp_size=%d, reuse=%.2f)", fin.cast("bigint"),
                   fout.cast("bigint"), comp.cast("bigint"), reuse)),
        signal(unusual, "network_telemetry", F.concat(
            F.lit("Broadcast via non-standard peer port (src: "), show(src), F.lit(", dst: "), show(dst), F.lit(")"))),
        signal((size >= 5) | (txs >= 8), "entity_cluster", F.format_string(
            "Belongs to a multi-address cluster (%d addresses, %d transactions)", size.cast("bigint"), txs.cast("bigint"))),
    ))
    return rows.withColumn("prediction_label", label).withColumn("signals", found)


def classify(rows: DataFrame) -> DataFrame:
    """Alert type, source, severity, priority, reason and grouping key for rows with at least one signal."""
    rows = rows.where(F.size("signals") > 0).withColumn("categories", F.array_sort(F.transform("signals", lambda s: s["category"])))
    risk, n = F.col("risk_score"), F.size("categories")
    only = lambda c: (n == 1) & (F.col("categories")[0] == c)
    multi = n >= 2
    critical = risk >= X.CRITICAL_AT
    ladder = [
        # condition, type, source, severity, priority
        (multi, "MULTI_SIGNAL", "composite", F.when(critical, "critical").otherwise("high"), F.lit("P1")),
        (only("entity_cluster"), "ENTITY_CLUSTER_ACTIVITY", "graph_topology", F.lit("high"), F.lit("P2")),
        (only("catboost_typology"), "BEHAVIOR_ANOMALY", "catboost_typology", F.lit("high"), F.lit("P2")),
        (only("ml_xgboost"), "HIGH_RISK_TRANSACTION", "ml_xgboost", F.when(critical, "critical").otherwise("high"),
         F.when(risk >= 0.85, "P1").otherwise("P2")),
        (only("temporal_engine"), "TEMPORAL_BURST", "temporal_engine", F.when(risk >= X.HIGH_AT, "high").otherwise("medium"),
         F.when(risk >= X.HIGH_AT, "P2").otherwise("P3")),
        (only("graph_topology"), "GRAPH_ANOMALY", "graph_topology", F.lit("medium"), F.lit("P3")),
        (F.lit(True), "NETWORK_ANOMALY", "network_telemetry", F.lit("medium"), F.lit("P3")),
    ]

    def pick(position: int) -> Column:
        out = None
        for step in ladder:
            value = step[position] if isinstance(step[position], Column) else F.lit(step[position])
            out = F.when(step[0], value) if out is None else out.when(step[0], value)
        return out

    reason = F.when(multi, F.concat(
        F.lit("Compound alert: "), n.cast("string"), F.lit(" independent signals ("), F.array_join("categories", ", "),
        F.lit(") fired on transaction"))).otherwise(F.col("signals")[0]["reason"])
    typed = rows.select("*", pick(1).alias("alert_type"), pick(2).alias("trigger_source"), pick(3).alias("severity"),
                        pick(4).alias("priority"), reason.alias("trigger_reason"))
    bucket = (F.floor(F.unix_timestamp("timestamp") / 300) * 300).cast("string")
    cluster = F.col("hist_cluster_id") if "hist_cluster_id" in rows.columns else F.lit(None).cast("string")
    country = F.coalesce(F.when(F.col("net_country") != "", F.col("net_country")), F.lit("UNKNOWN"))
    asn = F.coalesce(F.when(F.col("net_asn") != 0, F.col("net_asn")).cast("string"), F.lit("UNKNOWN"))
    key = (F.when((_num("hist_cluster_size", 1) >= 3) & cluster.isNotNull(), cluster)
           .when(F.col("alert_type") == "TEMPORAL_BURST", F.concat_ws(":", F.lit("burst"), bucket, "prediction_label"))
           .when(F.col("alert_type") == "NETWORK_ANOMALY", F.concat_ws(":", F.lit("net"), country, asn))
           .otherwise(F.concat(F.lit("tx:"), F.col(TX))))
    return typed.withColumn("grouping_key", key)


def group_state(candidates: DataFrame) -> DataFrame:
    """What one lot of candidates contributes to each (type, grouping key): riskiest member, count, times, signals.

    Everything here is a combinable aggregate, so states of several lots merge; the member list lives in
    ``alert_members`` as rows, so a key holding a third of all transactions never becomes one array.
    """
    evidence = [c for c in EVIDENCE_FEATURES if c in candidates.columns]
    anchor = F.struct("risk_score", TX, "prediction_label", "severity", "priority", "trigger_source", "trigger_reason", *evidence)
    exploded = candidates.select("*", *[F.array_contains("categories", c).cast("int").alias(f"_c_{c}") for c in CATEGORIES])
    return exploded.groupBy("alert_type", "grouping_key").agg(
        F.max_by(anchor, F.struct("risk_score", F.col(TX))).alias("a"), F.count(F.lit(1)).alias("transaction_count"),
        F.min("timestamp").alias("first_seen_at"), F.max("timestamp").alias("last_seen_at"),
        *[F.max(f"_c_{c}").alias(f"_c_{c}") for c in CATEGORIES])


def merge_states(states: DataFrame) -> DataFrame:
    """One state per group out of the states of several lots."""
    return states.groupBy("alert_type", "grouping_key").agg(
        F.max_by("a", F.struct("a.risk_score", f"a.{TX}")).alias("a"), F.sum("transaction_count").alias("transaction_count"),
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
        *[F.max(f"_c_{c}").alias(f"_c_{c}") for c in CATEGORIES])


def describe(g: DataFrame, analysis_id: str, dataset_id: str) -> DataFrame:
    """The alert of each group state, described by its riskiest member."""
    evidence = [c for c in EVIDENCE_FEATURES if c in g.schema["a"].dataType.names]
    several = F.col("transaction_count") > 1
    critical = F.col("a.risk_score") >= X.CRITICAL_AT
    print_ = F.substring(F.sha2(F.concat_ws(":", F.lit(analysis_id), "alert_type", "grouping_key"), 256), 1, 32)
    fired = F.array_compact(F.array(*[F.when(F.col(f"_c_{c}") == 1, F.lit(c)) for c in CATEGORIES]))
    return g.select(
        F.concat(F.lit("alt-"), F.substring(print_, 1, 16)).alias("alert_id"), F.lit(analysis_id).alias("analysis_id"),
        F.lit(dataset_id).alias("dataset_id"), print_.alias("fingerprint"), "grouping_key",
        F.col(f"a.{TX}").alias(TX),
        F.when(several, F.concat(F.lit("cluster:"), "grouping_key")).otherwise(F.col(f"a.{TX}")).alias("entity_id"),
        F.when(several, "cluster").otherwise("transaction").alias("entity_type"), "alert_type",
        F.when(critical, "critical").otherwise(F.col("a.severity")).alias("severity"),
        F.when(critical | (F.col("a.severity") == "critical"), "P1").otherwise(F.col("a.priority")).alias("priority"),
        F.col("a.risk_score").alias("risk_score"), F.col("a.prediction_label").alias("behavior_type"),
        F.col("a.trigger_source").alias("trigger_source"),
        F.concat(F.col("a.trigger_reason"), F.when(several, F.concat(
            F.lit(" (aggregating "), F.col("transaction_count").cast("string"), F.lit(" transactions)"))).otherwise("")
        ).alias("trigger_reason"),
        F.lit("NEW").alias("status"), "first_seen_at", "last_seen_at", "transaction_count",
        F.struct(fired.alias("triggering_signals"), F.struct(*[F.col(f"a.{c}").alias(c) for c in evidence])
                 .alias("source_features")).alias("metadata"))


def group(candidates: DataFrame, analysis_id: str, dataset_id: str) -> DataFrame:
    """One alert per (type, grouping key)."""
    return describe(group_state(candidates), analysis_id, dataset_id)


# Signal categories in alphabetical order.
CATEGORIES = ["catboost_typology", "entity_cluster", "graph_topology", "ml_xgboost", "network_telemetry", "temporal_engine"]


def alert_members(candidates: DataFrame, alerts: DataFrame) -> DataFrame:
    """Which transactions each alert stands for."""
    return candidates.select("alert_type", "grouping_key", F.col(TX).alias("member_id"), F.col("risk_score").alias("member_risk")
                             ).join(alerts.select("alert_id", "alert_type", "grouping_key"), ["alert_type", "grouping_key"]
                                    ).select("alert_id", F.col("member_id").alias(TX), F.col("member_risk").alias("risk_score"))


def scored_rows(results: DataFrame, features: DataFrame, transactions: DataFrame, analysis_id: str) -> DataFrame:
    """Scored rows of one run with features and time."""
    scored = results.where((F.col("analysis_id") == analysis_id) & (F.col("entity_type") == "transaction")).select(
        F.col("entity_id").alias(TX), "risk_score", "risk_level", "prediction_label", "confidence", "predicted_at")
    rows = scored.join(features, TX, "left").join(transactions.select(TX, "timestamp"), TX, "left")
    return rows.withColumn("timestamp", F.coalesce("timestamp", "predicted_at"))


def candidate_rows(results: DataFrame, features: DataFrame, transactions: DataFrame, analysis_id: str,
                   source_port_signal: bool = True) -> DataFrame:
    """Scored rows of one run with features and time, signals attached and classified."""
    return classify(signals(scored_rows(results, features, transactions, analysis_id), source_port_signal))


def generate(results: DataFrame, features: DataFrame, transactions: DataFrame, analysis_id: str, dataset_id: str,
             source_port_signal: bool = True) -> DataFrame:
    """Alerts of one run. A second call gives the same rows."""
    return group(candidate_rows(results, features, transactions, analysis_id, source_port_signal), analysis_id, dataset_id)


def save(old: DataFrame, new: DataFrame) -> DataFrame:
    """Alert table after a run: same (analysis, fingerprint) replaced, the rest kept."""
    return replace_by_key(old, new, ["analysis_id", "fingerprint"])


def delete_run(alerts: DataFrame, analysis_id: str) -> DataFrame:
    return alerts.where(~F.col("analysis_id").eqNullSafe(analysis_id))


def severity_rank(c: Column | str = "severity") -> Column:
    s = F.lower(X.as_col(c))
    return F.when(s == "critical", 4).when(s == "high", 3).when(s == "medium", 2).when(s == "low", 1).otherwise(0)


def priority_rank(c: Column | str = "priority") -> Column:
    s = F.upper(X.as_col(c))
    return F.when(s == "P1", 4).when(s == "P2", 3).when(s == "P3", 2).when(s == "P4", 1).otherwise(0)


def listing(alerts: DataFrame, status: str | None = None, severity: str | None = None, alert_type: str | None = None,
            priority: str | None = None, min_risk: float | None = None, search: str | None = None,
            entity_type: str | None = None) -> DataFrame:
    """Filtered alerts; ``status`` may be active, inactive, all or a comma list."""
    out = alerts
    if status and status.lower() == "active":
        out = out.where(F.col("status").isin(ACTIVE_STATUSES))
    elif status and status.lower() == "inactive":
        out = out.where(F.col("status").isin(INACTIVE_STATUSES))
    elif status and status.lower() != "all":
        out = out.where(F.col("status").isin([s.strip().upper() for s in status.split(",") if s.strip()]))
    for name, value in (("severity", severity and severity.lower()), ("alert_type", alert_type and alert_type.upper()),
                        ("priority", priority and priority.upper()), ("entity_type", entity_type)):
        if value and value.lower() != "all":
            out = out.where(F.col(name) == value)
    if min_risk is not None:
        out = out.where(F.col("risk_score") >= min_risk)
    if search:
        hit = F.lit(False)
        for c in ("alert_id", "entity_id", TX, "trigger_reason", "behavior_type"):
            hit = hit | F.coalesce(F.col(c).contains(search.strip()), F.lit(False))
        out = out.where(hit)
    return out


def sorted_alerts(alerts: DataFrame, by: str = "riskScore", descending: bool = True) -> DataFrame:
    if by not in ALERT_SORTS:
        raise ValueError(f"sort must be one of {sorted(ALERT_SORTS)}")
    column = {"severity": severity_rank(), "priority": priority_rank()}.get(by, F.col(ALERT_SORTS[by]))
    return alerts.orderBy(column.desc() if descending else column.asc(), "alert_id")


def queue(alerts: DataFrame, entity_type: str | None = None, min_risk: float | None = None, text: str | None = None,
          by_time: bool = False) -> DataFrame:
    """The analyst queue: text over id, entity and reason, by risk or by time."""
    out = alerts
    if entity_type:
        out = out.where(F.col("entity_type") == entity_type)
    if min_risk is not None:
        out = out.where(F.col("risk_score") >= min_risk)
    if text:
        needle = text.lower()
        out = out.where(F.lower(F.concat_ws("\n", "alert_id", "entity_id", "trigger_reason")).contains(needle))
    first = F.desc_nulls_last("last_seen_at") if by_time else F.desc_nulls_last("risk_score")
    return out.orderBy(first, "alert_id")


def summary(alerts: DataFrame) -> DataFrame:
    """``(dimension, value, n)``: total, active, by severity, status and type; one pass, one shuffle of few rows."""
    per = alerts.groupBy("severity", "status", "alert_type").agg(F.count(F.lit(1)).alias("n"))
    active = F.col("status").isin(ACTIVE_STATUSES)
    facts = per.select("n", F.explode(F.array_compact(F.array(
        F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")),
        F.when(active, F.struct(F.lit("active").alias("dimension"), F.lit("all").alias("value"))),
        F.struct(F.lit("severity").alias("dimension"), F.col("severity").alias("value")),
        F.struct(F.lit("status").alias("dimension"), F.col("status").alias("value")),
        F.struct(F.lit("type").alias("dimension"), F.col("alert_type").alias("value"))))).alias("f"))
    return facts.groupBy("f.dimension", "f.value").agg(F.sum("n").alias("n"))


def apply_updates(alerts: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply ``updates(alert_id, new_status, new_priority, at)``; NULL leaves a field alone.

    The first step from NEW to work in progress acknowledges, closing sets the resolution time and
    reopening clears it. Invalid values are ignored.
    """
    u = updates.select("alert_id", F.upper(F.trim("new_status")).alias("_s"), F.upper(F.trim("new_priority")).alias("_p"),
                       F.col("at").alias("_at"))
    u = u.withColumn("_s", F.when(F.col("_s").isin(ACTIVE_STATUSES + INACTIVE_STATUSES), F.col("_s")))
    u = u.withColumn("_p", F.when(F.col("_p").isin(PRIORITIES), F.col("_p")))
    have = {c: (F.col(c) if c in alerts.columns else F.lit(None).cast("timestamp"))
            for c in ("acknowledged_at", "resolved_at", "updated_at")}
    rest = [c for c in alerts.columns if c not in (*have, "status", "priority")]
    s, was = F.col("_s"), F.col("status")
    return alerts.join(u, "alert_id", "left").select(
        *rest, F.coalesce(s, was).alias("status"), F.coalesce("_p", "priority").alias("priority"),
        F.when((was == "NEW") & s.isin("ACKNOWLEDGED", "INVESTIGATING", "ESCALATED"),
               F.coalesce(have["acknowledged_at"], "_at")).otherwise(have["acknowledged_at"]).alias("acknowledged_at"),
        F.when(s.isin(INACTIVE_STATUSES), F.col("_at"))
        .when(was.isin(INACTIVE_STATUSES) & s.isin(ACTIVE_STATUSES), F.lit(None).cast("timestamp"))
        .otherwise(have["resolved_at"]).alias("resolved_at"),
        F.when(s.isNotNull() | F.col("_p").isNotNull(), F.col("_at")).otherwise(have["updated_at"]).alias("updated_at"))


def matches(alerts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Per dataset, alerts whose transaction or entity is a known transaction: two equi joins, not one OR join."""
    known = transactions.select("dataset_id", F.col(TX).alias("id"))
    ids = alerts.select("dataset_id", "alert_id", F.explode(F.array_distinct(F.array(TX, "entity_id"))).alias("id"))
    hit = ids.join(known, ["dataset_id", "id"]).groupBy("dataset_id", "alert_id").agg(F.count(F.lit(1)).alias("m"))
    totals = alerts.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("alerts"))
    return totals.join(hit.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("matched_alerts"), F.sum("m").alias("matches")),
                       "dataset_id", "left").select(
        "dataset_id", "alerts", F.coalesce("matched_alerts", F.lit(0)).alias("matched_alerts"),
        F.coalesce("matches", F.lit(0)).alias("matches"))


def latest_per_entity(alerts: DataFrame) -> DataFrame:
    """The most recent alert of each entity and how many it has."""
    return alerts.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n_alerts"), F.max_by("alert_id", F.struct("last_seen_at", "alert_id")).alias("latest_alert"),
        F.max("last_seen_at").alias("latest_at"), F.max("risk_score").alias("max_risk"))
