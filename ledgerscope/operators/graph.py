"""Address/transaction graph: nodes, edges, degrees, history features, clusters, metrics, neighbourhoods."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions import exprs as X
from ledgerscope.functions.ordering import exact_percentiles, global_positions, unpivot
from ledgerscope.operators import chronology, components
from ledgerscope.operators.features import address_appearances
from ledgerscope.session import pin

TX, TS = "transaction_id", "timestamp_epoch_sec"


# ---- nodes, edges, degrees ---------------------------------------------------------------------

def transaction_nodes(transactions: DataFrame) -> DataFrame:
    return transactions.select(
        F.concat(F.lit("tx_"), TX).alias("node_id"), F.lit("transaction").alias("node_type"),
        F.col(TX).alias("identifier"), TS, "fee_satoshi", "total_output_value_satoshi", "input_count", "output_count")


def edges(transactions: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """``INPUT_TO`` (address to transaction) and ``OUTPUT_TO`` (transaction to address) edge rows."""
    ins = inputs.where(X.usable_address("input_address")).select(
        TX, F.trim("input_address").alias("a"), F.col("input_value_satoshi").alias("amount_satoshi"),
        F.col("input_index").alias("index"), F.lit(False).alias("is_change"), F.lit("INPUT_TO").alias("edge_type"))
    outs = outputs.where(X.usable_address("output_address")).select(
        TX, F.trim("output_address").alias("a"), F.col("output_value_satoshi").alias("amount_satoshi"),
        F.col("output_index").alias("index"), F.coalesce("is_change", F.lit(False)).alias("is_change"),
        F.lit("OUTPUT_TO").alias("edge_type"))
    rows = ins.unionByName(outs).join(transactions.select(TX, TS), TX)
    tx_node, addr_node = F.concat(F.lit("tx_"), TX), F.concat(F.lit("addr_"), "a")
    spends = F.col("edge_type") == "INPUT_TO"
    return rows.select(
        F.concat_ws("_", F.when(spends, "in").otherwise("out"), TX, F.col("index").cast("string")).alias("edge_id"),
        F.when(spends, addr_node).otherwise(tx_node).alias("source"),
        F.when(spends, tx_node).otherwise(addr_node).alias("target"), "edge_type", "amount_satoshi", "index",
        "is_change", TS)


def address_nodes(edge_rows: DataFrame) -> DataFrame:
    """Address nodes with first and last time seen."""
    end = F.when(F.col("edge_type") == "INPUT_TO", F.col("source")).otherwise(F.col("target"))
    return edge_rows.groupBy(end.alias("node_id")).agg(F.min(TS).alias("first_seen"), F.max(TS).alias("last_seen")).select(
        "node_id", F.lit("address").alias("node_type"), F.expr("substring(node_id, 6)").alias("identifier"),
        "first_seen", "last_seen")


def node_table(transactions: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """All nodes with in, out and total degree on the digraph without parallel edges."""
    nodes = transaction_nodes(transactions).select("node_id", "node_type", "identifier", TS).unionByName(
        address_nodes(edge_rows).select("node_id", "node_type", "identifier", F.col("first_seen").alias(TS)))
    return nodes.join(degrees(edge_rows), "node_id", "left").select(
        "node_id", "node_type", "identifier", TS,
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("in_degree", "out_degree", "total_degree")])


def degrees(edge_rows: DataFrame) -> DataFrame:
    pairs = edge_rows.select("source", "target").distinct()
    ends = pairs.select(F.explode(F.array(
        F.struct(F.col("source").alias("node_id"), F.lit(0).cast("bigint").alias("i"), F.lit(1).cast("bigint").alias("o")),
        F.struct(F.col("target").alias("node_id"), F.lit(1).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("o")),
    )).alias("e"))
    return ends.groupBy("e.node_id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree")).select(
        "node_id", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("total_degree"))


# ---- history features --------------------------------------------------------------------------

def neighbour_history(timeline: DataFrame) -> DataFrame:
    """Fan counts, mean earlier appearances of the addresses on each side, and the reuse ratio."""
    rows = timeline.where(X.usable_address("address") & (F.col("in_rows") + F.col("out_rows") > 0))
    is_in, is_out = F.col("in_rows") > 0, F.col("out_rows") > 0
    n = F.col("prior_rows")
    out = rows.groupBy(TX).agg(
        F.sum("in_rows").alias("graph_fan_in"), F.sum("out_rows").alias("graph_fan_out"),
        F.count(F.when(is_in, 1)).alias("graph_unique_in_addrs"),
        F.count(F.when(is_out, 1)).alias("graph_unique_out_addrs"),
        F.avg(F.when(is_in, n)).alias("_in"), F.avg(F.when(is_out, n)).alias("_out"),
        F.sum(F.when(n > 0, F.col("in_rows")).otherwise(0)).alias("_reused"))
    return out.select(
        TX, "graph_fan_in", "graph_fan_out", "graph_unique_in_addrs", "graph_unique_out_addrs",
        F.round(F.coalesce("_in", F.lit(0.0)), 4).alias("hist_in_mean_neighbor_degree"),
        F.round(F.coalesce("_out", F.lit(0.0)), 4).alias("hist_out_mean_neighbor_degree"),
        F.round(F.when(F.col("graph_fan_in") > 0, F.col("_reused") / F.col("graph_fan_in")).otherwise(0.0), 4)
        .alias("hist_address_reuse_ratio"))


def cluster_members(transactions: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Addresses each transaction puts into one entity: all inputs, and change outputs when it has inputs."""
    ins = inputs.where(X.usable_address("input_address")).groupBy(TX, F.trim("input_address").alias("node")).agg(
        F.min("input_index").alias("i"))
    lowest = ins.groupBy(TX).agg(F.min("i").alias("first"))
    ins = ins.join(lowest, TX).select(TX, "node", (F.col("i") == F.col("first")).alias("is_primary"))
    change = outputs.where(F.coalesce("is_change", F.lit(False)) & X.usable_address("output_address")).select(
        TX, F.trim("output_address").alias("node"), F.lit(False).alias("is_primary")).distinct()
    change = change.join(lowest.select(TX), TX, "left_semi")
    both = ins.unionByName(change).groupBy(TX, "node").agg(F.max("is_primary").alias("is_primary"))
    return both.join(transactions.select(TX, TS), TX).select(
        F.col(TS).alias("ts"), F.col(TX).alias("tx"), "node", "is_primary")


def cluster_history(transactions: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Entity of the primary sender just before each transaction: id, size, transactions so far."""
    past = chronology.component_history(cluster_members(transactions, inputs, outputs))
    return transactions.select(TX).join(past.withColumnRenamed("tx", TX), TX, "left").select(
        TX, F.coalesce(F.concat(F.lit("cluster_"), "prior_label"), F.lit("cluster_unknown")).alias("hist_cluster_id"),
        F.coalesce("prior_size", F.lit(0)).alias("hist_cluster_size"),
        F.coalesce("prior_txs", F.lit(0)).alias("hist_cluster_tx_count"))


def component_growth(transactions: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Nodes (addresses and transactions) in each transaction's weak component, itself included."""
    addresses = edges(transactions, inputs, outputs).select(
        F.col(TS).alias("ts"),
        F.when(F.col("edge_type") == "INPUT_TO", F.col("target")).otherwise(F.col("source")).alias("t"),
        F.when(F.col("edge_type") == "INPUT_TO", F.col("source")).otherwise(F.col("target")).alias("node")).distinct()
    members = addresses.select("ts", F.expr("substring(t, 4)").alias("tx"), "node", F.lit(False).alias("is_primary"))
    grown = chronology.component_history(members)
    return transactions.select(TX).join(grown.withColumnRenamed("tx", TX), TX, "left").select(
        TX, F.coalesce(F.col("size") + F.col("txs"), F.lit(1)).alias("hist_component_size"))


def graph_features(tables: Mapping[str, DataFrame], timeline: DataFrame) -> DataFrame:
    """All eleven graph features, one row per transaction."""
    tx, ins, outs = (tables[n] for n in ("transactions", "transaction_inputs", "transaction_outputs"))
    near = tx.select(TX).join(neighbour_history(timeline), TX, "left")
    counts = ["graph_fan_in", "graph_fan_out", "graph_unique_in_addrs", "graph_unique_out_addrs"]
    means = ["hist_in_mean_neighbor_degree", "hist_out_mean_neighbor_degree", "hist_address_reuse_ratio"]
    near = near.select(TX, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts],
                       *[F.coalesce(c, F.lit(0.0)).alias(c) for c in means])
    return near.join(component_growth(tx, ins, outs), TX).join(
        cluster_history(tx, ins, outs), TX)


def alert_history(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The graph features that alerts read, as in ``graph_features``, without the address timeline."""
    tx, ins, outs = (tables[n] for n in ("transactions", "transaction_inputs", "transaction_outputs"))
    reuse = neighbour_history(address_appearances(tx, ins, outs)).select(TX, "hist_address_reuse_ratio")
    near = tx.select(TX).join(reuse, TX, "left").select(TX, F.coalesce("hist_address_reuse_ratio", F.lit(0.0)).alias("hist_address_reuse_ratio"))
    return near.join(component_growth(tx, ins, outs), TX).join(cluster_history(tx, ins, outs), TX)


def final_clusters(transactions: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Every clustered address with its entity (smallest member address), entity size and transactions."""
    members = cluster_members(transactions, inputs, outputs)
    labels = components.component_labels(components.star_edges(members, "tx", "node"))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("cluster_size"))
    spending = members.where("is_primary").join(labels, "node").groupBy("component").agg(
        F.count(F.lit(1)).alias("cluster_tx_count"))
    return labels.join(sizes, "component").join(spending, "component", "left").select(
        F.col("node").alias("address"), F.col("component").alias("cluster_root"), "cluster_size",
        F.coalesce("cluster_tx_count", F.lit(0)).alias("cluster_tx_count"))


# ---- whole-graph metrics -----------------------------------------------------------------------

PERCENTILES = {"min": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "max": 1.0}


def numbered_links(transactions: DataFrame, inputs: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The digraph of ``edges`` without parallel edges on whole numbers, ``(u, v)``, and its nodes ``(node, node_id)``.

    Searches over the whole graph move every edge many times, and a number is a small part of a node's text. Numbers
    order nodes as the texts do. Both frames are written.
    """
    names = global_positions(node_names(transactions, inputs, outputs), ["node_id"], "node").select("node", "node_id")
    names = pin(names, "node-numbers")
    address = names.where(F.col("node_id").startswith("addr_")).select(F.expr("substring(node_id, 6)").alias("a"), F.col("node").alias("n"))
    tx = names.where(F.col("node_id").startswith("tx_")).select(F.expr("substring(node_id, 4)").alias(TX), F.col("node").alias("t"))

    def sides(rows: DataFrame, column: str) -> DataFrame:
        return rows.where(X.usable_address(column)).select(TX, F.trim(column).alias("a"))

    both = sides(inputs, "input_address").withColumn("spends", F.lit(True)).unionByName(sides(outputs, "output_address").withColumn("spends", F.lit(False)))
    ends = both.repartition(TX).distinct().join(tx, TX).select("a", "t", "spends").join(address, "a")
    u, v = (F.when(F.col("spends"), F.col(x)).otherwise(F.col(y)) for x, y in (("n", "t"), ("t", "n")))
    return pin(ends.select(u.alias("u"), v.alias("v")), "links"), names


def node_names(transactions: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """``node_id`` of all nodes that an edge touches."""
    touched = inputs.where(X.usable_address("input_address")).select(TX, F.trim("input_address").alias("a")).unionByName(
        outputs.where(X.usable_address("output_address")).select(TX, F.trim("output_address").alias("a")))
    touched = touched.join(transactions.select(TX), TX, "left_semi")
    return touched.select(F.concat(F.lit("addr_"), "a").alias("node_id")).distinct().unionByName(
        touched.select(F.concat(F.lit("tx_"), TX).alias("node_id")).distinct())


def degree_distributions(nodes: DataFrame) -> DataFrame:
    """Percentiles of five degree series."""
    n = nodes.select("node_type", "in_degree", "out_degree", "total_degree")
    is_tx = F.col("node_type") == "transaction"
    series = n.select(F.explode(F.array(
        F.struct(F.lit("total_degree").alias("s"), F.col("total_degree").alias("d")),
        F.struct(F.lit("in_degree").alias("s"), F.col("in_degree").alias("d")),
        F.struct(F.lit("out_degree").alias("s"), F.col("out_degree").alias("d")),
        F.struct(F.when(is_tx, "transaction_fan_in").otherwise("address_fan_out").alias("s"),
                 F.when(is_tx, F.col("in_degree")).otherwise(F.col("out_degree")).alias("d")),
    )).alias("x")).select(F.col("x.s").alias("series"), F.col("x.d").alias("degree"))
    return exact_percentiles(series, ["series"], "degree", PERCENTILES)


def weak_components(edge_rows: DataFrame) -> DataFrame:
    """Component of every node of the graph seen without directions."""
    return components.component_labels(edge_rows.select(F.col("source").alias("u"), F.col("target").alias("v")))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("component_size"))


def weak_component_sizes(transactions: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """``(component, component_size)`` of the graph of ``edges`` without its rows: a transaction is counted at its smallest address, not a node of the search."""
    at = inputs.select(TX, F.col("input_address").alias("a")).unionByName(outputs.select(TX, F.col("output_address").alias("a")))
    # dealt by transaction once, for the distinct addresses, the smallest and both joins
    at = at.where(X.usable_address("a")).select(TX, F.trim("a").alias("u")).repartition(TX).distinct().join(transactions.select(TX), TX, "left_semi")
    stars = pin(at.join(at.groupBy(TX).agg(F.min("u").alias("v")), TX).select("u", "v"), "stars")
    labels = components.component_labels(stars)
    counted = labels.groupBy("component").agg(F.count(F.lit(1)).alias("component_size")).unionByName(
        stars.where("u = v").groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("component_size"))
        .join(labels, "node").select("component", "component_size"))
    return counted.groupBy("component").agg(F.sum("component_size").alias("component_size"))


def component_summary(sizes: DataFrame, top: int = 5) -> DataFrame:
    """One row: number of components, size and share of the largest, the largest sizes as text."""
    totals = sizes.agg(F.count(F.lit(1)).alias("n_components"), F.max("component_size").alias("giant_size"),
                       F.sum("component_size").alias("n_nodes"))
    largest = sizes.orderBy(F.desc("component_size"), "component").limit(top).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("component_size"), asc=False),
                                 lambda x: x.cast("string")), ",").alias("top_sizes"))
    return totals.withColumn("_j", F.lit(1)).join(largest.withColumn("_j", F.lit(1)), "_j").select(
        "n_components", "giant_size", (F.col("giant_size") / F.col("n_nodes")).alias("giant_fraction"), "top_sizes")


def density(nodes: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Node and edge counts and the density of the digraph without parallel edges."""
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"),
                  F.count(F.when(F.col("node_type") == "transaction", 1)).alias("n_tx_nodes"),
                  F.count(F.when(F.col("node_type") == "address", 1)).alias("n_address_nodes"))
    m = edge_rows.groupBy("source", "target").agg(F.count(F.lit(1)).alias("c")).agg(
        F.count(F.lit(1)).alias("n_edges"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_edge_rows"))
    one = n.withColumn("_j", F.lit(1)).join(m.withColumn("_j", F.lit(1)), "_j").drop("_j")
    pairs = F.col("n_nodes").cast("double") * (F.col("n_nodes") - 1)
    return one.select("*", F.when(pairs > 0, F.col("n_edges") / pairs).otherwise(0.0).alias("density"))


def type_shares(nodes: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Count and share of every node type and edge type."""
    a = nodes.groupBy(F.lit("node").alias("kind"), F.col("node_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    b = edge_rows.groupBy(F.lit("edge").alias("kind"), F.col("edge_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("kind")))


def cluster_summary(clusters: DataFrame) -> DataFrame:
    """Number of entities, how many and what share hold several addresses, the largest entity."""
    per = clusters.groupBy("cluster_root").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_clusters"), F.count(F.when(F.col("n") > 1, 1)).alias("n_multi"),
                   F.max("n").alias("largest")).select("*", (F.col("n_multi") / F.col("n_clusters")).alias("multi_share"))


def top_clusters(clusters: DataFrame, top: int = 10) -> DataFrame:
    return clusters.select("cluster_root", "cluster_size", "cluster_tx_count").distinct().orderBy(
        F.desc("cluster_size"), "cluster_root").limit(top)


# ---- address-to-address projection -------------------------------------------------------------

def address_payments(inputs: DataFrame, outputs: DataFrame, focus: DataFrame, both_ends: bool = True) -> DataFrame:
    """Payments between addresses through a shared transaction, for the addresses in ``focus(address_id)``.

    Every input address is credited with the whole of each output address's total. ``both_ends`` keeps
    payments among focus addresses; otherwise one end suffices. Each side is reduced to one row per
    (transaction, address) and cut to the focus set before the two meet.
    """
    keep = focus.select("address_id").distinct()
    payers = inputs.where(F.col("input_address").isNotNull()).select(TX, F.col("input_address").alias("source")).distinct()
    paid = outputs.where(F.col("output_address").isNotNull()).groupBy(TX, F.col("output_address").alias("target")).agg(
        F.sum("output_value_satoshi").alias("value_satoshi"))
    near_payers = payers.join(keep.withColumnRenamed("address_id", "source"), "source", "left_semi")
    near_paid = paid.join(keep.withColumnRenamed("address_id", "target"), "target", "left_semi")
    if both_ends:
        found = near_payers.join(near_paid, TX)
    else:
        found = near_payers.join(paid, TX).unionByName(
            payers.join(keep.withColumnRenamed("address_id", "source"), "source", "left_anti").join(near_paid, TX))
    return found.where(F.col("source") != F.col("target")).select(TX, "source", "target", "value_satoshi")


def payment_edges(payments: DataFrame) -> DataFrame:
    """Directed totals per address pair."""
    return payments.groupBy("source", "target").agg(
        F.sum(F.coalesce("value_satoshi", F.lit(0))).alias("total_value_satoshi"),
        F.count(F.lit(1)).alias("transaction_count"), F.min(TX).alias("first_transaction"),
        F.max(TX).alias("last_transaction"))


def attributed_risk(addresses: DataFrame, inputs: DataFrame, outputs: DataFrame, results: DataFrame) -> DataFrame:
    """Risk of each address: its own result, else the highest over the transactions it takes part in."""
    touched = inputs.select(TX, F.col("input_address").alias("address_id")).unionByName(
        outputs.select(TX, F.col("output_address").alias("address_id"))).where(F.col("address_id").isNotNull())
    scored = results.select(F.col("entity_id").alias(TX), "risk_score", X.level_rank("risk_level").alias("rank"))
    via = touched.distinct().join(scored, TX).groupBy("address_id").agg(
        F.max("risk_score").alias("tx_risk"), F.max("rank").alias("tx_rank"))
    own = results.select(F.col("entity_id").alias("address_id"), F.col("risk_score").alias("own_risk"),
                         F.col("risk_level").alias("own_level"))
    return addresses.join(own, "address_id", "left").join(via, "address_id", "left").select(
        *addresses.columns, F.coalesce("own_risk", "tx_risk").alias("risk_score"),
        F.coalesce("own_level", X.level_from_rank("tx_rank")).alias("risk_level"))


def riskiest_nodes(risky: DataFrame, max_nodes: int, min_risk: float | None = None) -> DataFrame:
    """The nodes of an exported graph: highest risk first, ties by address."""
    df = risky if min_risk is None else risky.where(F.col("risk_score") >= min_risk)
    return df.orderBy(F.desc_nulls_last("risk_score"), "address_id").limit(max_nodes)


# ---- neighbourhoods ----------------------------------------------------------------------------

def address_neighbourhood(inputs: DataFrame, outputs: DataFrame, centre: str, hops: int = 2,
                          page: int | None = None) -> DataFrame:
    """Addresses within ``hops`` payments of ``centre`` in either direction, with their distance.

    The frontier is a frame; every hop is two semi joins per direction and an anti join with what was
    seen. ``page`` limits the display to the nearest nodes; the search itself is complete, for any number of hops.
    """
    if hops < 1:
        raise ValueError("hops must be positive")
    spark = inputs.sparkSession
    ins = inputs.where(F.col("input_address").isNotNull()).select(TX, F.col("input_address").alias("address"))
    outs = outputs.where(F.col("output_address").isNotNull()).select(TX, F.col("output_address").alias("address"))
    seen = spark.createDataFrame([(centre, 0)], "address string, hop int")
    frontier = seen
    for hop in range(1, hops + 1):
        at = frontier.select("address")
        forward = outs.join(ins.join(at, "address", "left_semi").select(TX), TX, "left_semi")
        backward = ins.join(outs.join(at, "address", "left_semi").select(TX), TX, "left_semi")
        reached = forward.select("address").union(backward.select("address")).distinct()
        frontier = reached.join(seen, "address", "left_anti").withColumn("hop", F.lit(hop))
        frontier = pin(frontier, "hop")
        seen = seen.unionByName(frontier)
    return seen if page is None else seen.orderBy("hop", "address").limit(page)


def node_details(visited: DataFrame, addresses: DataFrame, results: DataFrame) -> DataFrame:
    """Totals, activity and risk of the visited addresses."""
    latest = results.where(F.col("entity_type") == "address").groupBy("entity_id").agg(
        F.max_by(F.struct("risk_score", "risk_level"), F.struct("predicted_at", "result_id")).alias("r"))
    joined = visited.join(addresses.withColumnRenamed("address_id", "address"), "address", "left").join(
        latest.withColumnRenamed("entity_id", "address"), "address", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "address", "hop", X.short_label("address").alias("label"),
        F.coalesce("transaction_count", zero).alias("transaction_count"),
        X.btc_text(F.coalesce("total_received_satoshi", zero)).alias("total_received_btc"),
        X.btc_text(F.coalesce("total_sent_satoshi", zero)).alias("total_sent_btc"),
        "first_seen_timestamp", "last_seen_timestamp",
        X.active_days("first_seen_timestamp", "last_seen_timestamp").alias("active_days"),
        F.col("r.risk_score").alias("risk_score"), F.col("r.risk_level").alias("risk_level"))


def incidence(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Distinct (transaction, address) incidences."""
    return inputs.select(TX, F.col("input_address").alias("address")).union(
        outputs.select(TX, F.col("output_address").alias("address"))).where(F.col("address").isNotNull()).distinct()


def bipartite_neighbourhood(inputs: DataFrame, outputs: DataFrame, centre: str, kind: str, depth: int = 2) -> DataFrame:
    """Alternate transactions and addresses around a transaction or an address, for any number of steps."""
    if depth < 1:
        raise ValueError("depth must be positive")
    spark = inputs.sparkSession
    links = incidence(inputs, outputs)
    start = spark.createDataFrame([(kind, centre, 0)], "kind string, id string, step int")
    seen, frontier, at = start, start, kind
    for step in range(1, depth + 1):
        other = "address" if at == "transaction" else "transaction"
        here, there = (TX, "address") if at == "transaction" else ("address", TX)
        reached = links.join(frontier.select(F.col("id").alias(here)), here, "left_semi").select(
            F.col(there).alias("id")).distinct()
        known = seen.where(F.col("kind") == other).select("id")
        frontier = pin(reached.join(known, "id", "left_anti").select(
            F.lit(other).alias("kind"), "id", F.lit(step).alias("step")), "hop")
        seen, at = seen.unionByName(frontier), other
    return seen


def neighbourhood_edges(nodes: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Input and output edges inside a visited set, one row per (address, transaction, direction)."""
    txs = nodes.where(F.col("kind") == "transaction").select(F.col("id").alias(TX))
    addrs = nodes.where(F.col("kind") == "address").select(F.col("id").alias("address"))
    sides = []
    for df, side, name in ((inputs, "input", "INPUT_TO"), (outputs, "output", "OUTPUT_TO")):
        rows = df.select(TX, F.col(f"{side}_address").alias("address"), F.col(f"{side}_value_satoshi").alias("v"))
        rows = rows.join(txs, TX, "left_semi").join(addrs, "address", "left_semi")
        sides.append(rows.groupBy("address", TX).agg(F.sum("v").alias("value_satoshi"), F.count(F.lit(1)).alias("n_rows"))
                     .withColumn("edge_type", F.lit(name)))
    return sides[0].unionByName(sides[1])


def neighbourhood_roles(edge_rows: DataFrame) -> DataFrame:
    """Per address in a neighbourhood: neighbours, fan in, fan out, and whether it is reused."""
    return edge_rows.groupBy("address").agg(
        F.count_distinct(TX).alias("neighbor_count"),
        F.count(F.when(F.col("edge_type") == "OUTPUT_TO", 1)).alias("fan_in"),
        F.count(F.when(F.col("edge_type") == "INPUT_TO", 1)).alias("fan_out")).select(
        "*", (F.col("neighbor_count") > 1).alias("is_reused"))


def high_risk_part(nodes: DataFrame, edge_rows: DataFrame, results: DataFrame, centre: str) -> DataFrame:
    """The centre, risky transactions, and the nodes joined to a risky transaction."""
    risky = results.where((F.col("risk_score") >= X.HIGH_AT) | F.col("risk_level").isin("high", "critical")).select(
        F.col("entity_id").alias("id")).distinct()
    txs = nodes.where(F.col("kind") == "transaction").join(risky, "id", "left_semi")
    beside = edge_rows.join(txs.select(F.col("id").alias(TX)), TX, "left_semi").select(F.col("address").alias("id"))
    addrs = nodes.where(F.col("kind") == "address").join(beside.distinct(), "id", "left_semi")
    middle = nodes.where(F.col("id") == centre)
    return middle.unionByName(txs).unionByName(addrs).distinct()


def node_evidence(nodes: DataFrame, results: DataFrame, events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Evidence rows of a neighbourhood's nodes: results, network events of its transactions, alerts."""
    ids = nodes.select("kind", "id")
    ml = results.select(F.col("entity_id").alias("id"), F.lit("ml").alias("evidence"), F.col("prediction_label").alias("ref"), "risk_score")
    net = events.select(F.col(TX).alias("id"), F.lit("network").alias("evidence"), F.col("event_id").alias("ref"),
                        F.lit(None).cast("double").alias("risk_score"))
    raised = alerts.select(F.explode(F.array_distinct(F.array(TX, "entity_id"))).alias("id"), F.lit("alert").alias("evidence"),
                           F.col("alert_id").alias("ref"), "risk_score")
    return ids.join(ml.unionByName(net).unionByName(raised), "id").select("kind", "id", "evidence", "ref", "risk_score")


def subgraph_summary(nodes: DataFrame, edge_rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: nodes by kind, edges, risky transactions, alerts and the highest risk."""
    j = lambda df: df.withColumn("_j", F.lit(1))
    is_ml = F.col("evidence") == "ml"
    n = nodes.agg(F.count(F.when(F.col("kind") == "transaction", 1)).alias("transactions"),
                  F.count(F.when(F.col("kind") == "address", 1)).alias("addresses"))
    e = edge_rows.agg(F.count(F.lit(1)).alias("edges"), F.sum("value_satoshi").alias("value_satoshi"))
    x = evidence.agg(F.count(F.when(is_ml & (F.col("risk_score") >= X.HIGH_AT), 1)).alias("high_risk"),
                     F.count(F.when(F.col("evidence") == "alert", 1)).alias("alerts"),
                     F.max(F.when(is_ml, F.col("risk_score"))).alias("max_risk"))
    return j(n).join(j(e), "_j").join(j(x), "_j").drop("_j")


def resolve_entity(transactions: DataFrame, addresses: DataFrame, entity_id: str, hint: str | None = None) -> DataFrame:
    """Where an identifier lives: transactions before addresses, unless a hint says otherwise."""
    tx = transactions.where(F.col(TX) == entity_id).select(
        F.lit("transaction").alias("entity_type"), "dataset_id", F.lit(1).alias("priority"))
    addr = addresses.where(F.col("address_id") == entity_id).select(
        F.lit("address").alias("entity_type"), "dataset_id", F.lit(2).alias("priority"))
    both = tx.unionByName(addr)
    if hint:
        both = both.where(F.col("entity_type") == hint)
    return both.distinct().orderBy("priority", "dataset_id")


def require_entity(found: DataFrame, entity_id: str, dataset_id: str | None = None) -> tuple[str, str]:
    """The type and dataset of an identifier; raise when unknown or in another dataset."""
    inside = found if dataset_id is None else found.where(F.col("dataset_id") == dataset_id)
    row = inside.orderBy("priority", "dataset_id").first()
    if row:
        return row["entity_type"], row["dataset_id"]
    raise LookupError(f"entity {entity_id} not found" if found.isEmpty() else f"entity {entity_id} belongs to another dataset")


def validated_export(nodes: DataFrame, edge_rows: DataFrame, suspicious_above: int = X.SAT_PER_BTC) -> tuple[DataFrame, DataFrame]:
    """Clean an exported graph: no blank or repeated ids, no dangling edges, large edges flagged."""
    ids = nodes.select(F.trim("node_id").alias("node_id"), *[c for c in nodes.columns if c != "node_id"])
    ids = ids.where(F.coalesce(F.col("node_id"), F.lit("")) != "").groupBy("node_id").agg(
        *[F.min(c).alias(c) for c in nodes.columns if c != "node_id"])
    e = edge_rows.select(F.trim("source").alias("source"), F.trim("target").alias("target"), "amount_satoshi", "edge_id")
    known = ids.select(F.col("node_id"))
    e = e.join(known.withColumnRenamed("node_id", "source"), "source", "left_semi").join(
        known.withColumnRenamed("node_id", "target"), "target", "left_semi")
    return ids, e.withColumn("is_suspicious", F.coalesce(F.col("amount_satoshi") > suspicious_above, F.lit(False)))


# ---- inferred clusters -------------------------------------------------------------------------

def severity(score: Column) -> Column:
    return X.risk_level(score)


def payment_components(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Components of the payment projection, found through transactions: no address pairs are formed.

    A transaction links all its addresses when it has at least one input and one output address and
    these are not one and the same address.
    """
    sides = inputs.where(F.col("input_address").isNotNull()).select(
        TX, F.col("input_address").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(
        outputs.where(F.col("output_address").isNotNull()).select(
            TX, F.col("output_address").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    members = sides.groupBy(TX, "node").agg(F.max("i").alias("i"), F.max("o").alias("o"))
    linked = members.groupBy(TX).agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.count(F.lit(1)).alias("n"))
    linked = linked.where((F.col("n_in") > 0) & (F.col("n_out") > 0) & (F.col("n") > 1)).select(TX)
    labels = components.component_labels(
        components.star_edges(members.join(linked, TX, "left_semi").select(TX, "node"), TX, "node"))
    return labels.withColumnRenamed("node", "address_id")


def inferred_clusters(labels: DataFrame, tables: Mapping[str, DataFrame], addresses: DataFrame, results: DataFrame,
                      alerts: DataFrame | None = None) -> DataFrame:
    """One row per inferred cluster of two or more addresses: members, flows, risk, behaviour, alerts."""
    ins, outs, tx = (tables[n] for n in ("transaction_inputs", "transaction_outputs", "transactions"))
    named = labels.join(addresses, "address_id")
    flows = named.groupBy("component").agg(
        F.count(F.lit(1)).alias("address_count"), F.sum("total_received_satoshi").alias("received_satoshi"),
        F.sum("total_sent_satoshi").alias("sent_satoshi"),
        F.max_by("address_id", F.struct("transaction_count", "address_id")).alias("lead_address"),
        F.min("first_seen_timestamp").alias("first_seen"), F.max("last_seen_timestamp").alias("last_seen"))
    member_tx = incidence(ins, outs).join(labels.withColumnRenamed("address_id", "address"), "address").groupBy(
        TX).agg(F.min("component").alias("component"))
    scored = member_tx.join(results.select(F.col("entity_id").alias(TX), "risk_score", "prediction_label"), TX, "left")
    per_class = scored.groupBy("component", "prediction_label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("risk_score").alias("s"), F.count("risk_score").alias("k"),
        F.max("risk_score").alias("m"))
    risk = per_class.groupBy("component").agg(
        F.sum("n").alias("transaction_count"), (F.sum("s") / F.sum("k") * 100).alias("avg_risk"),
        (F.max("m") * 100).alias("max_risk"),
        F.min_by("prediction_label", F.struct(-F.when(F.col("prediction_label").isNotNull(), F.col("n")).otherwise(0),
                                              "prediction_label")).alias("dominant_behavior"))
    out = flows.join(risk, "component", "left")
    if alerts is not None:
        linked = alerts.join(member_tx, TX).groupBy("component").agg(
            F.count(F.lit(1)).alias("total_alerts"),
            F.count(F.when(~F.col("status").isin("RESOLVED", "DISMISSED", "FALSE_POSITIVE"), 1)).alias("active_alerts"))
        out = out.join(linked, "component", "left")
    zero = F.lit(0).cast("bigint")
    counts = [F.coalesce(c, zero).alias(c) for c in ("total_alerts", "active_alerts")] if alerts is not None else []
    return out.where(F.col("address_count") > 1).select(
        "component", "address_count", F.coalesce("transaction_count", zero).alias("transaction_count"),
        "received_satoshi", "sent_satoshi", (F.col("received_satoshi") - F.col("sent_satoshi")).alias("balance_satoshi"),
        "avg_risk", "max_risk", severity(F.col("max_risk") / 100).alias("severity"), "dominant_behavior",
        "lead_address", "first_seen", "last_seen", *counts)


def component_growth_check(growth: DataFrame, index: DataFrame) -> DataFrame:
    """Component size of the transaction standing at 25, 50, 75 and 100 % of the time order."""
    total = index.agg(F.count(F.lit(1)).alias("n"))
    marks = total.select(F.explode(F.transform(F.array(*[F.lit(p) for p in (25, 50, 75, 100)]), lambda p: F.struct(
        p.alias("pct"), F.greatest(F.lit(0).cast("bigint"), F.floor(F.col("n") * p / 100).cast("bigint") - 1).alias(
            "position")))).alias("m")).select("m.*")
    return index.join(F.broadcast(marks), "position").join(growth, TX).select("pct", TX, "hist_component_size")
