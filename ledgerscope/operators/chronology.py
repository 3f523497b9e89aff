"""Components as they grow in time, without replaying time.

Union-find over a stream is sequential. What it answers isn't: two nodes are connected before a time exactly if the minimum
spanning forest by time connects them through earlier edges. The forest is found in Borůvka rounds. In each, every component picks its
earliest edge to another one and the picks are contracted, so there are at most log2(nodes) rounds.

The rounds also answer size queries. Along picks, times never increase towards a contracted component's centre. Let ``since`` be
the latest pick on a node's way through the rounds up to some component, and ``until`` that component's own pick. Then the nodes
connected to a node before time t are, in the first component on its way with ``until`` >= t, exactly those whose ``since`` is
below t. Size, least node and transactions so far are therefore running totals over ``since`` within one component of one
round, and running totals are cut into stretches of time, so the giant component is no single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.ordering import global_positions, running_before
from ledgerscope.session import pin, release

#: Running totals are cut every 2^16 transactions.
_STRETCH = 16


def _roots(picks: DataFrame) -> DataFrame:
    """``(c, w, root)``: follow picks to the component where two pick each other, by pointer jumping."""
    other = picks.select(F.col("c").alias("d"), F.col("d").alias("back"))
    centre = (F.col("back") == F.col("c")) & (F.col("c") < F.col("d"))
    at = pin(picks.join(other, "d").select("c", "w", F.when(centre, F.col("c")).otherwise(F.col("d")).alias("root")), "roots")
    while True:
        hop = at.select(F.col("c").alias("root"), F.col("root").alias("next"))
        moved = pin(at.join(hop, "root").select("c", "w", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        release(at)
        at = moved.drop("moved")
        if not moved.where("moved").head(1):
            return at


def forest_rounds(edges: DataFrame) -> list[DataFrame]:
    """The contractions of a minimum spanning forest: per round ``(c, w, root)``, the pick of each component and what it became.

    ``edges(u, v, w, b)``: whole numbers; (w, b) tells edges apart and orders them. A component that picks nothing is
    left out, so the list ends with the last round that contracts.
    """
    def narrowed(frame: DataFrame) -> DataFrame:
        pairs = frame.where(F.col("u") != F.col("v")).groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        return pairs.agg(F.min(F.struct("w", "b")).alias("k")).select("u", "v", "k.w", "k.b")

    live, rounds = pin(narrowed(edges), "forest_edges"), []
    while live.head(1):
        ends = live.select(F.explode(F.array(F.struct(F.col("u").alias("c"), F.col("v").alias("d")),
                                             F.struct(F.col("v").alias("c"), F.col("u").alias("d")))).alias("e"), "w", "b")
        picks = pin(ends.groupBy("e.c").agg(F.min(F.struct("w", "b", F.col("e.d").alias("d"))).alias("k")).select("c", "k.w", "k.d"), "picks")
        rounds.append(_roots(picks))
        release(picks)
        to = rounds[-1].select("c", "root")
        left = live.join(to.withColumnRenamed("c", "u"), "u").select(F.col("root").alias("ru"), "v", "w", "b")
        both = left.join(to.withColumnRenamed("c", "v"), "v").select(F.col("ru").alias("u"), F.col("root").alias("v"), "w", "b")
        last, live = live, pin(narrowed(both), "forest_edges")
        release(last)
    release(live)
    return rounds


def ways(nodes: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """``(id, level, v, since, until)``: each node's way through the rounds; ``until`` is null in the last component."""
    at = nodes.select("id", F.col("id").alias("v"), F.lit(-1).cast("long").alias("since"))
    parts = []
    for level, step in enumerate([*rounds, None]):
        if step is None:
            parts.append(at.select("id", F.lit(level).alias("level"), "v", "since", F.lit(None).cast("long").alias("until")))
            break
        moved = pin(at.join(step.withColumnRenamed("c", "v"), "v", "left"), "ways")
        parts.append(moved.select("id", F.lit(level).alias("level"), "v", "since", F.col("w").alias("until")))
        at = moved.where("root IS NOT NULL").select("id", F.col("root").alias("v"), F.greatest("since", "w").alias("since"))
    return reduce(DataFrame.unionAll, parts)


def _answers(way: DataFrame, anchors: DataFrame, asked: DataFrame) -> DataFrame:
    """``(id, t, least, size, txs)`` for ``asked(id, t)``: the component of a node through transactions before ``t``.

    ``anchors(at, id)`` gives one node of every transaction.
    """
    inside = (F.col("since") < F.col("t")) & (F.col("until").isNull() | (F.col("t") <= F.col("until")))
    routed = pin(asked.distinct().join(way, "id").where(inside).select("id", "t", "level", "v"), "asked")
    # what joins at or after a component's own pick is never asked for there
    open_ = lambda at: F.col("until").isNull() | (at < F.col("until"))
    wanted = routed.select("level", "v").distinct()
    node_points = way.where(open_(F.col("since"))).select("level", "v", F.col("since").alias("at"), F.col("id").alias("least"), F.lit(1).alias("nodes"), F.lit(0).alias("txs"))
    joined_at = F.greatest("since", "at")
    tx_points = anchors.join(way, "id").where(open_(joined_at)).select("level", "v", joined_at.alias("at"), F.lit(None).cast("long").alias("least"),
                                                                      F.lit(0).alias("nodes"), F.lit(1).alias("txs"))
    points = node_points.unionAll(tx_points).join(wanted, ["level", "v"], "left_semi").groupBy("level", "v", "at").agg(
        F.min("least").alias("least_"), F.sum("nodes").cast("long").alias("nodes"), F.sum("txs").cast("long").alias("n_txs"))
    questions = routed.select("level", "v", F.col("t").alias("at")).distinct()
    events = points.withColumn("kind", F.lit(1)).unionByName(questions.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    totals = running_before(events, ["level", "v"], F.shiftright("at", _STRETCH), ["at", "kind"], sums={"size": "nodes", "txs": "n_txs"}, mins={"least": "least_"})
    totals = totals.where("kind = 0").select("level", "v", F.col("at").alias("t"), "least", "size", "txs")
    return routed.join(totals, ["level", "v", "t"]).select("id", "t", "least", "size", "txs")


def component_history(members: DataFrame) -> DataFrame:
    """Per transaction, the component of its primary node just before it and its own component just after.

    ``members(ts, tx, node, is_primary)``: a transaction unites all its nodes. Result ``(tx, prior_label, prior_size, prior_txs, size,
    txs)``, sizes in nodes, labels the smallest node so far. Without a primary node the prior values are null, 0 and 0.
    """
    members = pin(members.groupBy("ts", "tx", "node").agg(F.max("is_primary").alias("is_primary")), "members")
    order = global_positions(members.select("ts", "tx").distinct(), ["ts", "tx"], "at")
    names = global_positions(members.select("node").distinct(), ["node"], "id")
    numbered = pin(members.join(order, ["ts", "tx"]).join(names, "node").select("at", "id", "is_primary"), "numbered")
    per_tx = pin(numbered.groupBy("at").agg(F.min("id").alias("id"), F.max(F.when(F.col("is_primary"), F.col("id"))).alias("primary")), "anchors")
    stars = numbered.select("at", F.col("id").alias("b")).join(per_tx.select("at", "id"), "at").select(
        F.col("id").alias("u"), F.col("b").alias("v"), F.col("at").alias("w"), "b")
    way = pin(ways(names, forest_rounds(stars)), "way")

    before = per_tx.where("primary IS NOT NULL").select("at", F.col("primary").alias("id"), F.col("at").alias("t"))
    after = per_tx.select("at", "id", (F.col("at") + 1).alias("t"))
    answers = pin(_answers(way, per_tx.select("at", "id"), before.select("id", "t").unionAll(after.select("id", "t"))), "answers")
    grown = after.join(answers, ["id", "t"]).select("at", "size", "txs")
    prior = before.join(answers, ["id", "t"]).select("at", "least", F.col("size").alias("prior_size"), F.col("txs").alias("prior_txs"))
    prior = prior.join(names.select(F.col("id").alias("least"), F.col("node").alias("prior_label")), "least").drop("least")
    return order.select("tx", "at").join(grown, "at").join(prior, "at", "left").select(
        "tx", "prior_label", F.coalesce("prior_size", F.lit(0).cast("long")).alias("prior_size"),
        F.coalesce("prior_txs", F.lit(0).cast("long")).alias("prior_txs"), "size", "txs")
