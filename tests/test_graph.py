"""Components, chronological replay and neighbourhoods against sequential union-find."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import components as c, features as f, graph as g
from ledgerscope.session import pin


class Sets:
    def __init__(self):
        self.parent, self.size, self.txs = {}, {}, {}

    def find(self, x):
        if x not in self.parent:
            self.parent[x], self.size[x], self.txs[x] = x, 1, 0
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def union(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        if a != b:
            self.parent[b] = a
            self.size[a] += self.size[b]
            self.txs[a] += self.txs[b]
        return a


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(70)]
    edges += [("hub", f"n{i}") for i in range(60)] if seed == 2 else [(f"p{i}", f"p{i + 1}") for i in range(60)]
    s = Sets()
    for a, b in edges:
        s.union(a, b)
    got = {r["node"]: r["component"] for r in c.component_labels(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {n: s.find(n) for n in s.parent}


@pytest.mark.parametrize("path", [lambda i: i, lambda i: (i * 7919) % 300])
def test_components_of_chains_ladders_and_loops(spark, path):
    edges = [(f"n{path(i):03d}", f"n{path(i + k):03d}") for i in range(200) for k in (1, 2)] + [("z", "z"), ("y", "y"), ("y", "x"), ("y", "x")]
    s = Sets()
    for a, b in edges:
        s.union(a, b)
    got = [(r["node"], r["component"]) for r in c.component_labels(spark.createDataFrame(edges, "u string, v string")).collect()]
    assert sorted(got) == sorted((n, s.find(n)) for n in s.parent)


def test_settled_leaves_are_not_written_again(spark, monkeypatch):
    """A star of stars: once the leaves are settled, no step of the search holds a row for each of them."""
    sizes = {}
    monkeypatch.setattr(c, "pin", lambda df, label="step": sizes.setdefault(label, []).append(df.count()) or pin(df, label))
    edges = [(f"p{h:02d}_{i:02d}", f"a{h:02d}") for h in range(10) for i in range(40)] + [(f"p{h:02d}_00", f"a{h + 1:02d}") for h in range(9)]
    labels = c.component_labels(spark.createDataFrame(edges, "u string, v string"))
    assert labels.count() == 410 and labels.select("component").distinct().count() == 1
    assert max(n for label in ("cc", "cc-roots", "cc-inner") for n in sizes[label]) <= 20


@pytest.mark.parametrize("seed", [5, 6])
def test_weak_component_sizes_equal_components_of_all_nodes(ledger, random_rows, seed):
    t = ledger(random_rows(seed, 30, 60))
    money = t["transactions"], t["transaction_inputs"], t["transaction_outputs"]
    whole = g.component_sizes(g.weak_components(g.edges(*money)))
    sizes = lambda df: sorted(r["component_size"] for r in df.collect())
    assert sizes(g.weak_component_sizes(*money)) == sizes(whole)


def replay_clusters(rows):
    s, out = Sets(), {}
    for txid, _, ins, outs in sorted(rows, key=lambda r: (r[1], r[0])):
        if not ins:
            out[txid] = ("cluster_unknown", 0, 0)
            continue
        root = s.find(ins[0][0])
        out[txid] = (f"cluster_{root}", s.size[root], s.txs[root])
        for a in [a for a, _ in ins] + [a for a, _, change in outs if change]:
            root = s.union(root, a)
        s.txs[root] += 1
    return out, s


def replay_growth(rows):
    s, out = Sets(), {}
    for txid, _, ins, outs in sorted(rows, key=lambda r: (r[1], r[0])):
        node = f"tx:{txid}"
        s.find(node)
        for a in [a for a, _ in ins] + [a for a, _, _ in outs]:
            s.union(node, f"a:{a}")
        out[txid] = s.size[s.find(node)]
    return out


# few and many addresses: one giant component, and several rounds of contraction
@pytest.mark.parametrize("seed,addresses", [(1, 40), (4, 40), (6, 200)])
def test_chronological_replay(ledger, random_rows, seed, addresses):
    rows = random_rows(seed, 60, addresses)
    t = ledger(rows)
    args = t["transactions"], t["transaction_inputs"], t["transaction_outputs"]
    want, sets = replay_clusters(rows)
    got = {r[0]: (r[1], r[2], r[3]) for r in g.cluster_history(*args).select(
        "transaction_id", "hist_cluster_id", "hist_cluster_size", "hist_cluster_tx_count").collect()}
    assert got == want
    growth = {r[0]: r[1] for r in g.component_growth(*args).collect()}
    assert growth == replay_growth(rows)
    final = {r["address"]: (r["cluster_root"], r["cluster_size"], r["cluster_tx_count"]) for r in g.final_clusters(*args).collect()}
    assert final == {a: (sets.find(a), sets.size[sets.find(a)], sets.txs[sets.find(a)]) for a in sets.parent}


def test_three_transactions(ledger):
    rows = [("tx1", 1000, [("A", 10), ("B", 20)], [("C", 15, False), ("D", 14, True)]),
            ("tx2", 2000, [("E", 50)], [("F", 30, False), ("A", 19, True)]),
            ("tx3", 3000, [("B", 40)], [("G", 20, False), ("H", 19, False)])]
    t = ledger(rows)
    args = t["transactions"], t["transaction_inputs"], t["transaction_outputs"]
    final = {r["address"]: r["cluster_root"] for r in g.final_clusters(*args).collect()}
    assert final["A"] == final["B"] == final["D"] == final["E"]
    tl = f.address_timeline(*args)
    got = {r["transaction_id"]: r for r in g.graph_features(t, tl).collect()}
    assert got["tx1"]["hist_cluster_tx_count"] == 0 and got["tx3"]["hist_cluster_size"] == 4
    assert got["tx3"]["hist_cluster_tx_count"] == 2
    assert got["tx1"]["hist_component_size"] == 5 and got["tx3"]["hist_component_size"] == 11
    assert got["tx3"]["hist_address_reuse_ratio"] == 1.0 and got["tx2"]["hist_out_mean_neighbor_degree"] == 0.5


@pytest.mark.parametrize("seed", [8])
def test_neighbour_history(ledger, random_rows, seed):
    rows = random_rows(seed, 50)
    t = ledger(rows)
    tl = f.address_timeline(t["transactions"], t["transaction_inputs"], t["transaction_outputs"])
    got = {r["transaction_id"]: r for r in g.neighbour_history(tl).collect()}
    seen = {}
    for txid, _, ins, outs in sorted(rows, key=lambda r: (r[1], r[0])):
        a, b = [x for x, _ in ins], [x for x, _, _ in outs]
        mean = lambda xs: sum(seen.get(x, 0) for x in set(xs)) / len(set(xs)) if xs else 0.0
        assert got[txid]["hist_in_mean_neighbor_degree"] == pytest.approx(mean(a), abs=1e-4)
        assert got[txid]["hist_out_mean_neighbor_degree"] == pytest.approx(mean(b), abs=1e-4)
        assert got[txid]["hist_address_reuse_ratio"] == pytest.approx(sum(seen.get(x, 0) > 0 for x in a) / len(a) if a else 0, abs=1e-4)
        for x in a + b:
            seen[x] = seen.get(x, 0) + 1


def test_payment_components_match_pairs(ledger, random_rows):
    rows = random_rows(9, 20, 60)
    t = ledger(rows)
    got = {r["address_id"]: r["component"] for r in g.payment_components(t["transaction_inputs"], t["transaction_outputs"]).collect()}
    s = Sets()
    for _, _, ins, outs in rows:
        for a, _ in ins:
            for b, _, _ in outs:
                if a != b:
                    s.union(a, b)
    assert got == {n: s.find(n) for n in s.parent}


def test_entity_errors(ledger, spark):
    t = ledger([("tx1", 1000, [("A", 10)], [("B", 9, False)])])
    tx = t["transactions"].withColumn("dataset_id", F.lit("d1"))
    addresses = spark.createDataFrame([("A", "d1")], "address_id string, dataset_id string")
    assert g.require_entity(g.resolve_entity(tx, addresses, "tx1"), "tx1") == ("transaction", "d1")
    with pytest.raises(LookupError, match="not found"):
        g.require_entity(g.resolve_entity(tx, addresses, "zz"), "zz")
    with pytest.raises(LookupError, match="another dataset"):
        g.require_entity(g.resolve_entity(tx, addresses, "A"), "A", "d2")


@pytest.mark.parametrize("seed", [3, 8])
def test_alert_history_equals_graph_features(ledger, random_rows, monkeypatch, seed):
    t = ledger(random_rows(seed, 25, 20))
    timeline = f.address_timeline(t["transactions"], t["transaction_inputs"], t["transaction_outputs"])
    whole = g.graph_features(t, timeline)

    def unasked(*_):
        raise AssertionError("alerts read nothing that needs the timeline")

    monkeypatch.setattr(f, "address_timeline", unasked)
    alone = g.alert_history(t)
    assert {"hist_component_size", "hist_address_reuse_ratio", "hist_cluster_id", "hist_cluster_size", "hist_cluster_tx_count"} < set(alone.columns)
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, whole.select(alone.columns).collect()))


def test_numbered_links_are_the_edges(ledger, random_rows):
    t = ledger(random_rows(4, 25, 20))
    money = t["transactions"], t["transaction_inputs"], t["transaction_outputs"]
    links, names = g.numbered_links(*money)
    name = {r["node"]: r["node_id"] for r in names.collect()}
    assert [name[i] for i in sorted(name)] == sorted(name.values()) and links.dtypes == [("u", "bigint"), ("v", "bigint")]
    got = sorted((name[r["u"]], name[r["v"]]) for r in links.collect())
    assert got == sorted(map(tuple, g.edges(*money).select("source", "target").distinct().collect()))
