"""Metrics, preprocessing, scoring and additive explanations."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerscope.operators import centrality, metrics as m, quality, scoring as s


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(2)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.4)) for _ in range(400)] + [(0.29, 1), (0.57, 0), (1.0, 1), (0.0, 0)]
    return rows, spark.createDataFrame(rows, "p double, y int")


def test_ranking_metrics(scored):
    rows, df = scored
    got = m.ranking_metrics(df, "p", "y").first()
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap, prev = 0.0, 0.0
    for t in sorted({p for p, _ in rows}, reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(p >= t for p in neg)
        ap += (tp / len(pos) - prev) * tp / (tp + fp)
        prev = tp / len(pos)
    assert got["roc_auc"] == pytest.approx(auc) and got["pr_auc"] == pytest.approx(ap)


def test_sweep_is_exact_at_edges(scored):
    rows, df = scored
    for r in m.threshold_sweep(df, "p", "y").collect():
        t = r["threshold"]
        assert r["tp"] == sum(p >= t and y for p, y in rows) and r["fp"] == sum(p >= t and not y for p, y in rows)
    none = m.threshold_metrics(df, "p", "y", [2.0]).first()
    assert none["precision"] == 0.0 and none["f1"] == 0.0


@pytest.fixture(scope="module")
def training(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        a, b, c = rng.random(), rng.random(), rng.choice(["US", "DE", "NL"])
        rows.append((f"t{i:03d}", a, b, c, int(a + 0.3 * (c == "US") > 0.6)))
    return spark.createDataFrame(rows, "transaction_id string, tx_fee_sats double, rel_fan_in double, net_country string, y int")


FEATURES = ["tx_fee_sats", "rel_fan_in", "net_country"]


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_tree_contributions_add_up(training, kind):
    common = dict(featuresCol="vector", labelCol="y", weightCol="class_weight", seed=1)
    estimator = GBTClassifier(maxIter=5, maxDepth=3, **common) if kind == "boosted" else RandomForestClassifier(numTrees=6, maxDepth=4, **common)
    model = s.fit(training, "y", estimator, FEATURES)
    names = s.vector_names(model, FEATURES)
    out = model.transform(s.complete(training))
    got = {r["transaction_id"]: r["base"] + sum(r["contributions"]) for r in s.tree_contributions(out, model.stages[-1], len(names)).collect()}
    if kind == "boosted":  # raw prediction of a boosted model is (-margin, margin)
        want = out.select("transaction_id", vector_to_array("rawPrediction")[1].alias("w"))
    else:
        want = out.select("transaction_id", vector_to_array("probability")[1].alias("w"))
    for r in want.collect():
        assert got[r["transaction_id"]] == pytest.approx(r["w"], abs=1e-9)


def test_unseen_category_is_zero_vector(spark):
    train = spark.createDataFrame([("US",), ("DE",)], "net_country string")
    fitted = Pipeline(stages=s.one_hot_stages(["net_country"])).fit(train)
    out = fitted.transform(spark.createDataFrame([("XX",), ("US",)], "net_country string")).select(vector_to_array("net_country_oh").alias("v")).collect()
    assert sum(out[0]["v"]) == 0 and sum(out[1]["v"]) == 1


def test_scores_obey_the_contract(training):
    data = training.withColumn("behavior_type", F.when(F.col("y") == 1, "mixing_like").otherwise("normal"))
    for c in s.NUMERIC + ["net_asn"]:
        if c not in data.columns:
            data = data.withColumn(c, F.lit(0.0) if c != "net_asn" else F.lit("1"))
    binary = s.fit(data, "y", GBTClassifier(featuresCol="vector", labelCol="y", weightCol="class_weight", maxIter=2, maxDepth=2, seed=1))
    multi = s.fit_multiclass(data, trees=3)
    rows = s.score(data, binary, multi, "an", "d")
    assert rows.count() == 300
    quality.require_valid(quality.result_rules(rows))
    with pytest.raises(quality.ValidationFailed, match="risk_score"):
        s.run_scorer(rows, lambda df: df.withColumn("risk_score", F.col("risk_score") + 2))
    with pytest.raises(ValueError, match="confidence"):
        s.run_scorer(rows, lambda df: df.drop("confidence"))
    assert s.select_model({"a": (0.9, 0.5), "b": (0.9, 0.7), "c": (0.8, 0.99)}) == "b"


def test_shuffle_keeps_labels_but_moves_them(spark):
    df = spark.range(300).select(F.concat(F.lit("t"), "id").alias("transaction_id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    out = s.shuffled_target(df, "y")
    assert out.count() == 300 and out.agg(F.sum("y")).first()[0] == 100
    assert out.join(df.withColumnRenamed("y", "z"), "transaction_id").where("y <> z").count() > 50


def test_permutation_check_falls_to_chance(training):
    rows = training.withColumn("split", F.when(F.pmod(F.xxhash64("transaction_id"), F.lit(3)) == 0, "val").otherwise("train"))
    for c in s.NUMERIC + ["net_asn"]:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(0.0) if c != "net_asn" else F.lit("1"))
    forest = RandomForestClassifier(featuresCol="vector", labelCol="y", weightCol="class_weight", numTrees=15, maxDepth=4, seed=1)
    chance = lambda r: r["roc_auc"] > 0.9 and abs(r["permuted_roc_auc"] - 0.5) < 0.2 and r["roc_auc_drop"] > 0.25
    assert chance(s.permutation_check(rows, "y", "split", {"forest": forest}).first())
    same = s.permutation_check(rows, "y", "split", {"forest": forest}, lambda df, label: df).first()
    assert not chance(same) and same["roc_auc_drop"] == 0


def test_boosted_classes(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        a, b = rng.random(), rng.random()
        rows.append((f"t{i:03d}", a, b, "low" if a < 0.3 else "edge" if b > 0.7 else "high"))
    df = spark.createDataFrame(rows, "transaction_id string, tx_fee_sats double, rel_fan_in double, behavior_type string")
    train, val = df.where("transaction_id < 't300'"), df.where("transaction_id >= 't300'")
    model = s.fit_boosted_classes(train, features=["tx_fee_sats", "rel_fan_in"], rounds=5, depth=3)
    scored = model.transform(s.complete(val))
    assert model.classes == ["edge", "high", "low"]
    for r in scored.select("class_probability").collect():
        assert sum(r[0]) == pytest.approx(1) and min(r[0]) >= 0
    quality_ = s.class_quality(scored, model.classes, "class_probability").first()
    assert quality_["accuracy"] > 0.9 and quality_["macro_f1"] > 0.9 and quality_["log_loss"] < 0.5 and quality_["rows"] == 100


def dense_rank(edges, rounds=400):
    nodes = sorted({x for e in edges for x in e})
    place = {x: i for i, x in enumerate(nodes)}
    m, n = np.zeros((len(nodes), len(nodes))), len(nodes)
    for u, v in set(edges):
        m[place[v], place[u]] = 1
    out = m.sum(0)
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        rank = 0.15 / n + 0.85 * (m @ np.divide(rank, out, out=np.zeros(n), where=out > 0) + rank[out == 0].sum() / n)
    return dict(zip(nodes, rank))


def test_page_rank_equals_power_iteration(spark):
    rng = random.Random(3)
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "a"), ("d", "f")] + [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(90)]
    ranks = centrality.page_rank(spark.createDataFrame(edges, "u string, v string"), tolerance=1e-10)
    want = dense_rank(edges)
    assert {r["node"]: r["rank"] for r in ranks.collect()} == pytest.approx(want, abs=1e-8)
    found = centrality.rank_summary(ranks).first()
    values = sorted(want.values())
    assert found["median_rank"] == pytest.approx(np.quantile(values, 0.5)) and found["p95_rank"] == pytest.approx(np.quantile(values, 0.95))


def test_page_rank_of_many_nodes_takes_more_than_one_round(spark):
    """A long path in a large graph: the stop rule is a share of the whole, so it doesn't loosen with the number of nodes."""
    wide = spark.range(300_000).select(F.concat(F.lit("s"), "id").alias("u"), F.lit("hub").alias("v"))
    path = spark.createDataFrame([("hub", "p1"), ("p1", "p2"), ("p2", "p3")], "u string, v string")
    ranks = {r["node"]: r["rank"] for r in centrality.page_rank(wide.union(path), tolerance=1e-6).where("node like 'p%' or node = 'hub'").collect()}
    assert ranks["p3"] / ranks["hub"] == pytest.approx(0.85 ** 3, rel=1e-3)


def plain_components(edges):
    """Largest member of the strong component of each node, by two depth-first passes."""
    out, back = {}, {}
    for u, v in edges:
        out.setdefault(u, []).append(v)
        back.setdefault(v, []).append(u)
    nodes, seen, order = sorted({x for e in edges for x in e}), set(), []
    for start in nodes:
        stack = [(start, 0)]
        while stack:
            x, done = stack.pop()
            if done:
                order.append(x)
            elif x not in seen:
                seen.add(x)
                stack.append((x, 1))
                stack += [(y, 0) for y in out.get(x, []) if y not in seen]
    found = {}
    for start in reversed(order):
        group, stack = [], [start]
        while stack:
            x = stack.pop()
            if x not in found:
                found[x] = None
                group.append(x)
                stack += [y for y in back.get(x, []) if y not in found]
        for x in group:
            found[x] = max(group)
    return found


@pytest.mark.parametrize("seed", [0, 2])
def test_strong_components(spark, seed):
    rng = random.Random(seed)
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("g", "a"), ("h", "h")]
    edges += [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(20 + 15 * seed)]
    # a chain out of and back into a component, with side entries
    edges += [("c", "x1"), *[(f"x{i}", f"x{i + 1}") for i in range(1, 6)], ("x6", "b"), ("y", "x3"), ("e", "x5")]
    got = {r["node"]: r["component"] for r in centrality.strong_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == plain_components(edges)


def test_long_chain_and_long_cycle_take_few_rounds(spark, monkeypatch):
    written = []
    plain = centrality.pin
    monkeypatch.setattr(centrality, "pin", lambda df, label="step": written.append(label) or plain(df, label))
    ids = spark.range(10_000).select(F.format_string("c%05d", "id").alias("u"), F.format_string("c%05d", F.col("id") + 1).alias("v"))
    ring = spark.range(10_000).select(F.format_string("r%05d", "id").alias("u"), F.format_string("r%05d", (F.col("id") + 1) % 10_000).alias("v"))
    got = centrality.strong_components(ids.union(ring)).groupBy("component").agg(F.count(F.lit(1)).alias("n")).groupBy("n").count()
    assert {r["n"]: r["count"] for r in got.collect()} == {1: 10_001, 10_000: 1}
    assert len(written) < 120


def sequential_communities(edges):
    """Moves of one node at a time, level by level, each to the best neighbouring community."""
    weight = {}
    for a, b in {tuple(sorted(e)) for e in edges if e[0] != e[1]}:
        weight[a, b] = weight[b, a] = 1.0
    whole, groups = dict(weight), {n: n for n, _ in weight}
    m2 = sum(weight.values())
    while True:
        nodes = sorted({a for a, _ in weight})
        label, k, near = {n: n for n in nodes}, dict.fromkeys(nodes, 0.0), {n: {} for n in nodes}
        for (a, b), w in weight.items():
            k[a] += w
            if a != b:
                near[a][b] = w
        total, moved, any_move = dict(k), True, False
        while moved:
            moved = False
            for n in nodes:
                total[label[n]] -= k[n]
                to = {}
                for o, w in near[n].items():
                    to[label[o]] = to.get(label[o], 0.0) + w
                best = max([label[n], *sorted(to)], key=lambda c: (round(to.get(c, 0.0) - k[n] * total.get(c, 0.0) / m2, 12), c == label[n]))
                if best != label[n]:
                    label[n], moved, any_move = best, True, True
                total[best] = total.get(best, 0.0) + k[n]
        groups = {n: label[c] for n, c in groups.items()}
        if not any_move:
            break
        merged = {}
        for (a, b), w in weight.items():
            merged[label[a], label[b]] = merged.get((label[a], label[b]), 0.0) + w
        weight = merged
    return groups, quality_of(whole, groups)


def quality_of(weight, groups):
    m2, inner, k = sum(weight.values()), 0.0, {}
    for (a, b), w in weight.items():
        inner += w * (groups[a] == groups[b])
        k[groups[a]] = k.get(groups[a], 0.0) + w
    return inner / m2 - sum((v / m2) ** 2 for v in k.values())


def test_communities_against_sequential_moves(spark):
    """Ten random graphs with planted groups at once, as parts of one graph."""
    rng = random.Random(1)
    edges = []
    for part in range(10):
        size, groups = rng.randrange(12, 30), rng.randrange(2, 5)
        for i in range(size):
            for j in range(i):
                if rng.random() < (0.5 if i % groups == j % groups else 0.06):
                    edges.append((f"g{part}n{i:02d}", f"g{part}n{j:02d}"))
    found = {r["node"]: r["community"] for r in centrality.communities(spark.createDataFrame(edges, "u string, v string")).collect()}
    weight = {}
    for a, b in {tuple(sorted(e)) for e in edges}:
        weight[a, b] = weight[b, a] = 1.0
    assert quality_of(weight, found) >= 0.98 * sequential_communities(edges)[1]
    for c in set(found.values()):  # every community hangs together
        left = {n for n, x in found.items() if x == c}
        stack = [left.pop()]
        while stack:
            x = stack.pop()
            near = {b for a, b in weight if a == x} & left
            left -= near
            stack += near
        assert not left


def test_communities_of_two_cliques(spark):
    import itertools
    edges = list(itertools.combinations("abcd", 2)) + list(itertools.combinations("wxyz", 2)) + [("a", "w")]
    df = spark.createDataFrame(edges, "u string, v string")
    found = centrality.communities(df)
    groups = {r["node"]: r["community"] for r in found.collect()}
    assert len({groups[x] for x in "abcd"}) == 1 and len({groups[x] for x in "wxyz"}) == 1 and groups["a"] != groups["w"]
    assert centrality.community_summary(df, found).first()["modularity"] == pytest.approx(12 / 13 - 2 * (13 / 26) ** 2)


def test_queries_fit_every_candidate_and_ablation_at_its_own_size(spark, monkeypatch):
    from types import SimpleNamespace

    from ledgerscope.operators import scoring
    from ledgerscope.plans import model_queries as q

    seen = []

    class Any:
        def __getattr__(self, name):
            return lambda *a, **k: self

        def __sub__(self, other):
            return self

    monkeypatch.setattr(q.s, "fit", lambda train, label, estimator, *rest: seen.append(estimator) or Any())
    for name in ("positive_probability", "complete", "label_feature_groups"):
        monkeypatch.setattr(q.s, name, lambda *a: Any())
    monkeypatch.setattr(q.m, "ranking_metrics", lambda *a: Any())
    monkeypatch.setattr(q.F, "col", lambda *a: Any())
    monkeypatch.setattr(q.F, "lit", lambda *a: Any())
    own = scoring.binary_candidates(q.LABEL)
    bench = SimpleNamespace(modelling=Any())
    q.candidates(bench)
    size = lambda e: {p.name: v for p, v in e.extractParamMap().items()}
    assert [size(e) for e in seen] == [size(e) for e in own.values()]
    seen.clear()
    q.ablation(bench)
    q.ablation_scores(bench)
    assert len(seen) == 2 * len(scoring.ABLATIONS) and all(size(e) == size(own["random_forest"]) for e in seen)


def test_communities_settle_in_few_rounds(spark, monkeypatch):
    """Stars with common leaves, as addresses and transactions form: moves into one community are made together, and each round raises modularity."""
    made = []
    plain = centrality._moves
    monkeypatch.setattr(centrality, "_moves", lambda links, labels, *rest: made.append((links, labels)) or plain(links, labels, *rest))
    monkeypatch.setattr(centrality, "release", lambda df: None)
    rng = random.Random(4)
    edges = [(f"c{i % 12:02d}", f"t{i:03d}") for i in range(240)] + [(f"t{i:03d}", f"p{rng.randrange(40):02d}") for i in range(240) for _ in range(2)]
    centrality.communities(spark.createDataFrame(edges, "u string, v string")).count()
    assert len(made) < 60
    first = [labels for links, labels in made if links is made[0][0]]
    values = [centrality.modularity(made[0][0], labels).first()[0] for labels in (first[0], first[1], first[len(first) // 2], first[-1])]
    assert values == sorted(values) and values[-1] > values[0] + 0.2


def test_page_rank_rounds_leave_out_edges_into_ends(spark, monkeypatch):
    sizes = {}
    plain = centrality.pin
    monkeypatch.setattr(centrality, "pin", lambda df, label="step": sizes.setdefault(label, []).append(df.count()) or plain(df, label))
    edges = [("a", "b"), ("b", "a")] + [(x, f"{x}{i:02d}") for x in "ab" for i in range(50)]
    ranks = {r["node"]: r["rank"] for r in centrality.page_rank(spark.createDataFrame(edges, "u string, v string"), tolerance=1e-10).collect()}
    assert ranks == pytest.approx(dense_rank(edges), abs=1e-8)
    assert sizes["rank-inner"] == [2] and max(sizes["rank"]) == 2


def test_queries_on_few_columns_build_no_graph_features(spark, monkeypatch):
    from ledgerscope.plans import bench, registry

    def unasked(self):
        raise AssertionError("no graph feature is given out")

    for name in ("modelling", "graph_features"):
        monkeypatch.setattr(bench.Bench, name, property(unasked))
    for name in ("m18_row_explanations", "m22_graph_evidence", "m02_one_hot"):
        assert registry.plans()[name](spark, "/root/testdata/sf0.001").columns[0] == "transaction_id"
