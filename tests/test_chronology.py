"""Growth of components in time against a sequential union-find and against recursive SQL."""

from __future__ import annotations

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import chronology as c


def replay(rows):
    """(prior label, prior size, prior txs, size, txs) per transaction, one transaction after the other."""
    parent, size, txs, out = {}, {}, {}, {}

    def find(x):
        if x not in parent:
            parent[x], size[x], txs[x] = x, 1, 0
        while parent[x] != x:
            x = parent[x]
        return x

    for (ts, tx) in sorted({r[:2] for r in rows}):
        mine = sorted({(node, primary) for t, x, node, primary in rows if (t, x) == (ts, tx)})
        primaries = [node for node, primary in mine if primary]
        before = (None, 0, 0)
        if primaries:
            root = find(max(primaries))
            before = (root, size[root], txs[root])
        roots = sorted({find(node) for node, _ in mine})
        total, count = sum(size[r] for r in roots), sum(txs[r] for r in roots) + 1
        for r in roots:
            parent[r] = roots[0]
        size[roots[0]], txs[roots[0]] = total, count
        out[tx] = (*before, total, count)
    return out


def members(kind, seed):
    rng = random.Random(seed)
    rows = []
    if kind == "chain":  # a path that grows at one end, in the middle, and backwards
        order = list(range(80))
        rng.shuffle(order)
        for ts, i in enumerate(order):
            rows += [(ts, f"t{ts:03d}", f"n{i:03d}", True), (ts, f"t{ts:03d}", f"n{i + 1:03d}", False)]
    else:
        for i in range(90):
            ts = rng.randrange(0, 40)  # many ties in time
            nodes = rng.sample([f"n{j:03d}" for j in range(25 if kind == "dense" else 120)], rng.randrange(1, 5))
            if rng.random() < 0.3:
                nodes.append("hub")
            rows += [(ts, f"t{rng.randrange(1000):03d}-{i}", n, k == 0 and rng.random() < 0.8) for k, n in enumerate(nodes)]
    return rows


@pytest.mark.parametrize("kind,seed", [("chain", 1), ("dense", 2), ("sparse", 3)])
def test_same_as_sequential(spark, kind, seed):
    rows = members(kind, seed)
    got = c.component_history(spark.createDataFrame(rows, "ts bigint, tx string, node string, is_primary boolean")).collect()
    want = replay(rows)
    assert {r["tx"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_rounds_grow_with_the_logarithm(spark):
    n = 600
    edges = spark.range(n).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.xxhash64("id").alias("w"), F.col("id").alias("b"))
    assert len(c.forest_rounds(edges)) <= 9


def test_no_members(spark):
    assert c.component_history(spark.createDataFrame([], "ts bigint, tx string, node string, is_primary boolean")).collect() == []


FOLDER = "/root/testdata/sf0.001"
SEQUENTIAL = """WITH RECURSIVE mem AS MATERIALIZED ({members}),
 steps AS MATERIALIZED (SELECT transaction_id, row_number() OVER (ORDER BY ts, transaction_id) AS i FROM c_tx),
 placed AS MATERIALIZED (SELECT i, a, p FROM mem JOIN steps USING (transaction_id) WHERE a IS NOT NULL),
 st(key, l, n, x, i, pl, pn, px) USING KEY (key) AS (
  SELECT '#' AS key, '' AS l, 0 AS n, 0 AS x, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS pl, CAST(0 AS BIGINT) AS pn, CAST(0 AS BIGINT) AS px
  UNION
  SELECT * FROM (
   WITH cur AS (SELECT i + 1 AS i FROM st WHERE key = '#'),
   m AS (SELECT a, p FROM placed WHERE i = (SELECT i FROM cur)),
   hit AS (SELECT m.a, m.p, coalesce(r.l, m.a) AS l, coalesce(r.n, 1) AS n, coalesce(r.x, 0) AS x FROM m LEFT JOIN recurring.st r ON r.key = m.a),
   parts AS (SELECT l, any_value(n) AS n, any_value(x) AS x FROM hit GROUP BY l),
   tot AS (SELECT min(l) AS l, CAST(sum(n) AS INTEGER) AS n, CAST(sum(x) + 1 AS INTEGER) AS x FROM parts),
   old AS (SELECT key FROM recurring.st WHERE l IN (SELECT l FROM parts) UNION SELECT a FROM m)
   SELECT key, tot.l, tot.n, tot.x, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM old, tot
   UNION ALL SELECT '#' || CAST(cur.i AS VARCHAR), '', tot.n, tot.x, cur.i, (SELECT l FROM hit WHERE p), (SELECT n FROM hit WHERE p), (SELECT x FROM hit WHERE p) FROM cur, tot
   UNION ALL SELECT '#', '', 0, 0, cur.i, NULL, 0, 0 FROM cur WHERE cur.i <= (SELECT max(i) FROM steps)))
 SELECT s.transaction_id, {result} FROM steps s LEFT JOIN st ON st.key = '#' || CAST(s.i AS VARCHAR)"""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")
@pytest.mark.parametrize("name,of,result", [
    ("g07_cluster_history", "SELECT transaction_id, a, a = sender AS p FROM k_mem LEFT JOIN f_snd USING (transaction_id)",
     "'cluster_' || coalesce(st.pl, 'unknown') AS hist_cluster_id, coalesce(st.pn, 0) AS hist_cluster_size, coalesce(st.px, 0) AS hist_cluster_tx_count"),
    ("g09_component_growth", "SELECT DISTINCT transaction_id, a, false AS p FROM g_app", "coalesce(st.n + st.x, 1) AS hist_component_size")])
def test_queries_same_as_sequential_sql(spark, name, of, result):
    from ledgerscope.plans import oracles, registry
    plan = registry.plans()[name]
    con = duckdb.connect()
    for table in ("orders", "lineitem", "events", "customer"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = con.execute(oracles.sql(SEQUENTIAL.format(members=of, result=result)))
    names = [d[0] for d in found.description]
    assert sorted(map(tuple, plan(spark, FOLDER).select(*names).collect())) == sorted(found.fetchall())
