"""Registered queries against their SQL counterparts on the smallest tables."""

from __future__ import annotations

import os

import pytest

from ledgerscope.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = ["n11_address_rollup", "n07_nested_outputs", "q16_coverage", "f24_feature_matrix", "f26_chronological_split", "g04_degrees", "g05_g08_clusters",
          "g13_degree_distributions", "g23_address_neighbourhood", "t06_page", "t10_address_listing", "w03_map_points", "a05_a06_alerts", "m08_threshold_sweep",
          "e02_column_profile", "d03_anomaly_series", "s09_parquet_sink", "s15_dataset_delete", "s16_load_all_or_nothing", "w05_ipv6_enrichment", "f27_feature_manifest", "d01_top_addresses", "d04_class_distribution", "e08_degree_histograms", "t18_whole_timeline",
          "st3_distinct_events", "st4_address_history", "m18_feature_labels",
          "m26_feature_groups", "w05_w06_ip_enrichment", "g26_required_among_many", "st5_alert_upserts"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="bench tables are not here")


def test_every_statement_has_a_plan():
    plans, statements = registry.plans(), registry.statements()
    assert set(statements) <= set(plans) and len(plans) > 150


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(FOLDER)):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, duck, name):
    from scripts.check_queries import compare
    got = registry.plans()[name](spark, FOLDER).toPandas()
    want = duck.execute(registry.statements()[name]).df()
    verdict = compare(got, want)
    assert verdict == "ok" or set(p.split(": ")[1].startswith("float noise") for p in verdict.split("; ")) == {True}, verdict
