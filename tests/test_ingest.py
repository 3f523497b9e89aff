"""Uploads, readers, sinks, cleaning and quality rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerscope import schemas
from ledgerscope.operators import clean, features, ingest, quality
from ledgerscope.sources import readers, sinks

HEX = "ab" * 32


def one(df):
    return df.first().asDict()


@pytest.fixture()
def nested_csv(tmp_path):
    path = tmp_path / "up.csv"
    path.write_text(
        "TXID,timestamp,input_addresses,input_amounts,output_addresses,output_amounts,fee,src_ip,src_port,dst_ip,dst_port,country,asn\n"
        "t1,2026-01-01T00:00:00+00:00,\"['a', 'b']\",\"[10, 20]\",\"['c']\",\"[25]\",5,1.1.1.1,1000,2.2.2.2,8333, us ,AS77\n"
        "t2,1767225600,\"['c']\",\"[25]\",\"['d', 'e']\",\"[20]\",0.00000005,1.1.1.1,x,2.2.2.2,8333,de,-1\n")
    return str(path)


def test_nested_csv(spark, nested_csv):
    t = ingest.ingest(readers.read_upload(spark, nested_csv), "d1")
    tx = {r["transaction_id"]: r for r in t["transactions"].collect()}
    assert (tx["t1"]["input_count"], tx["t1"]["total_input_value_satoshi"], tx["t1"]["fee_satoshi"]) == (2, 30, 5)
    assert tx["t1"]["timestamp"] == tx["t2"]["timestamp"]
    assert tx["t2"]["fee_satoshi"] == 5
    outs = sorted((r["output_id"], r["output_address"], r["output_value_satoshi"]) for r in t["transaction_outputs"].collect())
    assert outs == [("t1:0", "c", 25), ("t2:0", "d", 20)]  # lists are cut to the shorter one
    net = {r["transaction_id"]: r for r in t["network_events"].collect()}
    assert (net["t1"]["asn"], net["t1"]["country"], net["t2"]["asn"], net["t2"]["src_port"]) == (77, "US", None, None)
    addr = {r["address_id"]: r for r in t["addresses"].collect()}
    assert (addr["c"]["total_received_satoshi"], addr["c"]["total_sent_satoshi"], addr["c"]["transaction_count"]) == (25, 25, 2)
    s = one(ingest.ingest_summary(ingest.Upload(readers.read_upload(spark, nested_csv), "d1"), t))
    assert s["rejected_rows"] == 0 and s["network_analysis"] and s["address_count"] == 4


def test_json_and_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"hash": "t1", "value": 5}\n{"hash": "t2", "value": 6}\n')
    (tmp_path / "b.json").write_text('[{"hash": "t1", "value": "1.5"},\n {"hash": null, "value": "7"}]')
    assert readers.read_upload(spark, str(tmp_path / "a.jsonl")).count() == 2
    tx = ingest.transactions(ingest.Upload(readers.read_upload(spark, str(tmp_path / "b.json")), "d")).collect()
    assert [(r["transaction_id"], r["total_output_value_satoshi"]) for r in tx] == [("t1", 150_000_000)]
    with pytest.raises(ValueError):
        readers.read_upload(spark, "x.xlsx")


def test_surrogate_ids_are_stable(spark):
    raw = spark.createDataFrame([("5", "a"), ("6", "b")], "value string, sender string")
    ids = lambda: sorted(r[0] for r in ingest.transactions(ingest.Upload(raw, "d")).select("transaction_id").collect())
    assert ids() == ids() and len(set(ids())) == 2


def test_directory_with_missing_tables_and_consolidated_file(spark, tmp_path):
    row = [("T1 ", None, ["a"], [10], ["b", "c"], [4], 6, "p", " 1.1.1.1", 1, "2.2.2.2", 2, "us", "AS5", "scn")]
    schema = ("txid string, timestamp timestamp, input_addresses array<string>, input_amounts array<bigint>, output_addresses array<string>, "
              "output_amounts array<bigint>, fee bigint, script_type string, src_ip string, src_port int, dst_ip string, dst_port int, "
              "country string, asn string, scenario_id string")
    spark.createDataFrame(row, schema).write.parquet(str(tmp_path / "sih_transactions.parquet"))
    found = readers.read_table_directory(spark, str(tmp_path))
    assert found["labels"].count() == 0 and found["labels"].schema == schemas.RAW_LABELS
    t = clean.decompose_consolidated(found["consolidated"], "d")
    tx = one(t["transactions"])
    assert (tx["transaction_id"], tx["output_count"], tx["transaction_size_bytes"]) == ("t1", 2, 10 + 148 + 68)
    assert t["transaction_outputs"].count() == 1
    assert one(t["network_events"])["asn"] == 5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "d1"), ("b", 2, "d2")], "k string, v int, dataset_id string")
    sinks.write_tables({"t": df}, str(tmp_path / "w"), sort_by={"t": ["k"]})
    back = spark.read.parquet(str(tmp_path / "w" / "t.parquet"))
    assert readers.read_dataset({"t": back}, "d1")["t"].count() == 1
    new = spark.createDataFrame([("b", 9, "d2"), ("c", 3, "d1")], "k string, v int, dataset_id string")
    assert sorted((r["k"], r["v"]) for r in sinks.upsert(df, new, ["k"]).collect()) == [("a", 1), ("b", 9), ("c", 3)]
    target = str(tmp_path / "table")
    df.write.parquet(target)
    for _ in range(2):  # reading and replacing the same files, twice
        sinks.overwrite_through_staging(sinks.replace_by_key(spark.read.parquet(target), new, ["k"]), target)
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(target).collect()) == [("a", 1), ("b", 9), ("c", 3)]
    runs = spark.createDataFrame([("d1", "running")], "dataset_id string, status string")
    with pytest.raises(RuntimeError):
        sinks.delete_dataset({"t": df}, "d1", runs)
    assert sinks.delete_dataset({"t": df}, "d2", runs)["t"].count() == 1


def test_all_or_nothing_load(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    spark.range(3).write.parquet(f"{src}/a.parquet")
    with pytest.raises(FileNotFoundError):
        sinks.load_all_or_nothing(spark, src, dst, ["a", "b"])
    assert not readers.path_exists(spark, dst)
    spark.range(4).write.parquet(f"{src}/b.parquet")
    got = {r["table_name"]: r["n_rows"] for r in sinks.load_all_or_nothing(spark, src, dst, ["a", "b"]).collect()}
    assert got == {"a": 3, "b": 4}
    sinks.write_json_summary(spark.createDataFrame([(1, [2, 3])], "a int, b array<int>"), str(tmp_path / "s"))
    assert one(spark.read.json(str(tmp_path / "s")))["b"] == [2, 3]


def test_dataset_files(spark, tmp_path):
    for n in ("transactions.csv", "network_events.csv", "notes.txt"):
        (tmp_path / n).write_text("a,b\n1,2\n")
    found = readers.find_dataset_files(spark, str(tmp_path))
    assert found["transactions"].endswith("transactions.csv") and found["network_events"].endswith("network_events.csv")
    assert readers.find_dataset_files(spark, str(tmp_path / "none")) == {}


def raw_set(spark, **changes):
    tx = {"txid": HEX, "block_height": 1, "timestamp": "2026-01-01 00:00:00", "input_count": 1, "output_count": 1, "total_input_value_satoshi": 100,
          "total_output_value_satoshi": 90, "fee_satoshi": 10, "transaction_size_bytes": 200, "script_type": "p", **changes}
    schema = schemas.RAW_TRANSACTIONS
    cols = ", ".join(f"{f.name} {f.dataType.simpleString() if f.name != 'timestamp' else 'string'}" for f in schema.fields)
    return {
        "transactions": spark.createDataFrame([tuple(tx[f.name] for f in schema.fields)], cols).withColumn("timestamp", F.col("timestamp").cast("timestamp")),
        "transaction_inputs": spark.createDataFrame([(HEX, 0, "a", 100, None, None)], schemas.RAW_INPUTS),
        "transaction_outputs": spark.createDataFrame([(HEX, 0, "b", 90, "p", False)], schemas.RAW_OUTPUTS),
        "network_events": spark.createDataFrame([("e1", HEX, None, "1.1.1.1", 1, "2.2.2.2", 8333, "US", 5)], schemas.RAW_NETWORK_EVENTS),
    }


@pytest.mark.parametrize("changes,rule", [({"fee_satoshi": 11}, "tx_header_conservation"), ({"txid": "zz"}, "tx_id_format"),
                                          ({"total_output_value_satoshi": 89, "fee_satoshi": 11}, "conservation_outputs")])
def test_faults_are_found(spark, changes, rule):
    quality.require_valid(quality.validation_report(raw_set(spark)))
    with pytest.raises(quality.ValidationFailed, match=rule):
        quality.require_valid(quality.validation_report(raw_set(spark, **changes)))


def test_quarantine_and_missing_columns(spark):
    df = spark.createDataFrame([("t", 1, "s", True)], "txid string, v int, scenario_id string, has_network_anomaly boolean")
    kept, side = clean.quarantine(df)
    assert kept.columns == ["txid", "v"] and side.columns == ["txid", "scenario_id", "has_network_anomaly"]
    with pytest.raises(ValueError):
        quality.feature_audit(df, ["v"])
    with pytest.raises(ValueError, match="input_address"):
        clean.alias_columns(df, ["input_address"])
    assert quality.missing_columns(df, ["txid", "w"]) == ["w"]
    full = features.require_features(df, ["v", "net_country", "x"])
    assert one(full)["net_country"] == "UNKNOWN" and one(full)["x"] == 0.0


def test_null_addresses_stay_null(spark):
    raw = raw_set(spark)
    raw["transaction_inputs"] = spark.createDataFrame([(HEX, 0, None, 100, None, None)], schemas.RAW_INPUTS)
    assert one(clean.clean(raw)["transaction_inputs"])["address"] is None


def test_catalog_tables(spark):
    df = spark.createDataFrame([(HEX, 0, "a", 100, None, None)], schemas.RAW_INPUTS)
    sinks.register_tables({"transaction_inputs": df}, bucket_by={"transaction_inputs": (2, "txid")})
    sinks.register_tables({"transaction_inputs": df.unionByName(df)})
    found = readers.read_catalog_tables(spark)
    assert found["transaction_inputs"].count() == 2 and found["labels"].count() == 0
    spark.sql("DROP TABLE transaction_inputs")
