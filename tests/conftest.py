from __future__ import annotations

import pathlib
import sys
import tempfile

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from ledgerscope.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "2", "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-"),
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"), "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


TX_COLUMNS = ("transaction_id string, timestamp_epoch_sec bigint, input_count int, output_count int, total_input_value_satoshi bigint, "
              "total_output_value_satoshi bigint, fee_satoshi bigint, transaction_size_bytes int")


@pytest.fixture(scope="session")
def ledger(spark):
    """Build canonical tables from plain rows: (id, epoch, [(in address, value)], [(out address, value, change)])."""
    from pyspark.sql import functions as F

    def build(rows, events=()):
        tx, ins, outs = [], [], []
        for txid, ts, inputs, outputs in rows:
            total_in, total_out = sum(v for _, v in inputs), sum(v for _, v, _ in outputs)
            tx.append((txid, ts, len(inputs), len(outputs), total_in, total_out, max(total_in - total_out, 0), 250))
            ins += [(txid, i, a, v) for i, (a, v) in enumerate(inputs)]
            outs += [(txid, i, a, v, c) for i, (a, v, c) in enumerate(outputs)]
        frames = {
            "transactions": spark.createDataFrame(tx, TX_COLUMNS).withColumn("timestamp", F.timestamp_seconds("timestamp_epoch_sec")),
            "transaction_inputs": spark.createDataFrame(
                ins, "transaction_id string, input_index int, input_address string, input_value_satoshi bigint"),
            "transaction_outputs": spark.createDataFrame(
                outs, "transaction_id string, output_index int, output_address string, output_value_satoshi bigint, is_change boolean"),
            "network_events": spark.createDataFrame(
                list(events), "event_id string, transaction_id string, timestamp_epoch_sec bigint, src_ip string, src_port int, "
                              "dst_ip string, dst_port int, country string, asn bigint").withColumn(
                "timestamp", F.timestamp_seconds("timestamp_epoch_sec")),
        }
        return frames

    return build


@pytest.fixture(scope="session")
def random_rows():
    """A random stream with ties in time, a hub address, self payments and senderless transactions."""
    import random

    def make(seed: int, n: int = 40, addresses: int = 15):
        rng = random.Random(seed)
        rows = []
        for i in range(n):
            pick = lambda: "hub" if rng.random() < 0.3 else f"a{rng.randrange(addresses)}"
            ins = [] if rng.random() < 0.1 else [(pick(), rng.randrange(1000, 9000)) for _ in range(rng.randrange(1, 4))]
            outs = [(pick(), rng.randrange(500, 5000), rng.random() < 0.3) for _ in range(rng.randrange(1, 5))]
            rows.append((f"{rng.randrange(16 ** 6):06x}{i:03d}", 1_600_000_000 + rng.choice([0, 1, 1, 40, 3600, 90_000]) * rng.randrange(0, 9), ins, outs))
        return rows

    return make
