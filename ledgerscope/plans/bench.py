"""Frames shared by the registered queries, each written once per application and then scanned."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope import schemas
from ledgerscope.operators import alerts, features, graph, ingest
from ledgerscope.session import pin
from ledgerscope.sources import bench_tables

TX = "transaction_id"
ALERT_FEATURES = [c for c in alerts.EVIDENCE_FEATURES if c in schemas.MATRIX_FEATURES]
_CACHE: dict[tuple[str, str, str], DataFrame] = {}


class Bench:
    """The bench tables in canonical form plus the artifacts the reporting queries start from."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._tables = bench_tables.stored_tables(spark, self.folder)

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _CACHE:
            _CACHE[key] = pin(build(), name)
        return _CACHE[key]

    def laid_out(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A frame whose files are as they should be already: kept, not written again."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _CACHE:
            _CACHE[key] = build()
        return _CACHE[key]

    def source(self, name: str) -> DataFrame:
        """One of the given tables as it is."""
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def raw(self) -> dict[str, DataFrame]:
        return bench_tables.raw_tables(self.spark, self.folder)

    @property
    def tables(self) -> dict[str, DataFrame]:
        return self._tables

    @property
    def short(self) -> bench_tables.StoredTables:
        """The tables with short transaction ids in the same order, which make joins and sorts by transaction small."""
        return self._tables.short()

    @property
    def tx(self) -> DataFrame:
        return self._tables["transactions"]

    @property
    def ins(self) -> DataFrame:
        return self._tables["transaction_inputs"]

    @property
    def outs(self) -> DataFrame:
        return self._tables["transaction_outputs"]

    @property
    def net(self) -> DataFrame:
        return self._tables["network_events"]

    @property
    def labels(self) -> DataFrame:
        return self._tables["labels"]

    @property
    def results(self) -> DataFrame:
        return self._tables["results"]

    def run(self, analysis_id: str = "an1") -> DataFrame:
        return self.results.where(F.col("analysis_id") == analysis_id)

    @property
    def addresses(self) -> DataFrame:
        return self.stored("addresses", lambda: ingest.address_rollup(*money(self.short)))

    @property
    def timeline(self) -> DataFrame:
        """Has short transaction ids."""
        return self.laid_out("timeline", lambda: features.address_timeline(*money(self.short)))

    @property
    def features(self) -> DataFrame:
        return self.stored("features", lambda: bench_tables.full_ids(features.feature_matrix(self.short, self.timeline)))

    @property
    def graph_features(self) -> DataFrame:
        return self.stored("graph_features", lambda: bench_tables.full_ids(graph.graph_features(self.short, self.timeline)))

    @property
    def edges(self) -> DataFrame:
        return self.stored("edges", lambda: graph.edges(self.tx, self.ins, self.outs))

    @property
    def nodes(self) -> DataFrame:
        return self.stored("nodes", lambda: graph.node_table(self.tx, self.edges))

    @property
    def weak(self) -> DataFrame:
        return self.stored("weak", lambda: graph.weak_components(self.edges))

    @property
    def clusters(self) -> DataFrame:
        return self.stored("clusters", lambda: graph.final_clusters(self.tx, self.ins, self.outs))

    @property
    def payment_groups(self) -> DataFrame:
        return self.stored("payment_groups", lambda: graph.payment_components(self.ins, self.outs))

    @property
    def split(self) -> DataFrame:
        """Time, labels and split of every labelled transaction."""
        return self.stored("split", lambda: features.chronological_split(
            self.tx.select(TX, "timestamp_epoch_sec").join(self.labels, TX)))

    @property
    def modelling(self) -> DataFrame:
        return self.stored("modelling", lambda: features.modelling_table(
            self.features, self.graph_features, self.tx, self.labels).join(self.split.select(TX, "temporal_split"), TX))

    @property
    def scored(self) -> DataFrame:
        """Result rows of the first run with truth and split, as model output to be measured."""
        return self.run().select(F.col("entity_id").alias(TX), "risk_score", "prediction_label", "confidence").join(
            self.split, TX)

    @property
    def attributed_risk(self) -> DataFrame:
        run = self.short["results"].where(F.col("analysis_id") == "an1")
        return graph.attributed_risk(self.addresses, *money(self.short)[1:], run)

    @property
    def alert_features(self) -> DataFrame:
        """What alerts read of the feature matrix. Has short transaction ids."""
        return self.stored("alert_features", lambda: features.feature_columns(self.short, ALERT_FEATURES))

    @property
    def alert_history(self) -> DataFrame:
        """What alerts read of the graph features. Has short transaction ids."""
        return self.stored("alert_history", lambda: graph.alert_history(self.short))

    def candidates(self, features_: DataFrame) -> DataFrame:
        """Alert candidates of the first run; ``features_`` has short transaction ids."""
        rows = alerts.scored_rows(self.short["results"], features_, self.short["transactions"], "an1")
        return alerts.classify(alerts.signals(bench_tables.full_ids(rows)))

    @property
    def tabular_candidates(self) -> DataFrame:
        return self.candidates(with_empty_graph(self.alert_features))

    @property
    def tabular_alerts(self) -> DataFrame:
        """Alerts of the first run from the tabular features alone."""
        return self.stored("alerts", lambda: alerts.group(self.tabular_candidates, "an1", "bench"))


def money(tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tables["transactions"], tables["transaction_inputs"], tables["transaction_outputs"]


def with_empty_graph(features_: DataFrame) -> DataFrame:
    """Features without graph history, for queries that only need the tabular signals."""
    return features_.select("*", F.lit(None).cast("bigint").alias("hist_component_size"),
                            F.lit(None).cast("double").alias("hist_address_reuse_ratio"),
                            F.lit(None).cast("bigint").alias("hist_cluster_size"),
                            F.lit(None).cast("bigint").alias("hist_cluster_tx_count"))
