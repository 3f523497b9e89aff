"""Preprocessing, training, scoring and explanation on Spark ML."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope import schemas
from ledgerscope.functions import exprs as X
from ledgerscope.functions.ordering import exact_percentiles, global_positions, unpivot
from ledgerscope.operators import metrics, quality
from ledgerscope.session import pin, shared_folder
from ledgerscope.sources.sinks import replace_by_key

TX = "transaction_id"
CATEGORICAL = ["net_country", "net_asn"]
GRAPH_MODEL_FEATURES = [
    "hist_in_mean_neighbor_degree", "hist_out_mean_neighbor_degree", "hist_component_size", "hist_address_reuse_ratio",
    "hist_cluster_size", "hist_cluster_tx_count",
]
NUMERIC = [c for c in schemas.MATRIX_FEATURES if c not in CATEGORICAL] + GRAPH_MODEL_FEATURES
MODEL_FEATURES = NUMERIC + CATEGORICAL

# Fixed values: (display name, unit) of every model feature, in matrix order.
DISPLAY = {
    "tx_input_count": ("Input count", "count"),
    "tx_output_count": ("Output count", "count"),
    "tx_input_output_ratio": ("Input/output ratio", "ratio"),
    "tx_total_input_sats": ("Total input value", "sats"),
    "tx_total_output_sats": ("Total output value", "sats"),
    "tx_fee_sats": ("Transaction fee", "sats"),
    "tx_size_bytes": ("Transaction size", "bytes"),
    "tx_fee_rate_sat_per_byte": ("Fee rate", "sat/byte"),
    "tx_value_balance_ratio": ("Value balance ratio", "ratio"),
    "tx_avg_input_value_sats": ("Average input value", "sats"),
    "tx_max_input_value_sats": ("Max input value", "sats"),
    "tx_avg_output_value_sats": ("Average output value", "sats"),
    "tx_max_output_value_sats": ("Max output value", "sats"),
    "tx_log_total_value": ("Log total value", "log_sats"),
    "tx_log_fee": ("Log fee", "log_sats"),
    "addr_hist_tx_count": ("Historical address transaction count", "count"),
    "addr_hist_total_sent_sats": ("Total sent by address", "sats"),
    "addr_hist_total_received_sats": ("Total received by address", "sats"),
    "addr_hist_avg_tx_val_sats": ("Average transaction value for address", "sats"),
    "addr_hist_unique_counterparties": ("Unique counterparties", "count"),
    "addr_hist_active_days": ("Active days for address", "days"),
    "addr_hist_tx_per_day": ("Transaction velocity", "tx/day"),
    "addr_reuse_count": ("Address reuse count", "count"),
    "time_hour_of_day": ("Hour of day", "hour"),
    "time_day_of_week": ("Day of week", "day"),
    "time_since_prev_global_tx_sec": ("Time since previous global tx", "sec"),
    "time_txs_last_1m": ("Transactions in last 1 minute", "count"),
    "time_txs_last_5m": ("Transactions in last 5 minutes", "count"),
    "time_txs_last_1h": ("Transactions in last 1 hour", "count"),
    "time_since_prev_addr_tx_sec": ("Time since previous address tx", "sec"),
    "net_src_port": ("Network source port", "port"),
    "net_dst_port": ("Network destination port", "port"),
    "net_is_standard_bitcoin_port": ("Standard Bitcoin peer port flag", "bool"),
    "net_hist_unique_ips_for_addr": ("Historical unique IPs for address", "count"),
    "rel_fan_in": ("Relational fan-in degree", "count"),
    "rel_fan_out": ("Relational fan-out degree", "count"),
    "rel_has_change_output": ("Has change output", "bool"),
    "rel_change_value_ratio": ("Change value ratio", "ratio"),
    "hist_in_mean_neighbor_degree": ("Mean incoming neighbor degree", "degree"),
    "hist_out_mean_neighbor_degree": ("Mean outgoing neighbor degree", "degree"),
    "hist_component_size": ("Connected component size", "nodes"),
    "hist_address_reuse_ratio": ("Address reuse ratio", "ratio"),
    "hist_cluster_size": ("Entity cluster size", "addresses"),
    "hist_cluster_tx_count": ("Entity cluster transaction count", "count"),
    "net_country": ("Network peer country code", "country"),
    "net_asn": ("Autonomous system number", "ASN"),
}


def display_name(feature: str) -> tuple[str, str | None]:
    return DISPLAY.get(feature, (feature.replace("_", " ").title(), None))


# ---- preprocessing -----------------------------------------------------------------------------

def robust_statistics(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exact median and inter-quartile range per feature."""
    q = exact_percentiles(unpivot(train, features), ["feature"], "value", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    iqr = F.col("p75") - F.col("p25")
    return q.select("feature", "median", iqr.alias("iqr"), F.when(iqr == 0, 1.0).otherwise(iqr).alias("scale"))


def robust_scale(rows: DataFrame, statistics: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scale features by statistics fitted elsewhere. The statistics are one row of known width, so it is broadcast."""
    wide = statistics.agg(*[c for f in features for c in (
        F.max(F.when(F.col("feature") == f, F.col("median"))).alias(f"_m_{f}"),
        F.max(F.when(F.col("feature") == f, F.col("scale"))).alias(f"_s_{f}"))])
    joined = rows.withColumn("_j", F.lit(1)).join(F.broadcast(wide.withColumn("_j", F.lit(1))), "_j")
    return joined.select(*[
        ((F.col(c).cast("double") - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(c) if c in features else F.col(c)
        for c in rows.columns])


def complete(rows: DataFrame) -> DataFrame:
    """Model input without gaps: numbers 0, country UNKNOWN, categories as text."""
    return rows.select(
        *[c for c in rows.columns if c not in MODEL_FEATURES],
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in NUMERIC if c in rows.columns],
        *[F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")).alias(c) for c in CATEGORICAL if c in rows.columns])


def one_hot_stages(columns: Sequence[str]) -> list:
    """Category encoding; a value not seen in training becomes the zero vector."""
    return [StringIndexer(inputCols=list(columns), outputCols=[f"{c}_ix" for c in columns], handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"{c}_ix" for c in columns], outputCols=[f"{c}_oh" for c in columns], dropLast=True)]


def assemble_stages(features: Sequence[str]) -> list:
    cats = [c for c in features if c in CATEGORICAL]
    nums = [c for c in features if c not in CATEGORICAL]
    stages = one_hot_stages(cats) if cats else []
    return stages + [VectorAssembler(inputCols=nums + [f"{c}_oh" for c in cats], outputCol="vector", handleInvalid="keep")]


# ---- training and selection --------------------------------------------------------------------

def with_class_weight(train: DataFrame, label: str) -> DataFrame:
    """Balance the classes: positives weigh negatives / positives."""
    weight = metrics.class_weight(train, label).select(F.col("pos_weight").alias("_w"), F.lit(1).alias("_j"))
    joined = train.withColumn("_j", F.lit(1)).join(F.broadcast(weight), "_j").drop("_j")
    return joined.withColumn("class_weight", F.when(F.col(label) == 1, F.coalesce("_w", F.lit(1.0))).otherwise(1.0)).drop("_w")


def binary_candidates(label: str, seed: int = 42) -> dict[str, object]:
    common = dict(featuresCol="vector", labelCol=label, weightCol="class_weight")
    return {
        "logistic": LogisticRegression(maxIter=50, regParam=0.01, **common),
        "random_forest": RandomForestClassifier(numTrees=50, maxDepth=8, seed=seed, **common),
        "boosted_shallow": GBTClassifier(maxIter=20, maxDepth=4, seed=seed, **common),
        "boosted_deep": GBTClassifier(maxIter=30, maxDepth=5, seed=seed, **common),
    }


def fit(train: DataFrame, label: str, estimator: object, features: Sequence[str] = tuple(MODEL_FEATURES)):
    """Fit encoding, assembly and estimator as one pipeline on the training rows only."""
    return Pipeline(stages=[*assemble_stages(features), estimator]).fit(with_class_weight(complete(train), label))


def fit_multiclass(train: DataFrame, label: str = "behavior_type", features: Sequence[str] = tuple(MODEL_FEATURES),
                   trees: int = 40, seed: int = 42):
    index = StringIndexer(inputCol=label, outputCol="class_ix", handleInvalid="skip", stringOrderType="alphabetAsc")
    forest = RandomForestClassifier(featuresCol="vector", labelCol="class_ix", numTrees=trees, maxDepth=8, seed=seed)
    return Pipeline(stages=[index, *assemble_stages(features), forest]).fit(complete(train))


class BoostedClasses:
    """One boosted model per class against the rest; probabilities are normalised over the classes."""

    def __init__(self, encoding, classes: Sequence[str], models: Sequence[GBTClassificationModel]) -> None:
        self.encoding, self.classes, self.models = encoding, list(classes), list(models)

    def transform(self, rows: DataFrame, out: str = "class_probability") -> DataFrame:
        """Add ``out``, the probabilities in the order of ``classes``."""
        scored = self.encoding.transform(rows)
        columns = scored.columns
        for i, model in enumerate(self.models):
            for name in ("rawPrediction", "probability", "prediction"):
                scored = scored.drop(name)
            scored = model.transform(scored).withColumn(f"_p{i}", vector_to_array("probability")[1])
        parts = [F.col(f"_p{i}") for i in range(len(self.models))]
        total = F.greatest(reduce(lambda a, b: a + b, parts), F.lit(1e-300))
        return scored.select(*columns, F.array(*[p / total for p in parts]).alias(out))


def fit_boosted_classes(train: DataFrame, label: str = "behavior_type", features: Sequence[str] = tuple(MODEL_FEATURES), rounds: int = 10,
                        depth: int = 4, seed: int = 42) -> BoostedClasses:
    """Boosted models of all classes found in ``train``, over features encoded and assembled once. The number of classes is that of the label."""
    ready = complete(train).where(F.col(label).isNotNull())
    encoding = Pipeline(stages=assemble_stages(features)).fit(ready)
    rows = pin(encoding.transform(ready).select("vector", label), "class-rows")
    classes = [r[0] for r in rows.select(label).distinct().orderBy(label).collect()]
    models = []
    for c in classes:
        target = rows.select("vector", (F.col(label) == c).cast("double").alias("_y"))
        models.append(GBTClassifier(featuresCol="vector", labelCol="_y", maxIter=rounds, maxDepth=depth, seed=seed).fit(target))
    return BoostedClasses(encoding, classes, models)


def class_quality(rows: DataFrame, classes: Sequence[str], probability: str, label: str = "behavior_type") -> DataFrame:
    """Accuracy, macro and weighted F1 and log loss of class probabilities; a label the model doesn't know counts as missed."""
    names = F.array(*[F.lit(c) for c in classes])
    p = F.col(probability)
    at = F.array_position(names, F.col(label))
    judged = pin(rows.select(F.col(label), F.element_at(names, F.array_position(p, F.array_max(p)).cast("int")).alias("_guess"),
                             F.when(at > 0, F.element_at(p, F.greatest(at, F.lit(1)).cast("int"))).otherwise(0.0).alias("_own")), "judged")
    summary = metrics.multiclass_summary(metrics.multiclass_report(judged, label, "_guess"))
    return summary.crossJoin(F.broadcast(metrics.log_loss(judged, "_own")))  # one row each


def positive_probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn("risk_score", X.clip(vector_to_array("probability")[1], 0.0, 1.0))


def select_model(rows: Mapping[str, tuple[float, float]]) -> str:
    """Name of the candidate with the best (ROC-AUC, PR-AUC)."""
    return max(sorted(rows), key=lambda name: rows[name])


def score(rows: DataFrame, binary, multiclass, analysis_id: str, dataset_id: str, model_version: str = "1",
          keep: Sequence[str] = ()) -> DataFrame:
    """Result rows: risk probability and level from one model, class and confidence from the other."""
    base = positive_probability(binary.transform(complete(rows))).select(TX, *keep, "risk_score", *MODEL_FEATURES)
    classes = multiclass.stages[0].labels
    typed = multiclass.stages[1:]
    out = base
    for stage in typed:
        out = stage.transform(out)
    p = vector_to_array(F.col("probability"))
    top = F.array_max(p)
    labels = F.array(*[F.lit(c) for c in classes])
    return out.select(
        F.substring(F.sha2(F.concat_ws(":", F.lit(analysis_id), TX), 256), 1, 32).alias("result_id"),
        F.lit(analysis_id).alias("analysis_id"), F.lit(dataset_id).alias("dataset_id"), F.col(TX).alias("entity_id"),
        F.lit("transaction").alias("entity_type"), "risk_score", X.risk_level("risk_score").alias("risk_level"),
        F.element_at(labels, F.array_position(p, top).cast("int")).alias("prediction_label"), top.alias("confidence"),
        F.lit(model_version).alias("model_version"), *keep)


def persist_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """Write contract: refuse any broken row, then replace by (analysis, entity, type)."""
    quality.require_valid(quality.result_rules(new))
    return replace_by_key(old, new, ["analysis_id", "entity_id", "entity_type"])


def run_scorer(frame: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a user's scorer and check its rows; this is the hook for custom models and pandas UDFs."""
    out = scorer(frame)
    missing = quality.missing_columns(out, ["entity_id", "entity_type", "risk_score", "risk_level", "confidence"])
    if missing:
        raise ValueError(f"scorer result lacks columns: {', '.join(missing)}")
    quality.require_valid(quality.result_rules(out))
    return out


def run_summary(results: DataFrame, analysis_id: str | None = None) -> DataFrame:
    """Entities, high and critical counts; the score decides where a level is missing."""
    rows = results if analysis_id is None else results.where(F.col("analysis_id") == analysis_id)
    level = F.coalesce("risk_level", X.risk_level("risk_score"))
    return rows.groupBy("analysis_id").agg(
        F.count(F.lit(1)).alias("entity_count"), F.count(F.when(level == "high", 1)).alias("high_risk_count"),
        F.count(F.when(level == "critical", 1)).alias("critical_risk_count"))


# ---- explanation -------------------------------------------------------------------------------

def explain_rows(rows: DataFrame, features: Sequence[str], contributions: Column, values: Column, k: int = 5) -> DataFrame:
    """The k largest contributions of each row, ranked, with share, direction, name and value."""
    names = F.array(*[F.lit(f) for f in features])
    shown = F.array(*[F.lit(display_name(f)[0]) for f in features])
    units = F.array(*[F.lit(display_name(f)[1]).cast("string") for f in features])
    zipped = F.arrays_zip(names.alias("f"), contributions.alias("c"), values.alias("v"), shown.alias("d"), units.alias("u"))
    entries = F.transform(zipped, lambda e: F.struct(
        (-F.abs(e["c"])).alias("o"), e["f"].alias("feature_name"), e["c"].alias("contribution"),
        e["v"].alias("feature_value"), e["d"].alias("display_label"), e["u"].alias("feature_unit")))
    total = F.aggregate(contributions, F.lit(0.0), lambda a, x: a + F.abs(x))
    return ranked_rows(rows.select(TX, total.alias("_t"), F.posexplode(F.slice(F.array_sort(entries), 1, k)).alias("_r", "e")))


def ranked_rows(ranked: DataFrame, key: str = TX) -> DataFrame:
    """Explanation rows from entries ``e`` at place ``_r`` of their row, whose contributions have the absolute sum ``_t``."""
    c = F.col("e.contribution")
    return ranked.select(
        key, (F.col("_r") + 1).alias("importance_rank"), "e.feature_name", c.alias("contribution"),
        F.when(F.col("_t") > 0, F.abs(c) / F.col("_t")).otherwise(0.0).alias("normalized_importance"),
        F.when(c > 0, "increases_risk").when(c < 0, "decreases_risk").otherwise("neutral").alias("direction"),
        "e.display_label", "e.feature_unit", "e.feature_value")


def global_importance(rows: DataFrame, features: Sequence[str], contributions: Column, top: int = 20) -> DataFrame:
    """Mean absolute contribution per feature, largest first. Averages are taken per column, not per exploded row."""
    wide = rows.agg(*[F.avg(F.abs(contributions[i])).alias(f"c{i}") for i in range(len(features))])
    rows_ = F.array(*[F.struct(F.lit(f).alias("feature_name"), F.col(f"c{i}").alias("mean_abs_contribution"))
                      for i, f in enumerate(features)])
    return wide.select(F.inline(rows_)).orderBy(F.desc("mean_abs_contribution"), "feature_name").limit(top)


def linear_contributions(coefficients: Sequence[float], means: Mapping[str, float], features: Sequence[str]) -> Column:
    """Contribution of each feature to a linear score: coefficient times distance from the mean."""
    return F.array(*[(F.col(f).cast("double") - F.lit(float(means[f]))) * F.lit(float(b))
                     for f, b in zip(features, coefficients)])


def read_trees(model) -> list[tuple[float, dict[int, tuple]]]:
    """(weight, node table) per tree, read from the saved model; its size is fixed by trees and depth."""
    spark = SparkSession.active()
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    weights = list(model.treeWeights)
    nodes: list[dict[int, tuple]] = [{} for _ in weights]
    saved = spark.read.parquet(f"{path}/data")
    body = "nodeData." if "nodeData" in saved.columns else ""
    for r in saved.select("treeID", *[F.col(f"{body}{c}").alias(c) for c in (
            "id", "prediction", "impurityStats", "leftChild", "rightChild", "split")]).collect():
        s = r["split"]
        nodes[r["treeID"]][r["id"]] = (r["prediction"], list(r["impurityStats"]), r["leftChild"], r["rightChild"],
                                       s["featureIndex"], list(s["leftCategoriesOrThreshold"]), s["numCategories"])
    return list(zip(weights, nodes))


def tree_contributions(scored: DataFrame, model, n_features: int, vector: str = "vector", key: str = TX) -> DataFrame:
    """Additive contributions of every vector slot to a tree ensemble's raw score, plus the base value.

    Along each row's path the change in node value is credited to the feature that split there, so base
    plus contributions equals the ensemble's score: the margin for boosted trees, the mean positive
    share for forests. The node tables are small and fixed in size; rows stay partitioned.
    """
    forest = isinstance(model, RandomForestClassificationModel)
    if not forest and not isinstance(model, GBTClassificationModel):
        raise TypeError("a tree ensemble is needed")
    trees = read_trees(model)
    if forest:
        trees = [(1.0 / len(trees), t) for _, t in trees]

    def value(node: tuple) -> float:
        if forest:
            total = sum(node[1])
            return node[1][1] / total if total else 0.0
        return node[0]

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), n_features)
            out = np.zeros((len(pdf), n_features))
            base = 0.0
            for weight, nodes in trees:
                base += weight * value(nodes[0])
                stack = [(0, np.arange(len(pdf)))]
                while stack:
                    at, rows = stack.pop()
                    node = nodes[at]
                    if node[2] < 0 or not len(rows):
                        continue
                    column = x[rows, node[4]]
                    left = np.isin(column, node[5]) if node[6] >= 0 else column <= node[5][0]
                    for child, chosen in ((node[2], rows[left]), (node[3], rows[~left])):
                        out[chosen, node[4]] += weight * (value(nodes[child]) - value(node))
                        stack.append((child, chosen))
            yield pd.DataFrame({key: pdf[key], "base": base, "contributions": list(out)})

    return scored.select(key, vector_to_array(vector).alias("x")).mapInPandas(
        attribute, f"{key} string, base double, contributions array<double>")


def vector_names(model, features: Sequence[str]) -> list[str]:
    """Names of the assembled vector's slots: numeric features, then one per category."""
    cats = [c for c in features if c in CATEGORICAL]
    names = [c for c in features if c not in CATEGORICAL]
    if cats:
        indexer = next(s for s in model.stages if s.__class__.__name__ == "StringIndexerModel" and s.getOutputCols()[0] == f"{cats[0]}_ix")
        for c, labels in zip(cats, indexer.labelsArray):
            names += [f"{c}={v}" for v in labels]
    return names


def tree_importance(spark, model, names: Sequence[str], top: int = 20) -> DataFrame:
    """Split-gain importance of a fitted ensemble."""
    values = model.featureImportances.toArray().tolist()
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "feature_name string, importance double").orderBy(
        F.desc("importance"), "feature_name").limit(top)


def graph_evidence(rows: DataFrame) -> DataFrame:
    """Graph-derived evidence rows with text."""
    size, comp = (F.coalesce(F.col(c).cast("bigint"), F.lit(1)) for c in ("hist_cluster_size", "hist_component_size"))
    reuse = F.coalesce("hist_address_reuse_ratio", F.lit(0.0))
    fin, fout = (F.coalesce(F.col(c).cast("bigint"), F.lit(1)) for c in ("rel_fan_in", "rel_fan_out"))

    def entry(kind: str, label: str, feature: str, value: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("evidence_type"), F.lit(label).alias("label"), F.lit(feature).alias("feature_name"),
                        value.cast("double").alias("value"), text.alias("description"))

    return rows.select(TX, F.inline(F.array(
        entry("entity_cluster", "Behavioral Cluster Size", "hist_cluster_size", size, F.format_string(
            "Transaction belongs to an entity cluster of %d associated addresses.", size)),
        entry("graph_metric", "Connected Component Size", "hist_component_size", comp, F.format_string(
            "Weakly connected component size in bipartite transaction network is %d nodes.", comp)),
        entry("graph_metric", "Address Reuse Ratio", "hist_address_reuse_ratio", reuse, F.format_string(
            "Historical address reuse ratio across input addresses is %.2f%%.", reuse * 100)),
        entry("relational", "Fan In Degree", "rel_fan_in", fin, F.format_string(
            "Transaction aggregates funds across %d input addresses.", fin)),
        entry("relational", "Fan Out Degree", "rel_fan_out", fout, F.format_string(
            "Transaction disperses outputs across %d destination addresses.", fout)))))


# ---- audits ------------------------------------------------------------------------------------

PORTS = ["net_src_port", "net_dst_port", "net_is_standard_bitcoin_port"]
# The ablation sets by name; "-" drops the listed features, "+" keeps only them.
ABLATIONS: dict[str, tuple[str, list[str]]] = {
    "A full": ("-", []), "B no change ratio": ("-", ["rel_change_value_ratio"]), "C no ports": ("-", PORTS),
    "D no temporal": ("-", schemas.TIME_FEATURES), "E no graph": ("-", GRAPH_MODEL_FEATURES),
    "F transaction only": ("+", schemas.TX_FEATURES), "G graph only": ("+", GRAPH_MODEL_FEATURES),
    "H single feature": ("+", ["rel_change_value_ratio"]),
}


def ablation_features(name: str) -> list[str]:
    mode, listed = ABLATIONS[name]
    return [f for f in MODEL_FEATURES if (f in listed) == (mode == "+")]


def ablation_runs(rows: DataFrame, label: str, split: str, estimator: Callable[[], object],
                  names: Sequence[str] = tuple(ABLATIONS)) -> DataFrame:
    """Validation ROC/PR per feature subset and the drop against the first. One distributed fit per subset."""
    train, val = rows.where(F.col(split) == "train"), rows.where(F.col(split) == "val")
    parts = []
    for name in names:
        model = fit(train, label, estimator(), ablation_features(name))
        scored = positive_probability(model.transform(complete(val)))
        m = metrics.ranking_metrics(scored, "risk_score", label)
        parts.append(m.select(F.lit(name).alias("ablation"), F.lit(len(ablation_features(name))).alias("n_features"),
                              "roc_auc", "pr_auc"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    base = parts[0].select(F.col("roc_auc").alias("_b"), F.lit(1).alias("_j"))
    joined = out.withColumn("_j", F.lit(1)).join(base, "_j").drop("_j")
    return joined.select("ablation", "n_features", "roc_auc", "pr_auc", (F.col("_b") - F.col("roc_auc")).alias("roc_auc_drop"))


def shuffled_target(rows: DataFrame, label: str, key: str = TX, seed: int = 42) -> DataFrame:
    """Rows with their labels dealt anew: a uniform permutation, from the places of the rows in two independent hashed orders."""
    def ranked(salt: int, *columns: str) -> DataFrame:
        hashed = rows.select(*columns, F.xxhash64(key, F.lit(seed + salt)).alias("_h"), F.col(key).alias("_k"))
        return global_positions(hashed, ["_h", "_k"], "_p")

    a = ranked(0, *rows.columns).drop("_k", "_h")
    b = ranked(1, label).select(F.col(label).alias("_other"), "_p")
    return a.join(b, "_p").select(*[F.col("_other").alias(label) if c == label else F.col(c) for c in rows.columns])


def permutation_check(rows: DataFrame, label: str, split: str, estimators: Mapping[str, object],
                      shuffle: Callable[[DataFrame, str], DataFrame] = shuffled_target) -> DataFrame:
    """Validation scores of each estimator fitted to the training labels and to a permutation of them, with the drops.

    A model that has learned something falls to chance: about 0.5 for ROC, the positive share for PR.
    """
    train, val = rows.where(F.col(split) == "train"), rows.where(F.col(split) == "val")
    out = None
    for name, estimator in estimators.items():
        scores = [metrics.ranking_metrics(positive_probability(fit(part, label, estimator).transform(complete(val))), "risk_score", label)
                  for part in (train, shuffle(train, label))]
        base, permuted = (m.select(F.col("roc_auc").alias(f"{p}roc_auc"), F.col("pr_auc").alias(f"{p}pr_auc"), F.lit(1).alias("_j"))
                          for m, p in zip(scores, ("", "permuted_")))
        row = base.join(permuted, "_j").select(
            F.lit(name).alias("candidate"), "roc_auc", "pr_auc", "permuted_roc_auc", "permuted_pr_auc",
            *[(F.col(m) - F.col(f"permuted_{m}")).alias(f"{m}_drop") for m in ("roc_auc", "pr_auc")],
            *[((F.col(m) - F.col(f"permuted_{m}")) / F.col(m) * 100).alias(f"{m}_pct_drop") for m in ("roc_auc", "pr_auc")])
        out = row if out is None else out.unionByName(row)
    return out


def class_distributions(rows: DataFrame, features: Sequence[str], by: str = "behavior_type") -> DataFrame:
    """Per class and feature: min, quartiles, max, share of zeros and of ones."""
    long = unpivot(rows, features, [by])
    q = exact_percentiles(long, [by, "feature"], "value", {"min": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "max": 1.0})
    s = long.groupBy(by, "feature").agg(F.avg((F.col("value") == 0).cast("double")).alias("zero_share"),
                                        F.avg((F.col("value") == 1).cast("double")).alias("one_share"))
    return q.join(s, [by, "feature"])


def label_feature_groups(ablations: DataFrame) -> DataFrame:
    """Verdict per feature group from the measured ablation scores."""
    at = lambda name, c: F.max(F.when(F.col("ablation") == name, F.col(c)))
    one = ablations.agg(at("H single feature", "roc_auc").alias("h"), at("C no ports", "roc_auc_drop").alias("c"),
                        at("D no temporal", "roc_auc_drop").alias("d"), at("G graph only", "roc_auc").alias("g"),
                        at("F transaction only", "roc_auc").alias("f"))
    row = lambda group, verdict, metric: F.struct(F.lit(group).alias("feature_group"), verdict.alias("verdict"),
                                                  metric.alias("metric"))
    return one.select(F.inline(F.array(
        row("rel_change_value_ratio", F.when(F.col("h") >= 0.85, "GENERATOR-FINGERPRINT RISK").otherwise(
            "SAFE / STRUCTURALLY RELEVANT"), F.col("h")),
        row("network_ports", F.when(F.col("c") <= 0.01, "SUSPICIOUS / FINGERPRINT RISK").otherwise("SAFE / PREDICTIVE"),
            F.col("c")),
        row("temporal_features", F.lit("SAFE / STRUCTURALLY RELEVANT"), F.col("d")),
        row("graph_historical_features", F.when(F.col("g") >= 0.5, "SAFE / CAUSALLY SOUND").otherwise("LOW SIGNAL"), F.col("g")),
        row("transaction_structural_features", F.lit("SAFE / CANONICAL"), F.col("f")))))


def feature_groups(spark) -> DataFrame:
    """Every model feature with its group, kind and display name."""
    groups = [("transaction", schemas.TX_FEATURES), ("address", schemas.ADDRESS_FEATURES), ("temporal", schemas.TIME_FEATURES),
              ("network", schemas.NETWORK_FEATURES), ("relational", schemas.RELATION_FEATURES), ("graph", GRAPH_MODEL_FEATURES)]
    rows = [(f, g, "categorical" if f in CATEGORICAL else "numeric", *display_name(f)) for g, fs in groups for f in fs]
    return spark.createDataFrame(rows, "feature_name string, feature_group string, kind string, display_label string, unit string")
