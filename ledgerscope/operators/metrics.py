"""Model quality metrics as aggregates over scored rows. No score list is ever sorted in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.ordering import prefix_totals, unpivot, value_bucket


def ranking_metrics(rows: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC and average precision per ``keys``, from counts per distinct score."""
    keys = list(keys)
    counted = rows.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("s")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    ordered = prefix_totals(counted, value_bucket(F.col("s"), 16), value_bucket(F.col("s")), ["s"], ["pos", "neg"], keys)
    totals = counted.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    if keys:
        joined = ordered.join(totals, keys)
    else:
        joined = ordered.withColumn("_j", F.lit(1)).join(F.broadcast(totals.withColumn("_j", F.lit(1))), "_j")
    tp, fp = F.col("P") - F.col("before_pos"), F.col("N") - F.col("before_neg")
    area = F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)
    return joined.groupBy(*keys).agg(
        (F.sum(area) / (F.max("P").cast("double") * F.max("N"))).alias("roc_auc"),
        (F.sum(F.col("pos") * (tp / (tp + fp))) / F.max("P")).alias("pr_auc"))


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _from_counts(df: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = df.withColumn("accuracy", _safe(tp + tn, tp + fp + fn + tn)).withColumn("precision", _safe(tp, tp + fp)).withColumn(
        "recall", _safe(tp, tp + fn))
    return out.withColumn("f1", _safe(2.0 * tp, 2 * tp + fp + fn))


def threshold_metrics(rows: DataFrame, score: str, label: str, thresholds: Sequence[float],
                      keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 at each threshold, in one pass."""
    one = F.col(label) == 1
    aggs = []
    for i, t in enumerate(thresholds):
        hit = F.col(score) >= F.lit(float(t))
        aggs.append(F.struct(F.lit(float(t)).alias("threshold"), F.count(F.when(hit & one, 1)).alias("tp"),
                             F.count(F.when(hit & ~one, 1)).alias("fp"), F.count(F.when(~hit & one, 1)).alias("fn"),
                             F.count(F.when(~hit & ~one, 1)).alias("tn")).alias(f"t{i}"))
    wide = rows.groupBy(*keys).agg(*aggs)
    return _from_counts(wide.select(*keys, F.inline(F.array(*[f"t{i}" for i in range(len(thresholds))]))))


def percent_bucket(score: Column) -> Column:
    """The largest i with score >= i / 100, exact at the edges."""
    g = F.floor(score * 100)
    return (F.when(score >= (g + 1) / 100.0, g + 1).when(score < g / 100.0, g - 1).otherwise(g)).cast("bigint")


def threshold_sweep(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Metrics at thresholds 0.01 .. 0.99. Scores are counted into 1 % bins; the sweep sums at most 102 bins."""
    from pyspark.sql import Window
    one = F.col(label) == 1
    bins = rows.groupBy(percent_bucket(F.col(score)).alias("i")).agg(
        F.count(F.when(one, 1)).alias("pos"), F.count(F.when(~one, 1)).alias("neg"))
    spark = rows.sparkSession
    grid = spark.range(1, 100).select(F.col("id").alias("i"), F.lit(0).cast("bigint").alias("pos"),
                                      F.lit(0).cast("bigint").alias("neg"), F.lit(True).alias("asked"))
    both = grid.unionByName(bins.withColumn("asked", F.lit(False))).groupBy("i").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("asked").alias("asked"))
    above = Window.orderBy(F.desc("i"))
    everything = Window.partitionBy()
    swept = both.select("i", "asked", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
                        F.sum("pos").over(everything).alias("P"), F.sum("neg").over(everything).alias("N"))
    counts = swept.where("asked").select((F.col("i") / 100.0).alias("threshold"), "tp", "fp",
                                         (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("fp")).alias("tn"))
    return _from_counts(counts)


def best_thresholds(sweep: DataFrame, min_recall: float = 0.95) -> DataFrame:
    """The threshold of best F1, and of best precision (then F1) among those keeping the recall; 0.5 if none."""
    t = F.col("threshold")
    enough = F.col("recall") >= min_recall
    return sweep.agg(
        F.max_by(t, F.struct("f1", -t)).alias("best_f1_threshold"), F.max("f1").alias("best_f1"),
        F.coalesce(F.max_by(t, F.when(enough, F.struct("precision", "f1", (-t).alias("n")))), F.lit(0.5)).alias(
            "high_recall_threshold"))


def multiclass_report(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    cells = rows.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    marks = cells.select(F.explode(F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hit")))).alias("m"))
    per = marks.groupBy("m.class").agg(F.sum("m.support").alias("support"), F.sum("m.predicted").alias("predicted"),
                                       F.sum("m.hit").alias("tp"))
    return per.select("class", "support", "predicted", "tp", _safe(F.col("tp"), F.col("predicted")).alias("precision"),
                      _safe(F.col("tp"), F.col("support")).alias("recall"),
                      _safe(2.0 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"))


def multiclass_summary(report: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted F1 from the per-class report."""
    n = F.sum("support")
    return report.agg((F.sum("tp") / n).alias("accuracy"), F.avg("f1").alias("macro_f1"),
                      (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"), n.alias("rows"))


def log_loss(rows: DataFrame, probability_of_truth: str, epsilon: float = 1e-15) -> DataFrame:
    p = F.greatest(F.lit(epsilon), F.least(F.lit(1 - epsilon), F.col(probability_of_truth)))
    return rows.agg((-F.avg(F.log(p))).alias("log_loss"))


def compare_splits(rows: DataFrame, score: str, label: str, split: str, thresholds: Sequence[float],
                   first: str = "val", second: str = "test") -> DataFrame:
    """Metrics of two splits side by side with their differences."""
    m = threshold_metrics(rows.where(F.col(split).isin(first, second)), score, label, thresholds, [split])
    names = ["precision", "recall", "f1", "accuracy"]
    side = lambda s: m.where(F.col(split) == s).select(
        "threshold", *[F.col(n).alias(f"{s}_{n}") for n in names])
    both = side(first).join(side(second), "threshold")
    return both.select("threshold", *[c for n in names for c in (
        f"{first}_{n}", f"{second}_{n}", (F.col(f"{second}_{n}") - F.col(f"{first}_{n}")).alias(f"delta_{n}"))])


def overfit_gap(rows: DataFrame, score: str, label: str, split: str, threshold: float = 0.5) -> DataFrame:
    """Train minus validation ROC-AUC and F1, with a risk word."""
    r = ranking_metrics(rows, score, label, [split]).select(split, "roc_auc")
    f = threshold_metrics(rows, score, label, [threshold], [split]).select(split, "f1")
    m = r.join(f, split)
    at = lambda s, c: F.max(F.when(F.col(split) == s, F.col(c)))
    gap = m.agg((at("train", "roc_auc") - at("val", "roc_auc")).alias("roc_auc_gap"),
                (at("train", "f1") - at("val", "f1")).alias("f1_gap"))
    g = F.col("roc_auc_gap")
    return gap.select("*", F.when(g < 0.05, "Low").when(g < 0.10, "Moderate").otherwise("High").alias("overfit_risk"))


def single_feature_power(rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """ROC-AUC and average precision of every feature used alone, in its better direction."""
    long = unpivot(rows, features, [label])
    signed = long.where(F.col("value").isNotNull()).select(label, "feature", F.explode(F.array(
        F.struct(F.lit("+").alias("d"), F.col("value").alias("v")), F.struct(F.lit("-").alias("d"), (-F.col("value")).alias("v"))
    )).alias("x")).select(label, "feature", "x.d", "x.v")
    m = ranking_metrics(signed, "v", label, ["feature", "d"])
    return m.groupBy("feature").agg(F.max("roc_auc").alias("roc_auc"), F.max("pr_auc").alias("pr_auc"))


def class_weight(rows: DataFrame, label: str) -> DataFrame:
    """Weight of the positive class: negatives / positives."""
    pos, neg = F.count(F.when(F.col(label) == 1, 1)), F.count(F.when(F.col(label) == 0, 1))
    return rows.agg(neg.alias("negatives"), pos.alias("positives"), F.when(pos > 0, neg / pos).alias("pos_weight"))
