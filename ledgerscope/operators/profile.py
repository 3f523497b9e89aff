"""Exploration and audit aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.ordering import exact_percentiles, unpivot
from ledgerscope.sources.sinks import table_counts

TX = "transaction_id"
QUANTILES = {"min": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "max": 1.0}


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return table_counts(dict(tables))


def column_profile(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: mean, sample std, exact percentiles and bias-corrected skew."""
    long = unpivot(rows, columns)
    q = exact_percentiles(long, ["feature"], "value", QUANTILES)
    n = F.count("value")
    fix = F.when(n > 2, F.sqrt(n * (n - 1.0)) / (n - 2))
    s = long.groupBy("feature").agg(n.alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                    (F.skewness("value") * fix).alias("skew"))
    return q.join(s, "feature")


def cardinality(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values per column and whether it is Binary, Discrete or Continuous."""
    long = unpivot(rows, columns).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.lit(1).alias("_"))
    n = F.col("n_distinct")
    return long.groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct")).select(
        "feature", "n_distinct", F.when(n == 2, "Binary").when(n < 50, "Discrete").otherwise("Continuous").alias("kind"))


def iqr_outliers(rows: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Values outside the quartiles by more than ``factor`` inter-quartile ranges. The fences (one row per
    column) go to the rows, which are counted where they are."""
    long = unpivot(rows, columns).where(F.col("value").isNotNull())
    q = exact_percentiles(long, ["feature"], "value", {"p25": 0.25, "p75": 0.75})
    iqr = F.col("p75") - F.col("p25")
    fences = q.select("feature", (F.col("p25") - iqr * factor).alias("low"), (F.col("p75") + iqr * factor).alias("high"))
    out = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    return long.join(F.broadcast(fences), "feature").groupBy("feature").agg(
        F.count(F.when(out, 1)).alias("outliers"), F.count(F.lit(1)).alias("n")).select(
        "feature", "outliers", (F.col("outliers") * 100.0 / F.col("n")).alias("outlier_pct"))


def correlations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair, all in one pass over the wide table."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    aggs = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    return rows.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def redundant_pairs(correlation: DataFrame, at_least: float = 0.999999) -> DataFrame:
    return correlation.where(F.abs("r") >= at_least)


def group_comparison(rows: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """Median and mean of each column per group."""
    long = unpivot(rows, columns, [by])
    q = exact_percentiles(long, [by, "feature"], "value", {"median": 0.5})
    return q.join(long.groupBy(by, "feature").agg(F.avg("value").alias("mean")), [by, "feature"])


def ledger_span(transactions: DataFrame) -> DataFrame:
    """Time span, volume and fee totals."""
    return transactions.agg(
        F.count(F.lit(1)).alias("n_transactions"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"),
        F.sum("total_output_value_satoshi").alias("volume_satoshi"), F.sum("fee_satoshi").alias("fees_satoshi"),
        F.avg("fee_satoshi").alias("avg_fee"), F.min("fee_satoshi").alias("min_fee"), F.max("fee_satoshi").alias("max_fee"))


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int, log10: bool = False) -> DataFrame:
    """Counts per equal-width bin; bin 0 lies below the range and bin n+1 above."""
    v = F.col(column).cast("double")
    v = F.log10(v) if log10 else v
    return rows.where(v.isNotNull()).groupBy(
        F.width_bucket(v, F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def degree_histograms(nodes: DataFrame, most: int = 19) -> DataFrame:
    """Nodes per in-degree and per out-degree, one bin a degree; the last bin holds ``most`` and more."""
    series = nodes.select(F.explode(F.array(F.struct(F.lit("in_degree").alias("series"), F.col("in_degree").alias("d")),
                                            F.struct(F.lit("out_degree").alias("series"), F.col("out_degree").alias("d")))).alias("e"))
    return series.groupBy("e.series", F.least(F.col("e.d").cast("bigint"), F.lit(most).cast("bigint")).alias("degree")).agg(F.count(F.lit(1)).alias("n"))


def class_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("behavior_type", "ground_truth_label").agg(F.count(F.lit(1)).alias("n"))


def class_shares(labels: DataFrame) -> DataFrame:
    per = labels.groupBy("behavior_type").agg(F.count(F.lit(1)).alias("n"))
    return per.select("behavior_type", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def compare_classes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Class counts and shares of two label sets, aligned by class."""
    a, b = class_shares(first), class_shares(second)
    side = lambda df, s: df.select("behavior_type", F.col("n").alias(f"n_{s}"), (F.col("share") * 100).alias(f"pct_{s}"))
    j = side(a, "first").join(side(b, "second"), "behavior_type", "full_outer")
    return j.select("behavior_type", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_first", "pct_first", "n_second", "pct_second")])


def class_shape(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Change ratio and input/output counts per class."""
    j = features.join(labels.select(TX, "behavior_type"), TX)
    return j.groupBy("behavior_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("rel_change_value_ratio").alias("avg_change_ratio"),
        F.min("rel_change_value_ratio").alias("min_change_ratio"), F.max("rel_change_value_ratio").alias("max_change_ratio"),
        F.avg("tx_input_count").alias("avg_inputs"), F.avg("tx_output_count").alias("avg_outputs"),
        F.max("tx_input_count").alias("max_inputs"), F.max("tx_output_count").alias("max_outputs"))


def compare_shapes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two class-shape tables side by side."""
    names = [c for c in first.columns if c != "behavior_type"]
    side = lambda df, s: df.select("behavior_type", *[F.col(c).alias(f"{c}_{s}") for c in names])
    return side(first, "first").join(side(second, "second"), "behavior_type", "full_outer")
