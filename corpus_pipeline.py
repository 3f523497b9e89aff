"""The corpus pipeline: toxicity filter, line dedup, near-dedup, decontamination, mixing.

Every stage works on all rows that its predecessor kept and returns the columns of ``documents``; the last adds the
slot of each document in the mixture. A stage's rows are written and read again before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerscope.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from ledgerscope.llm.shared import prepare, table
from ledgerscope.session import pin


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose most toxic window scores one half or more go."""
    prepare(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are cut from the texts; documents of which nothing is left go."""
    prepare(spark)
    return line_dedup.drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a five-word Jaccard similarity of 0.8 or more stays."""
    prepare(spark)
    return simhash.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go."""
    prepare(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its slot in a mixture of the sources by tempered weights."""
    prepare(spark)
    return mixing.mixed(docs)


STAGES = [
    ("toxicity_filter", toxicity_filter),
    ("line_dedup", line_deduplication),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: A trained network and connected components aren't SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
