"""Steps written to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope.session import pin, release


def test_pinned_steps_are_written_small_and_whole(spark):
    rows = spark.range(20_000, numPartitions=2).select("id", F.format_string("C%d_%d", F.col("id") % 977, F.col("id") % 7).alias("address"),
                                                       (F.col("id") % 3 == 0).alias("odd"), F.when(F.col("id") % 5 > 0, F.col("id") * 1.5).alias("v"))
    step = pin(rows, "small")
    files = step.inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)
    assert [f.dataType for f in step.schema] == [f.dataType for f in rows.schema]
    assert step.exceptAll(rows).isEmpty() and rows.exceptAll(step).isEmpty()
    release(step)
