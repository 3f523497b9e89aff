"""Writers: canonical table sets, catalog tables, upserts, guarded deletes, staged loads."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.sources.readers import path_exists


def write_tables(frames: dict[str, DataFrame], folder: str, partition_by: Sequence[str] = ("dataset_id",),
                 sort_by: dict[str, Sequence[str]] | None = None) -> None:
    """One Parquet file set per table. ``sort_by`` sorts inside tasks so min/max statistics skip row groups.

    Only the partitions that the frames have rows for are replaced, so other datasets in the folder stay.
    """
    for name, df in frames.items():
        parts = [c for c in partition_by if c in df.columns]
        keys = (sort_by or {}).get(name)
        out = df.sortWithinPartitions(*parts, *keys) if keys else df
        writer = out.write.mode("overwrite").partitionBy(*parts)
        if parts:
            writer = writer.option("partitionOverwriteMode", "dynamic")
        writer.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def register_tables(frames: dict[str, DataFrame], database: str | None = None,
                    bucket_by: dict[str, tuple[int, str]] | None = None) -> None:
    """Create or replace catalog tables, optionally bucketed so later joins on the key need no shuffle."""
    for name, df in frames.items():
        writer = df.write.mode("overwrite").format("parquet")
        if bucket_by and name in bucket_by:
            buckets, key = bucket_by[name]
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(f"{database}.{name}" if database else name)


def write_json_summary(summary: DataFrame, path: str) -> None:
    """A small summary frame as JSON lines."""
    summary.write.mode("overwrite").json(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], load_order: str | None = None) -> DataFrame:
    """Rows of ``old`` and ``new`` with one row per key; the newest load wins.

    Inside ``new`` the largest ``load_order`` (else the largest row) wins. Kept as a grouped maximum,
    which combines before the shuffle, so a key repeated in a third of the rows stays cheap.
    """
    columns = old.columns
    rest = [c for c in columns if c not in keys]
    order = [load_order] if load_order else rest
    both = old.withColumn("_load", F.lit(0)).unionByName(new.withColumn("_load", F.lit(1)),
                                                         allowMissingColumns=True)
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_load", *order)).alias("_row"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in columns])


def replace_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete-then-insert: rows of ``old`` whose key is not in ``new``, plus all of ``new``."""
    kept = old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns)
    return kept.unionByName(new)


def _file_system(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _publish(spark: SparkSession, staging: str, path: str) -> None:
    """Put ``staging`` in the place of ``path``. The old folder is set aside first and comes back if the new one can't take its place."""
    fs, target = _file_system(spark, path)
    source = _file_system(spark, staging)[1]
    retired = _file_system(spark, f"{path.rstrip('/')}.retired-{uuid.uuid4().hex}")[1]
    had = fs.exists(target)
    if had and not fs.rename(target, retired):
        raise IOError(f"could not set {path} aside")
    if not fs.rename(source, target):
        if had:
            fs.rename(retired, target)
        raise IOError(f"could not publish {path}")
    if had:
        fs.delete(retired, True)


def overwrite_through_staging(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace the files of ``path`` by ``df``, which may itself read ``path``: write beside, then rename."""
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(staging)
    _publish(df.sparkSession, staging, path)


def _refuse_running(dataset_id: str, runs: DataFrame | None) -> None:
    if runs is not None and not runs.where((F.col("dataset_id") == dataset_id) & (F.col("status") == "running")).isEmpty():
        raise RuntimeError(f"dataset {dataset_id} has a running analysis")


def drop_dataset(spark: SparkSession, folder: str, names: Sequence[str], dataset_id: str, runs: DataFrame | None = None) -> int:
    """Drop one dataset's partition of every stored table; nothing else is read or written. Returns how many there were."""
    _refuse_running(dataset_id, runs)
    part = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(dataset_id)
    dropped = 0
    for name in names:
        fs, target = _file_system(spark, f"{folder.rstrip('/')}/{name}.parquet/dataset_id={part}")
        dropped += bool(fs.exists(target) and fs.delete(target, True))
    return dropped


def delete_dataset(frames: dict[str, DataFrame], dataset_id: str,
                   runs: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables without one dataset; refused while one of its runs is still running. For stored tables see ``drop_dataset``."""
    _refuse_running(dataset_id, runs)
    return {name: df.where(~F.col("dataset_id").eqNullSafe(dataset_id)) if "dataset_id" in df.columns else df
            for name, df in frames.items()}


def load_all_or_nothing(spark: SparkSession, source: str, target: str, required: Sequence[str]) -> DataFrame:
    """Copy required tables to ``target`` only when all of them are present; returns rows per table."""
    missing = [t for t in required if not path_exists(spark, f"{source.rstrip('/')}/{t}.parquet")]
    if missing:
        raise FileNotFoundError(f"required tables missing: {', '.join(missing)}")
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"
    for t in required:
        spark.read.parquet(f"{source.rstrip('/')}/{t}.parquet").write.mode("overwrite").parquet(
            f"{staging}/{t}.parquet")
    _publish(spark, staging, target)
    return table_counts({t: spark.read.parquet(f"{target.rstrip('/')}/{t}.parquet") for t in required})


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, n_rows)`` for a set of tables."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
             for name, df in frames.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
