"""Table readers: Parquet directories, catalogs, CSV/JSON uploads, dataset-scoped scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope import schemas


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` exists on whatever filesystem its scheme names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return bool(target.getFileSystem(conf).exists(target))


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_table_directory(spark: SparkSession, folder: str, tables: dict[str, T.StructType] | None = None,
                         consolidated: str = "sih_transactions") -> dict[str, DataFrame]:
    """Named Parquet tables below ``folder``. A missing table is empty; when there are no
    transactions the consolidated nested file, if present, is returned under ``consolidated``."""
    tables = tables or schemas.RAW_TABLES
    frames: dict[str, DataFrame] = {}
    for name, schema in tables.items():
        path = f"{folder.rstrip('/')}/{name}.parquet"
        frames[name] = spark.read.parquet(path) if path_exists(spark, path) else empty(spark, schema)
    nested = f"{folder.rstrip('/')}/{consolidated}.parquet"
    if frames.get("transactions") is not None and path_exists(spark, nested) and frames["transactions"].isEmpty():
        frames["consolidated"] = spark.read.parquet(nested)
    return frames


def read_catalog_tables(spark: SparkSession, database: str | None = None,
                        tables: dict[str, T.StructType] | None = None) -> dict[str, DataFrame]:
    """The same tables from a catalog; a missing one is empty."""
    tables = tables or schemas.RAW_TABLES
    prefix = f"{database}." if database else ""
    return {name: spark.table(prefix + name) if spark.catalog.tableExists(prefix + name) else empty(spark, schema)
            for name, schema in tables.items()}


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """One uploaded file by suffix. CSV columns stay text: the ingest mapping types them once."""
    lowered = path.lower().rstrip("/")
    if lowered.endswith(".parquet"):
        return spark.read.parquet(path)
    if lowered.endswith((".jsonl", ".ndjson")):
        return spark.read.json(path)
    if lowered.endswith(".json"):
        return spark.read.option("multiLine", True).json(path)
    if lowered.endswith((".csv", ".csv.gz")):
        return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    raise ValueError(f"unsupported file format: {path}")


def read_dataset(frames: dict[str, DataFrame], dataset_id: str) -> dict[str, DataFrame]:
    """Every table cut to one dataset; with ``partitionBy(dataset_id)`` files this prunes partitions."""
    return {name: df.where(F.col("dataset_id") == dataset_id) for name, df in frames.items()
            if "dataset_id" in df.columns}


def find_dataset_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Pick the transaction file and, separately, the network-events file of a dataset folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return {}
    names = sorted(status.getPath().toString() for status in fs.listStatus(target))
    usable = [n for n in names if n.lower().endswith((".csv", ".parquet", ".json", ".jsonl"))]
    found: dict[str, str] = {}
    for path in usable:
        base = path.rsplit("/", 1)[-1].lower()
        kind = "network_events" if "network" in base else "transactions"
        found.setdefault(kind, path)
    return found
