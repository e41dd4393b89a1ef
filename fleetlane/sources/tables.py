"""Loader for the driver-generated parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Input bytes below which a scan may leave cores idle, per core: Spark cuts
# no smaller splits, and a row group is read by one task.
SPREAD_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input to all cores before heavy parsing: a
    file of one row group is read by one task however many cores there are.
    Inputs of more than SPREAD_BYTES a core are left as they are scanned,
    so no large table is ever shuffled by this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # the planner's own figure
    return df if size >= cores * SPREAD_BYTES else df.repartition(cores)
