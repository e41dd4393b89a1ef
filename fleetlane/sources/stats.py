"""Container snapshot CSVs.

Layout: ``<root>/resource_<run>/resource_log_<n>`` and, after the end
marker, ``resource_log_end_<n>``; each file has the header
``NAME,CPU %,MEM USAGE / LIMIT,MEM %`` and one row per container.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# The snapshot file's header fields, in order.
SNAPSHOT_FIELDS = ("NAME", "CPU %", "MEM USAGE / LIMIT", "MEM %")
SNAPSHOT_SCHEMA = StructType([StructField(n, StringType(), True) for n in SNAPSHOT_FIELDS])
_PATH_RE = "resource_([0-9]+)/resource_log_(?:(end)_)?([0-9]+)$"


def read_snapshots(spark: SparkSession, paths) -> DataFrame:
    """-> (run_id, phase, sample_no, name, cpu_pct, mem_usage, mem_pct).

    The schema is given (no inference pass); identity comes from the path.
    Pass run folders or a glob over them, not one path per file.  Rows of
    files with another name are left out."""
    p = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.schema(SNAPSHOT_SCHEMA).option("header", True).csv(p)
    f = F.col("_metadata.file_path")
    return df.select(
        F.regexp_extract(f, _PATH_RE, 1).try_cast("bigint").alias("run_id"),
        F.regexp_extract(f, _PATH_RE, 2).alias("phase"),
        F.regexp_extract(f, _PATH_RE, 3).try_cast("bigint").alias("sample_no"),
        F.col("NAME").alias("name"), F.col("CPU %").alias("cpu_pct"),
        F.col("MEM USAGE / LIMIT").alias("mem_usage"),
        F.col("MEM %").alias("mem_pct")).where("run_id is not null and sample_no is not null")


def snapshot_stream(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """T1/T4 source: new snapshot files under ``root/resource_*`` as they
    are written, with ``ts`` = the file's modification time (the moment the
    sampler wrote it) as event time."""
    r = spark.readStream.schema(SNAPSHOT_SCHEMA).option("header", True).format("csv")
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    df = r.load(f"{root.rstrip('/')}/resource_*")
    f = F.col("_metadata.file_path")
    return df.select(
        F.regexp_extract(f, _PATH_RE, 1).try_cast("bigint").alias("run_id"),
        F.regexp_extract(f, _PATH_RE, 2).alias("phase"),
        F.regexp_extract(f, _PATH_RE, 3).try_cast("bigint").alias("sample_no"),
        F.col("NAME").alias("name"), F.col("CPU %").alias("cpu_pct"),
        F.col("MEM USAGE / LIMIT").alias("mem_usage"), F.col("MEM %").alias("mem_pct"),
        F.col("_metadata.file_modification_time").alias("ts")).where("run_id is not null and sample_no is not null")
