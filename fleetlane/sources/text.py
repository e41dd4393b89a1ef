"""Text files: input sets (O01), line logs with their file order, and
whole report files (O05)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def _paths(paths):
    return [paths] if isinstance(paths, str) else list(paths)


def read_input_sets(spark: SparkSession, paths) -> DataFrame:
    """Every line of every file under the input-set folders.

    -> (input_set, file, value).  The set is the file's parent folder, so
    several files of one set are read as one input (concatenated)."""
    df = spark.read.text(_paths(paths)).select("value", F.col("_metadata.file_path").alias("file"))
    return df.select(F.regexp_extract("file", "([^/]+)/[^/]+$", 1).alias("input_set"),
                     "file", "value")


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """Lines with their exact order across appended log files.

    -> (pos, value) where ``pos`` is an orderable struct (file modification
    time, file path, split start, row id).  Within one split the row id
    grows with the line; splits and files order by the leading fields, so
    sorting by ``pos`` is file order even for files Spark splits."""
    df = spark.read.text(_paths(paths))
    pos = F.struct(F.col("_metadata.file_modification_time").alias("mtime"),
                   F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("row"))
    return df.select(pos.alias("pos"), "value")


def read_reports(spark: SparkSession, paths) -> DataFrame:
    """Whole report files -> (path, text), unstripped.  Empty files yield
    no row (the text reader skips them), so they count as not there yet."""
    df = spark.read.option("wholetext", True).text(_paths(paths))
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
