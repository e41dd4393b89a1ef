"""Tailing the fleet's line files (queue, completion log) as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def line_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """New files of ``folder`` as (pos, value) lines.

    Appenders write one small file per append batch, so each file is read
    whole and its lines numbered exactly (row ids are not available on
    streams); ``pos`` = (file time, file, line number) orders lines across
    files and triggers."""
    r = spark.readStream.format("text").option("wholetext", True)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    df = r.load(folder)
    body = F.regexp_replace("value", "\n$", "")  # a final newline ends the last line
    lines = df.select(F.col("_metadata.file_modification_time").alias("mtime"),
                      F.col("_metadata.file_path").alias("file"),
                      F.posexplode(F.split(body, "\n")).alias("line_no", "value"))
    return lines.select(F.struct("mtime", "file", "line_no").alias("pos"), "value")
