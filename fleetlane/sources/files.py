"""Files by URI, on the driver and in tasks, by pyarrow's file systems
(local, HDFS, S3, GCS)."""

from __future__ import annotations

import re
from urllib.parse import quote

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

COPY_BLOCK = 1 << 22


def open_fs(path: str) -> tuple[str, pafs.FileSystem, str]:
    """(URI, file system, path on it) of a path as Hadoop writes it: its
    characters are not escaped."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(//[^/]*)?(/.*)", path)
    if m is None or m[1] == "file":
        local = m[3] if m else path
        return "file://" + local, pafs.LocalFileSystem(), local
    return path, *pafs.FileSystem.from_uri(f"{m[1]}:{m[2] or '//'}{quote(m[3])}")


def qualified(spark: SparkSession, path: str) -> str:
    """The path as the cluster's default file system names it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    return p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString().rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def join_files(parts: list[str], target: str) -> int:
    """Write the bytes of ``parts``, one after the other, as ``target``; a
    block at a time, and under another name until whole, so a repeated task
    replaces what it left.  Returns the bytes."""
    _, fs, path = open_fs(target)
    folder, _, name = path.rpartition("/")
    fs.create_dir(folder, recursive=True)
    half, size = f"{folder}/.{name}.half", 0
    with fs.open_output_stream(half) as out:
        for part in parts:
            _, part_fs, part_path = open_fs(part)
            with part_fs.open_input_stream(part_path) as f:
                while block := f.read(COPY_BLOCK):
                    out.write(block)
                    size += len(block)
    fs.move(half, path)
    return size
