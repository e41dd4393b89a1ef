"""Sinks K1-K5.  All writes go through Spark's commit protocol, which is
what replaces the reference's file locks: a task's output appears whole
or not at all, and retried tasks do not duplicate rows."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlane.session import scratch_path
from fleetlane.sources.files import delete, join_files, open_fs, qualified
from fleetlane.sources.stats import SNAPSHOT_FIELDS


def write_wordcount(counts: DataFrame, path: str) -> None:
    """K1: overwrite ``path`` with ``word<TAB>cnt`` lines, byte-ordered
    across part files (range partitioned, sorted within parts)."""
    (counts.select("word", F.col("cnt").cast("string"))
           .orderBy("word")
           .write.mode("overwrite").option("sep", "\t").option("header", False).csv(path))


def write_single(counts: DataFrame, path: str, set_col: str = "input_set") -> None:
    """K2: one output file per input set (``set_col=<set>/part-00000``), its
    words in byte order.

    Rows are range-partitioned by (set, word), so a large set is sorted and
    written by many tasks; the parts of a set, in the order of their names,
    are then joined to one file, streamed block by block."""
    spark = counts.sparkSession
    staged, out = scratch_path(spark, "single"), qualified(spark, path)
    (counts.select(set_col, "word", F.col("cnt").cast("string"))
           .repartitionByRange(set_col, "word").sortWithinPartitions(set_col, "word")
           .write.partitionBy(set_col).option("sep", "\t").option("header", False).csv(staged))
    delete(spark, out)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*")
                  .load(staged).select("path"))
    sets = files.select(F.regexp_extract("path", "/([^/]+)/[^/]+$", 1).alias("folder"), "path")
    sets = sets.groupBy("folder").agg(F.sort_array(F.collect_list("path")).alias("parts"))

    def join(batches):
        for b in batches:
            folders, parts = b.column(0).to_pylist(), b.column(1).to_pylist()
            size = [join_files(p, f"{out}/{f}/part-00000") for f, p in zip(folders, parts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64())], names=["folder", "bytes"])

    joined = sets.mapInArrow(join, "folder string, bytes bigint")
    joined.write.format("noop").mode("overwrite").save()
    delete(spark, staged)


def write_completion(done: DataFrame, path: str) -> None:
    """K3: append ``uuid:::path`` lines to the completion log folder."""
    (done.select(F.concat(F.col("uuid"), F.lit(":::"), F.col("path")).alias("value"))
         .write.mode("append").text(path))


def write_stats(typed: DataFrame, path: str) -> None:
    """K4: append snapshots, partitioned by run and phase (partition
    pruning for later per-run reads)."""
    typed.write.mode("append").partitionBy("run_id", "phase").parquet(path)


def compact_stats(spark: SparkSession, path: str) -> None:
    """K4: rewrite the many small files of write_stats() as files of the
    advisory partition size (a REBALANCE of the rows of each run and phase:
    small partitions are put together, large ones split).

    The rows are first staged whole; the marker ``_compacting`` names the
    staged copy until the partitions have been replaced, and a later call
    finishes what an interrupted one began.  Rows appended while it runs
    are lost, so the sampler must pause."""
    marker = f"{qualified(spark, path)}/_compacting"
    _, fs, at = open_fs(marker)
    if fs.get_file_info(at).type == pafs.FileType.File:
        with fs.open_input_stream(at) as f:
            staged = f.read().decode()
    else:
        staged = qualified(spark, scratch_path(spark, "compacted"))
        (spark.read.parquet(path).hint("rebalance", "run_id", "phase")
              .write.partitionBy("run_id", "phase").parquet(staged))
        with fs.open_output_stream(at) as f:
            f.write(staged.encode())
    # each file of the staged copy becomes one of the table's
    rows = spark.read.schema(spark.read.parquet(staged).schema).parquet(staged)
    (rows.hint("rebalance", "run_id", "phase").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run_id", "phase").parquet(path))
    delete(spark, marker)
    delete(spark, staged)


def write_snapshots(rows: DataFrame, root: str) -> None:
    """Snapshot rows in the sampler's own files, one per run, phase and
    sample (``resource_<run>/resource_log[_end]_<n>``), with its header.  A
    task has one file open; it gets its name when it is whole."""
    out = qualified(rows.sparkSession, root)
    cols = ["run_id", "phase", "sample_no", "name", "cpu_pct", "mem_usage", "mem_pct"]
    head = pa.array([",".join(SNAPSHOT_FIELDS)])

    def write(batches):
        _, fs, base = open_fs(out)
        key, f, n = None, None, 0

        def close():
            f.close()
            folder = f"{base}/resource_{key[0]}"
            fs.move(half, f"{folder}/resource_log_{'end_' if key[1] else ''}{key[2]}")

        for b in batches:
            line = pc.binary_join_element_wise(*(pc.fill_null(b.column(i), "") for i in range(3, 7)), ",")
            keys = list(zip(*(b.column(i).to_pylist() for i in range(3))))
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if keys[lo] != key:
                    if f:
                        close()
                    key, n = keys[lo], n + 1
                    fs.create_dir(f"{base}/resource_{key[0]}", recursive=True)
                    half = f"{base}/resource_{key[0]}/.half_{key[1]}_{key[2]}"
                    f = fs.open_output_stream(half)
                    f.write((head[0].as_py() + "\n").encode())
                f.write(("\n".join(line.slice(lo, hi - lo).to_pylist()) + "\n").encode())
        if f:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    (rows.select(*cols).repartition("run_id", "phase", "sample_no").sortWithinPartitions("run_id", "phase", "sample_no")
         .mapInArrow(write, "files bigint").write.format("noop").mode("overwrite").save())


def write_task_report(lines: DataFrame, path: str, n_parts: int | None = None) -> None:
    """K5 file form: one folder per task; its part files, read in name
    order, give the report in order.  Range partitioning on the report's
    order keys splits a large report over several tasks instead of one."""
    keys = ["task", "sec", "k_doc", "k_line", "k_word"]
    r = lines.repartitionByRange(n_parts, *keys) if n_parts else lines.repartitionByRange(*keys)
    (r.sortWithinPartitions(*keys).select("task", "line")
      .write.mode("overwrite").partitionBy("task").text(path))
