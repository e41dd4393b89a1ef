"""Batch jobs over the fleet's own files (spark-submit entry points).

    spark-submit fleetlane/jobs.py wordcount OUT SET_DIR [SET_DIR ...]
    spark-submit fleetlane/jobs.py report    OUT SET_DIR [SET_DIR ...]
    spark-submit fleetlane/jobs.py usage     OUT RESOURCE_ROOT [--skip K] [--step S]
    spark-submit fleetlane/jobs.py match     OUT QUEUE_DIR COMPLETION_DIR
    spark-submit fleetlane/jobs.py follow    OUT COMPLETION_DIR [--once] [--every SECONDS]

Each job is one Spark plan from files to files; nothing is collected.
"""

from __future__ import annotations

import argparse
import os
import sys

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from fleetlane.operators import tasks as tk  # noqa: E402
from fleetlane.operators import usage as us  # noqa: E402
from fleetlane.operators import wordcount as wc  # noqa: E402
from fleetlane.session import prepare, size_for_input  # noqa: E402
from fleetlane.sinks import writers  # noqa: E402
from fleetlane.sources.stats import read_snapshots  # noqa: E402
from fleetlane.sources.text import read_input_sets, read_lines  # noqa: E402


def job_wordcount(spark: SparkSession, out: str, sets: list[str]) -> None:
    """One word count per input set, one TAB file per set (K2)."""
    lines = read_input_sets(spark, sets).withColumnRenamed("value", "text")
    writers.write_single(wc.wordcount_by_set(lines), out)


def job_report(spark: SparkSession, out: str, sets: list[str]) -> None:
    """The task report of every input set (K5), one folder per set."""
    lines = read_input_sets(spark, sets).withColumnRenamed("value", "text")
    # files of a set are read in name order: index them on the (set, file)
    # table, which has one row per file, then join the index back
    files = lines.select("input_set", "file").distinct()
    files = files.withColumn("doc_id", F.row_number().over(
        Window.partitionBy("input_set").orderBy("file")).cast("bigint"))
    docs = lines.join(files, ["input_set", "file"])
    writers.write_task_report(wc.task_report_lines(docs), out)


def job_usage(spark: SparkSession, out: str, root: str, skip: int, step: float) -> None:
    """CPU and memory per snapshot, aligned per run, as parquet."""
    typed = us.typed_stats(read_snapshots(spark, f"{root.rstrip('/')}/resource_*"))
    for metric in ("cpu", "mem"):
        series = us.usage_by_snapshot(typed, metric)
        us.series_align(series, metric, skip, 0.0, step).write.mode("overwrite").parquet(
            f"{out}/{metric}_aligned")
        series.write.mode("overwrite").parquet(f"{out}/{metric}_by_snapshot")


def job_match(spark: SparkSession, out: str, queue: str, completions: str) -> None:
    """Completed tasks (with log path) and pending tasks."""
    tasks = tk.parse_queue(read_lines(spark, queue))
    parsed = tk.parse_completions(read_lines(spark, completions))
    tk.completion_match(tasks, tk.first_completions(parsed)).drop("pos", "done_pos") \
        .write.mode("overwrite").parquet(f"{out}/completed")
    tk.pending_tasks(tasks, parsed).drop("pos").write.mode("overwrite").parquet(f"{out}/pending")


def job_follow(spark: SparkSession, out: str, completions: str, once: bool,
               every: int = 5) -> None:
    """Follow a completion log (T1) and keep the first line per id (T7) in
    ``out``, as streaming.dedup.read_firsts() reads it.  ``completions`` is
    one growing file, followed by byte offset, or a folder to which files
    are added.  Restarts go on from the checkpoint next to the output."""
    from fleetlane.sources.tail import growing_lines, is_file
    from fleetlane.streaming.dedup import follow_firsts
    from fleetlane.streaming.sources import line_stream
    lines = growing_lines(spark, completions) if is_file(completions) else line_stream(spark, completions)
    w = follow_firsts(tk.parse_completions(lines), out, out.rstrip("/") + "-checkpoint")
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime=f"{every} seconds")
    w.start().awaitTermination()


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="fleetlane")
    sub = p.add_subparsers(dest="job", required=True)
    for name in ("wordcount", "report"):
        s = sub.add_parser(name)
        s.add_argument("out")
        s.add_argument("sets", nargs="+")
    s = sub.add_parser("usage")
    s.add_argument("out")
    s.add_argument("root")
    s.add_argument("--skip", type=int, default=1)
    s.add_argument("--step", type=float, default=6.5)
    s = sub.add_parser("match")
    s.add_argument("out")
    s.add_argument("queue")
    s.add_argument("completions")
    s = sub.add_parser("follow")
    s.add_argument("out")
    s.add_argument("completions")
    s.add_argument("--once", action="store_true")
    s.add_argument("--every", type=int, default=5)
    a = p.parse_args(argv)
    spark = prepare(SparkSession.builder.appName(f"fleetlane-{a.job}").getOrCreate())
    inputs = {"wordcount": lambda: a.sets, "report": lambda: a.sets, "usage": lambda: [a.root],
              "match": lambda: [a.queue, a.completions], "follow": lambda: [a.completions]}[a.job]()
    size_for_input(spark, inputs)
    if a.job == "wordcount":
        job_wordcount(spark, a.out, a.sets)
    elif a.job == "report":
        job_report(spark, a.out, a.sets)
    elif a.job == "usage":
        job_usage(spark, a.out, a.root, a.skip, a.step)
    elif a.job == "match":
        job_match(spark, a.out, a.queue, a.completions)
    else:
        job_follow(spark, a.out, a.completions, a.once, a.every)


if __name__ == "__main__":
    main()
