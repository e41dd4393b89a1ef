"""Sinks that join, compact and name files."""

import os

import pytest
from pyspark.sql import functions as F

from fleetlane.sinks import writers as W
from fleetlane.sources.stats import read_snapshots


def files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names
                  if not f.startswith((".", "_")))


def test_one_file_per_set_written_by_many_tasks(spark, tmp_path):
    """A set with most rows: several tasks write it, one file comes out, in
    byte order; the other sets too, and a second run replaces the first."""
    words = [f"{w}{i}" for i in range(3000) for w in ("a", "Z", "\u00e9")]
    rows = [("big", w, i) for i, w in enumerate(words)] + [("small", "b", 1), ("small", "a", 2), ("x y", "c", 3)]
    df = spark.createDataFrame(rows, "input_set string, word string, cnt long").repartition(6)
    out = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.enabled", "false")   # keep the range partitions apart
    try:
        parts = df.repartitionByRange("input_set", "word").where("input_set = 'big'").select(F.spark_partition_id()).distinct()
        assert parts.count() > 2
        for _ in range(2):
            W.write_single(df, out)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    found = files(out)
    assert found == [f"input_set={x}/part-00000" for x in ("big", "small", "x y")]
    lines = open(os.path.join(out, "input_set=big", "part-00000"), encoding="utf-8").read().splitlines()
    got = [x.split("\t")[0] for x in lines]
    assert got == sorted(words, key=lambda w: w.encode()) and len(lines) == len(words)
    assert open(os.path.join(out, "input_set=small", "part-00000")).read() == "a\t2\nb\t1\n"


def test_compaction_keeps_rows_and_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "stats")
    rows = [(r, "end" if s > 20 else "", s, f"hadoop-master-{c}", float(c)) for r in (1, 2) for s in range(25) for c in range(3)]
    df = spark.createDataFrame(rows, "run_id long, phase string, sample_no long, name string, cpu double")
    for k in range(4):
        W.write_stats(df.where(F.col("sample_no") % 4 == k).repartition(12), path)
    before = len(files(path))
    W.compact_stats(spark, path)
    assert before > 40 and len(files(path)) == 4      # a file per run and phase
    got = sorted((r.run_id, r.phase or "", r.sample_no, r.name, r.cpu) for r in spark.read.parquet(path).collect())
    assert got == sorted(rows)
    W.compact_stats(spark, path)
    assert spark.read.parquet(path).count() == len(rows) and not os.path.exists(path + "/_compacting")


def test_an_interrupted_compaction_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "stats")
    df = spark.range(60).select((F.col("id") % 3).alias("run_id"), F.lit("a").alias("phase"), F.col("id").alias("sample_no"))
    W.write_stats(df.repartition(10), path)
    real = W.delete

    def fail(*a):
        raise KeyboardInterrupt

    monkeypatch.setattr(W, "delete", fail)
    with pytest.raises(KeyboardInterrupt):
        W.compact_stats(spark, path)
    assert os.path.exists(path + "/_compacting")
    monkeypatch.setattr(W, "delete", real)
    # a partition that was deleted, but not yet replaced
    import shutil
    shutil.move(path + "/run_id=1", str(tmp_path / "lost"))
    W.compact_stats(spark, path)
    assert sorted(r.sample_no for r in spark.read.parquet(path).collect()) == list(range(60))


def test_snapshot_files_round_trip(spark, tmp_path):
    rows = [(r, p, s, f"hadoop-master-{c}", f"{c}.5%", "1.078GiB / 62.36GiB", "1.73%")
            for r in (1, 2) for p, s in (("", 1), ("", 10), ("end", 1)) for c in range(4)]
    df = spark.createDataFrame(rows, "run_id long, phase string, sample_no long, name string, cpu_pct string, "
                                     "mem_usage string, mem_pct string")
    W.write_snapshots(df.repartition(5), str(tmp_path / "r"))
    assert files(tmp_path / "r") == sorted(f"resource_{r}/resource_log_{n}" for r in (1, 2) for n in ("1", "10", "end_1"))
    assert open(tmp_path / "r" / "resource_1" / "resource_log_1").readline() == "NAME,CPU %,MEM USAGE / LIMIT,MEM %\n"
    got = read_snapshots(spark, str(tmp_path / "r" / "resource_*"))
    assert sorted(map(tuple, got.collect())) == sorted(rows)
