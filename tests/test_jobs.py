"""The file-to-file jobs, end to end on fixture-shaped files."""

import os

from file_trees import write_files
from fleetlane import jobs
from fleetlane.streaming.dedup import read_firsts
from test_usage import _tree
from test_wordcount import GOLDEN, SETS


def _read_parts(folder):
    return "".join(open(os.path.join(folder, f)).read() for f in sorted(os.listdir(folder))
                   if f.startswith("part-"))


def test_wordcount_and_report_jobs(spark, tmp_path):
    root = write_files(str(tmp_path / "in"), SETS)
    sets = [os.path.join(root, s) for s in ("input1", "input2", "input3")]
    out = str(tmp_path / "wc")
    jobs.job_wordcount(spark, out, sets)
    for s, exp in GOLDEN.items():
        text = _read_parts(os.path.join(out, f"input_set={s}"))
        assert [tuple(x.split("\t")) for x in text.splitlines()] == [(w, str(c)) for w, c in exp]
    rep = str(tmp_path / "rep")
    jobs.job_report(spark, rep, sets)
    lines = _read_parts(os.path.join(rep, "task=input3")).splitlines()
    assert lines[:4] == ["input :", "unix is a system", "linux is a system", "macOS is a system"]
    assert lines[5:7] == ["wordcount output:", "a\t3"] and lines[-1] == "save hdfs to disk"


def test_usage_job(spark, tmp_path):
    out = str(tmp_path / "u")
    jobs.job_usage(spark, out, _tree(tmp_path), 0, 6.5)  # run 2 has one snapshot
    cpu = spark.read.parquet(f"{out}/cpu_aligned")
    assert cpu.select("run_id").distinct().count() == 2
    assert cpu.where("run_id = 1").count() == cpu.where("run_id = 2").count()


def test_match_job(spark, tmp_path):
    u = ["5f0c2a10-1d3e-11ee-9c4b-0242ac120002", "6a7d3b24-1d3e-11ee-9c4b-0242ac120002"]
    root = write_files(str(tmp_path), {
        "publish/publish.txt": "".join(f"sh run-wordcount2.sh input/input1 output/output1 {x}\n" for x in u),
        "subscribe/subscribe.txt": f"{u[1]}:::logs/{u[1]}.txt\n"})
    out = str(tmp_path / "m")
    jobs.job_match(spark, out, os.path.join(root, "publish"), os.path.join(root, "subscribe"))
    assert [r.uuid for r in spark.read.parquet(f"{out}/completed").collect()] == [u[1]]
    assert [r.uuid for r in spark.read.parquet(f"{out}/pending").collect()] == [u[0]]


def test_size_for_input(spark, tmp_path):
    from fleetlane.session import input_bytes, size_for_input
    root = write_files(str(tmp_path / "in"), {"a/x.txt": "x" * 1000, "b/y.txt": "y" * 500})
    assert input_bytes(spark, [os.path.join(root, "*")]) == 1500
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        n = size_for_input(spark, [root], bytes_per_partition=100)
        assert n == int(old)  # set explicitly by the test session: kept
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "true")


def test_follow_job_once(spark, tmp_path):
    u = ["5f0c2a10-1d3e-11ee-9c4b-0242ac120002", "6a7d3b24-1d3e-11ee-9c4b-0242ac120002"]
    root = write_files(str(tmp_path / "sub"), {
        "a.txt": f"{u[0]}:::logs/a\n{u[0]}:::logs/dup\n", "b.txt": f"sh run x y {u[1]}\nbad:::x\n"})
    out = str(tmp_path / "firsts")
    jobs.job_follow(spark, out, root, once=True)
    got = sorted((r.uuid, r.path) for r in read_firsts(spark.read.parquet(out)).collect())
    assert got == sorted([(u[0], "logs/a"), (u[1], None)])


def test_follow_job_on_a_growing_file(spark, tmp_path):
    u = ["5f0c2a10-1d3e-11ee-9c4b-0242ac120002", "6a7d3b24-1d3e-11ee-9c4b-0242ac120002"]
    log, out = tmp_path / "subscribe.txt", str(tmp_path / "firsts")
    for part, want in ((f"{u[0]}:::logs/a\n{u[1]}:::lo", {u[0]: "logs/a"}),
                       (f"gs/b\n{u[0]}:::logs/dup\n", {u[0]: "logs/a", u[1]: "logs/b"})):
        with open(log, "a") as f:
            f.write(part)
        jobs.job_follow(spark, out, str(log), once=True)
        assert {r.uuid: r.path for r in read_firsts(spark.read.parquet(out)).collect()} == want


def test_cli_main_wordcount(spark, tmp_path):
    root = write_files(str(tmp_path / "in"), {"input1/f1.txt": "Hello Hadoop\n", "input1/f2.txt": "Hello Docker\n"})
    out = str(tmp_path / "cli")
    jobs.main(["wordcount", out, os.path.join(root, "input1")])
    assert _read_parts(os.path.join(out, "input_set=input1")).splitlines() == ["Docker\t1", "Hadoop\t1", "Hello\t2"]
