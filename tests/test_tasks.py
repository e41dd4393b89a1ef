"""Queue and completion parsing, matching, requests,
output mining, access log, callbacks."""

import json
import os
import re

from pyspark.sql import functions as F

from file_trees import write_files
from fleetlane.functions.ids import uuid_v1_time
from fleetlane.functions.paths import normalise_log_path
from fleetlane.operators import tasks as tk
from fleetlane.sources.requests import PIPELINE_ERROR, parse_requests
from fleetlane.sources.text import read_lines, read_reports

# version-1 ids (time-based) of our own
U = ["5f0c2a10-1d3e-11ee-9c4b-0242ac120002", "6a7d3b24-1d3e-11ee-9c4b-0242ac120002",
     "70e1c9d8-1d3e-11ee-9c4b-0242ac120002", "7b52f0aa-1d3e-11ee-9c4b-0242ac120002"]


def _lines(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "pos long, value string")


def test_queue_parse_blank_and_short(spark):
    q = _lines(spark, [f"sh run-wordcount2.sh input/input1 output/output1 {U[0]}", "   ",
                       f"sh  run-wordcount2.sh\tinput/input2 output/output2  {U[1]} ", "", "one"])
    rows = tk.parse_queue(q).orderBy("pos").collect()
    assert [(r.pos, r.input, r.output, r.uuid) for r in rows] == [
        (0, "input/input1", "output/output1", U[0]), (2, "input/input2", "output/output2", U[1]),
        (4, None, None, "one")]


def test_queue_head_counts_blank_slots(spark):
    q = _lines(spark, ["a 1", "", "b 2", "c 3"])
    assert [r.uuid for r in tk.queue_head(q, 2).collect()] == ["1"]
    assert [r.uuid for r in tk.queue_head(q, 10).orderBy("pos").collect()] == ["1", "2", "3"]
    assert tk.queue_head(q.limit(0), 7).count() == 0
    assert [r.pos for r in tk.queue_pop(q, 1).orderBy("pos").collect()] == [1, 2, 3]


def test_read_lines_keeps_file_order(spark, tmp_path):
    root = write_files(str(tmp_path), {"log/a.txt": "".join(f"line {i}\n" for i in range(2000))})
    df = read_lines(spark, os.path.join(root, "log"))
    got = [r.value for r in df.orderBy("pos").collect()]
    assert got == [f"line {i}" for i in range(2000)]
    assert [r.value for r in tk.completion_tail(df, 3).collect()] == ["line 1999", "line 1998", "line 1997"]


def test_completion_formats_dedup_reject(spark):
    lines = [f"sh run-wordcount2.sh input/input1 output/output1 {U[0]}",
             f"{U[1]}:::logs/{U[1]}.txt",
             f"sh run-wordcount2.sh input/input1 output/output1 {U[2]}",
             f"sh run-wordcount2.sh input/input2 output/output2 {U[2]}",  # dup, other input
             f"sh run-wordcount2.sh input/input1 output/output1 {U[3]}i",  # malformed
             f"{U[1]}:::/abs/{U[1]}.txt", "", f"{U[3]}:::{U[3]}.txt"]
    parsed = tk.parse_completions(_lines(spark, lines))
    # the malformed id and the blank line (id '') are invalid; both vanish in the dedup
    assert sorted(r.uuid for r in parsed.where(~F.col("valid")).collect()) == ["", U[3] + "i"]
    firsts = {r.uuid: r for r in tk.first_completions(parsed).collect()}
    assert set(firsts) == set(U)
    assert firsts[U[2]].first_pos == 2 and firsts[U[2]].dup_count == 2
    assert firsts[U[1]].path == f"logs/{U[1]}.txt" and firsts[U[1]].dup_count == 2
    assert firsts[U[0]].path is None


def test_match_pending_partition(spark):
    tasks = spark.createDataFrame([(i, u, "in") for i, u in enumerate(U)] + [(9, "x", "in")],
                                  "pos long, uuid string, input string")
    parsed = tk.parse_completions(_lines(spark, [f"{U[0]}:::logs/a", f"{U[2]}:::b", "zzz:::c"]))
    done = {r.uuid for r in tk.completion_match(tasks, tk.first_completions(parsed)).collect()}
    pend = {r.uuid for r in tk.pending_tasks(tasks, parsed).collect()}
    assert done == {U[0], U[2]} and pend == {U[1], U[3], "x"} and not (done & pend)


def test_uuid_time(spark):
    import datetime as dt
    import uuid
    rows = spark.createDataFrame([(u,) for u in U], "u string").select(
        "u", uuid_v1_time(F.col("u")).alias("t")).collect()
    for r in rows:
        ticks = uuid.UUID(r.u).time  # 100 ns since 1582-10-15
        exp = dt.datetime(1582, 10, 15) + dt.timedelta(microseconds=ticks // 10)
        assert r.t == exp


def test_paths_and_result_lookup(spark, tmp_path):
    root = str(tmp_path / "logs")
    write_files(root, {"a.txt": "report A\n", "b.txt": "", "c.txt": "  \n\t", "d.txt": "\n report D \n"})
    comp = spark.createDataFrame([("A", "logs/a.txt"), ("B", "b.txt"), ("C", "c.txt"),
                                  ("D", f"{root}/d.txt"), ("E", "logs/e.txt")], "uuid string, path string")
    reports = read_reports(spark, root).withColumn("path", F.regexp_replace("path", "^file:", ""))
    got = {r.uuid: (r.found, r.report) for r in tk.result_lookup(comp, reports, root).collect()}
    # empty file: not there yet; white space only: found, message ''
    assert got == {"A": (True, "report A"), "B": (False, None), "C": (True, ""),
                   "D": (True, "report D"), "E": (False, None)}
    p = spark.createDataFrame([("logs/x",), ("/abs/y",), ("logs/logs/z",)], "p string")
    assert [r.n for r in p.select(normalise_log_path(F.col("p"), "/root/").alias("n")).collect()] == \
        ["/root/x", "/abs/y", "/root/logs/z"]


def test_timeout_status_bucket_edges(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1, 0, 59, 0)
    req = spark.createDataFrame([(1, 7, t0), (2, 7, t0 + dt.timedelta(hours=5)), (3, 8, t0)],
                                "req_id long, k long, ts timestamp")
    done = spark.createDataFrame([(7, t0 + dt.timedelta(seconds=3600)),      # exactly at the limit
                                  (7, t0 + dt.timedelta(hours=5, seconds=3601)),  # 1 s too late
                                  (8, t0 - dt.timedelta(seconds=1))], "k long, ts timestamp")
    got = {r.req_id: r.status for r in tk.first_completion_within(req, done, "k", 3600).collect()}
    assert got == {1: "success", 2: "timeout", 3: "timeout"}


def test_requests_variants(spark):
    rows = [(1, "hadoop", '{"input":"i","output":"o","callback_url":"u"}'),
            (2, "hadoop", '{"output":"o"}'),
            (3, "hadoop", '{"input":"i","callback_url":"u"}'),
            (4, "hadoop", "not json"),
            (5, "micro", '{"input":"i","callback_url":"u"}'),
            (6, "micro", '{"input":"","callback_url":""}'),
            (7, "pipeline", '{"ipy_path":"","pipeline":"p"}'),
            (8, "pipeline", '{"ipy_path":"a.ipynb","pipeline":"p"}'),
            (9, "hadoop", '{"input":null,"output":"o","callback_url":"u"}')]
    df = spark.createDataFrame(rows, "id long, variant string, body string")
    got = {r.id: r for r in parse_requests(df).collect()}
    assert got[1].accepted and got[1].code == 200
    assert got[2].error == "required key absent: input" and got[2].code == 400
    assert got[3].error == "required key absent: output"
    assert not got[4].accepted
    assert got[5].accepted and got[5].output == ""
    assert got[6].accepted  # blank is fine outside the pipeline variant
    assert got[7].error == PIPELINE_ERROR and got[8].accepted
    assert got[9].accepted  # a present key with a null value is present


def test_exec_time_mining(spark):
    line = "I0101 12:00:00.000000   42 caffe.cpp:495] execution time: 123 us"
    rows = [(1, f"noise\n{line}\nmore {line.replace('123', '456')}", 0), (2, "nothing here", 0),
            (3, f"I0101 12:00:00.000000 42 CAFFE.CPP:495] EXECUTION TIME: 1\n2 US", 0),
            (4, f"x {line}", 1)]
    df = spark.createDataFrame(rows, "id long, output string, rc long")
    got = {r.id: r.result for r in tk.exec_time_mining(df).collect()}
    assert got[1] == line and got[2] == "nothing here"
    assert got[3].startswith("I0101") and got[3].endswith("US")
    assert got[4] == f"x {line}"


def test_access_log_and_callbacks(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1, 10, 0, 0)
    recs = spark.createDataFrame(
        [("1.2.3.4", "POST", "/hadoop", "HTTP/1.1", 200, None, t, t + dt.timedelta(milliseconds=12.5)),
         ("1.2.3.4", "GET", "/favicon.ico", "HTTP/1.1", 200, "5", t, t)],
        "client string, method string, path string, protocol string, status int, bytes string, "
        "start_ts timestamp, end_ts timestamp")
    lines = [r.log_line for r in tk.access_log_lines(recs).collect()]
    assert lines == ['10:00:00 - INFO - [access] 1.2.3.4 - "POST /hadoop HTTP/1.1" 200 - - 12.50ms']
    df = spark.createDataFrame([("u1", True, "ok", t)], "u string, s boolean, m string, t timestamp")
    p = df.select(tk.callback_payload(F.col("u"), F.col("s"), F.col("m"), F.col("t")).alias("p")).first().p
    assert json.loads(p) == {"uuid": "u1", "success": True, "message": "ok", "timestamp": "10:00:00"}
    n = df.select(tk.nested_callback_payload(F.col("u"), F.lit("success"), F.lit("c"), F.col("m"),
                                             F.lit("i"), F.lit("o"), F.col("t")).alias("p")).first().p
    assert json.loads(n)["result"]["execution_time"] == "10:00:00"
    assert re.match(r'^\{"uuid":"u1","task_status":"success","result":\{', n)


def test_first_completion_within_random_hot_key(spark):
    import datetime as dt
    import random
    rnd = random.Random(7)
    t0 = dt.datetime(2024, 1, 1)
    def ts():
        return t0 + dt.timedelta(seconds=rnd.randrange(0, 6 * 3600))
    keys = [0] * 300 + [1, 2, 3] * 30            # key 0 holds most rows
    reqs = [(i, k, ts()) for i, k in enumerate(keys)]
    comps = [(k, ts()) for k in [0] * 200 + [1, 2] * 20]
    exp = {}
    for rid, k, t in reqs:
        cands = [c for ck, c in comps if ck == k and t <= c <= t + dt.timedelta(seconds=3600)]
        exp[rid] = "success" if cands else "timeout"
    r = spark.createDataFrame(reqs, "req_id long, k long, ts timestamp")
    c = spark.createDataFrame(comps, "k long, ts timestamp")
    for sub in (1, 7):
        got = {x.req_id: x.status for x in tk.first_completion_within(r.repartition(sub), c, "k", 3600).collect()}
        assert got == exp, sub


def test_first_completion_over_partition_borders(spark):
    """Many small range partitions and Arrow batches: keys that span several
    of them, with and without completions there, null keys, text keys."""
    import datetime as dt
    import random
    rnd = random.Random(8)
    t0 = dt.datetime(2024, 1, 1)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions",
                                          "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")   # keep the partitions apart
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for share in (.5, .05):
            rows = [(i, rnd.choice(["a"] * 9 + ["b", "c", None]), t0 + dt.timedelta(seconds=rnd.randrange(0, 9 * 3600)),
                     int(rnd.random() < share)) for i in range(400)]
            exp = {}
            for i, k, t, kind in rows:
                if not kind:
                    after = [t2 for _, k2, t2, done in rows if done and k2 == k and k is not None and t <= t2 <= t + dt.timedelta(hours=1)]
                    exp[i] = min(after) if after else None
            got = tk.first_done_within(spark.createDataFrame(rows, "req_id long, k string, ts timestamp, kind int"), "k", 3600)
            assert {x.req_id: x.d for x in got.select("req_id", F.timestamp_micros("done_us").alias("d")).collect()} == exp
            assert any(exp.values()) and not all(exp.values())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_completion_sink_roundtrip(spark, tmp_path):
    from fleetlane.sinks import writers
    log = str(tmp_path / "subscribe")
    first = spark.createDataFrame([(U[0], f"logs/{U[0]}.txt"), (U[1], f"logs/{U[1]}.txt")],
                                  "uuid string, path string")
    writers.write_completion(first, log)
    writers.write_completion(spark.createDataFrame([(U[0], "logs/again.txt")], "uuid string, path string"),
                             log)
    lines = read_lines(spark, log)
    assert lines.count() == 3  # append: every row once
    got = {r.uuid: (r.path, r.dup_count) for r in tk.first_completions(tk.parse_completions(lines)).collect()}
    assert got == {U[0]: (f"logs/{U[0]}.txt", 2), U[1]: (f"logs/{U[1]}.txt", 1)}


def test_read_lines_across_appended_files(spark, tmp_path):
    root = str(tmp_path / "q")
    write_files(root, {"z-first.txt": "a1\na2\n", "a-second.txt": "b1\n", "m-third.txt": "c1\nc2\nc3"})
    for i, name in enumerate(["z-first.txt", "a-second.txt", "m-third.txt"]):
        os.utime(os.path.join(root, name), (1_700_000_000 + i, 1_700_000_000 + i))
    df = read_lines(spark, root)
    assert [r.value for r in df.orderBy("pos").collect()] == ["a1", "a2", "b1", "c1", "c2", "c3"]
    head = tk.queue_head(df, 4)
    assert [r.uuid for r in head.orderBy("pos").collect()] == ["a1", "a2", "b1", "c1"]
    assert [r.value for r in tk.queue_pop(df, 2).orderBy("pos").collect()] == ["b1", "c1", "c2", "c3"]
