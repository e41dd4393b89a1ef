"""Streaming twins: several files, one per micro-batch, so late and
duplicate rows really cross batch boundaries."""

import datetime as dt
import os
import random

import pytest

import pandas as pd

from fleetlane.operators import tasks as tk
from fleetlane.streaming import dedup as sdd
from fleetlane.streaming import end_phase as sep
from fleetlane.streaming import lifecycle as slc
from fleetlane.streaming import match as smt
from fleetlane.streaming import runner as srun
from fleetlane.streaming import usage as sus

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _batches(spark, folder, batches):
    """One parquet file per batch, modification times in batch order."""
    os.makedirs(folder, exist_ok=True)
    for i, rows in enumerate(batches):
        sub = os.path.join(folder, f"_tmp{i}")
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(sub)
        part = [f for f in os.listdir(sub) if f.endswith(".parquet")][0]
        dst = os.path.join(folder, f"batch{i:03d}.parquet")
        os.replace(os.path.join(sub, part), dst)
        os.utime(dst, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    return folder


def _stream(spark, folder):
    """One micro-batch per file; the end marker is the newest file."""
    from pyspark.sql.types import _parse_datatype_string
    schema = _parse_datatype_string(SCHEMA)
    dst = srun.append_end_marker(spark, folder, schema, {"event_id": -1, "ts": srun.END_TS,
                                                         "event_type": srun.END_TYPE})
    local = dst.replace("file:", "")
    os.utime(local, (1_800_000_000, 1_800_000_000))
    return srun.file_stream(spark, folder + "/*.parquet", schema, max_files=1)


def ev(i, minutes, user, typ, value=1.0):
    return (i, T0 + dt.timedelta(minutes=minutes), user, typ, value)


def _brute_lifecycle(rows, timeout_s=3600):
    pdf = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value"])
    pdf["t_us"] = pdf["ts"].map(lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6))
    out = set()
    for user, g in pdf.sort_values(["t_us", "event_id"]).groupby("user_id"):
        done, open_task = slc.step(zip(g["t_us"], g["event_type"]), None, timeout_s * 1_000_000)
        if open_task is not None:
            done.append((open_task[1], open_task[1] + timeout_s * 1_000_000, "timeout"))
        out |= {(user, s, e, st) for s, e, st in done}
    return out


def test_lifecycle_matches_brute_force(spark, tmp_path):
    b1 = [ev(1, 0, 1, "signup"), ev(2, 1, 1, "signup"), ev(3, 5, 1, "click"), ev(4, 2, 2, "signup")]
    b2 = [ev(5, 20, 1, "purchase"), ev(6, 21, 1, "purchase"), ev(7, 30, 3, "signup"),
          ev(8, 100, 2, "purchase")]   # user 2: purchase after the timeout
    b3 = [ev(9, 120, 3, "error"), ev(10, 130, 1, "signup"), ev(11, 140, 4, "signup")]
    folder = _batches(spark, str(tmp_path / "lc"), [b1, b2, b3])
    out = srun.run_append(spark, slc.lifecycle_stream(_stream(spark, folder)), "t_lc", rocksdb=True)
    got = {(r.key, r.submit_us, r.end_us, r.status) for r in out.collect()}
    assert got == _brute_lifecycle(b1 + b2 + b3)
    assert {st for *_, st in got} == {"success", "timeout"}


def test_lifecycle_of_files_whose_times_overlap(spark, tmp_path):
    late = [[ev(1, 5, 1, "signup"), ev(2, 0, 2, "signup"), ev(3, 30, 2, "purchase")],
            [ev(4, 1, 1, "signup"), ev(5, 3, 1, "purchase"), ev(6, 10, 2, "error"), ev(7, 20, 2, "signup")],
            [ev(8, 50, 1, "purchase"), ev(9, 40, 3, "signup"), ev(10, 20, 3, "signup")]]
    # minutes 0 to 200 shuffled by at most 45: inside the delay of an hour
    rnd = random.Random(4)
    types = ["signup", "signup", "click", "purchase", "error", "view"]
    rows = [ev(20 + m, m, 10 + m % 3, rnd.choice(types)) for m in range(200)]
    rows.sort(key=lambda r: r[1] + dt.timedelta(minutes=rnd.randint(0, 45)))
    late += [rows[i:i + 20] for i in range(0, 200, 20)]
    folder = _batches(spark, str(tmp_path / "lo"), late)
    out = srun.run_append(spark, slc.lifecycle_stream(_stream(spark, folder)), "t_lo", rocksdb=True)
    got = sorted((r.key, r.submit_us, r.end_us, r.status) for r in out.collect())
    assert got == sorted(_brute_lifecycle([r for b in late for r in b]))


def test_usage_windows_equal_batch(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(seconds=3 * i), 1, "view", float(i)) for i in range(40)]
    folder = _batches(spark, str(tmp_path / "u"), [rows[:15], rows[15:30], rows[30:]])
    out = srun.run_append(spark, sus.usage_windows(_stream(spark, folder), "value"), "t_usage")
    got = {r.w.start: r.value for r in out.collect()}
    exp = {}
    for i, t, *_ in rows:
        us_ = int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
        start = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us_ - us_ % 6_500_000)
        exp[start] = exp.get(start, 0.0) + float(i)
    assert got == exp


SAMPLES = "run long, sample_id long, ts timestamp, is_marker boolean"


def _sample_files(spark, folder, parts):
    """Files of (run, sample_id, minute, is_marker) rows and the end marker."""
    from pyspark.sql.types import _parse_datatype_string
    schema = _parse_datatype_string(SAMPLES)
    os.makedirs(folder)
    for i, rows in enumerate(parts):
        sub = f"{folder}/_t{i}"
        rows = [(r, sid, T0 + dt.timedelta(minutes=m), k) for r, sid, m, k in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(sub)
        part = [f for f in os.listdir(sub) if f.endswith(".parquet")][0]
        os.replace(f"{sub}/{part}", f"{folder}/b{i}.parquet")
        os.utime(f"{folder}/b{i}.parquet", (1_700_000_000 + i,) * 2)
    s = srun.file_stream(spark, folder + "/*.parquet", schema, max_files=1)
    return srun.with_end_marker(spark, s, schema, {"ts": srun.END_TS, "is_marker": False})


def test_end_phase_stream(spark, tmp_path):
    """Late samples and a late marker, across files, inside the delay."""
    parts = [[(1, 0, 0, False), (1, 1, 10, False), (2, 20, 0, False)],
             [(1, 3, 30, False), (1, 4, 31, False), (1, None, 20, True)],       # the marker came late
             [(1, 2, 15, False), (1, 6, 33, False), (1, 5, 32, False), (1, 7, 34, False), (1, 8, 35, False)],
             [(2, 21, 200, True), (2, 22, 201, False), (1, 9, 300, False)]]     # a sample may be the marker
    s, marker = _sample_files(spark, str(tmp_path / "s"), parts)
    out = srun.run_append(spark, sep.end_phase_stream(s, 4), "t_end", marker=marker)
    got = sorted((r.run, r.sample_id, r.phase, r.closed) for r in out.collect())
    assert got == ([(1, i, "", False) for i in range(3)] + [(1, i, "end", i == 6) for i in range(3, 7)]
                   + [(2, 20, "", False), (2, 21, "", False), (2, 22, "end", False)])


def test_end_phase_stops_when_all_runs_are_closed(spark, tmp_path):
    parts = [[(r, i, i + r, i == 2) for i in range(9)] for r in (1, 2)]
    parts.append([(3, 1, 600, False)])  # moves the watermark past both runs
    s, _ = _sample_files(spark, str(tmp_path / "s"), parts)
    w = (sep.end_phase_stream(s, 4).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "o"))
         .option("checkpointLocation", str(tmp_path / "c")))
    assert sep.run_until_closed(spark, w, 2, timeout_s=120)
    assert not spark.streams.active
    assert spark.read.parquet(str(tmp_path / "o")).where("closed").count() == 2


def test_end_phase_state_expires(spark, tmp_path):
    days = 24 * 60
    parts = [[(r, r, r, False) for r in range(1, 6)], [(6, 6, 3 * days, False)], [(7, 7, 30 * days, False)],
             [(8, 8, 60 * days, False)], [(9, 9, 61 * days, False)]]
    s, _ = _sample_files(spark, str(tmp_path / "s"), parts)
    rows = []
    q = (sep.end_phase_stream(s, 4, linger_s=7 * 86400).writeStream.outputMode("append").format("parquet")
         .option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    q.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(rows) >= 6 and rows[-1] <= 2


def test_queue_text_stream(spark, tmp_path):
    from fleetlane.streaming.sources import line_stream
    folder = tmp_path / "queue"
    folder.mkdir()
    u = ["5f0c2a10-1d3e-11ee-9c4b-0242ac120002", "6a7d3b24-1d3e-11ee-9c4b-0242ac120002"]
    for i, text in enumerate([f"sh run-wordcount2.sh input/input1 output/output1 {u[0]}\n\n",
                              f"sh run-wordcount2.sh input/input2 output/output2 {u[1]}\n"]):
        p = folder / f"append-{i}.txt"
        p.write_text(text)
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    s = tk.parse_queue(line_stream(spark, str(folder), max_files=1))
    out = srun.run_append(spark, s, "t_queue_text")
    rows = [(r.input, r.uuid) for r in out.orderBy("pos").collect()]
    assert rows == [("input/input1", u[0]), ("input/input2", u[1])]


def test_first_match_stream_multi_batch(spark, tmp_path):
    folder = _batches(spark, str(tmp_path / "fm"), [
        [ev(1, 0, 1, "signup"), ev(2, 10, 2, "signup"), ev(3, 50, 1, "purchase")],
        [ev(4, 40, 1, "purchase"), ev(7, 30, 3, "signup")],   # earlier completion for user 1 arrives later
        [ev(5, 300, 9, "purchase")],                          # watermark -> 04:00
        [ev(6, 20, 2, "purchase"), ev(8, 35, 3, "purchase")],  # late: dropped
    ])
    out = srun.run_append(spark, smt.first_match_stream(_stream(spark, folder)), "t_fm")
    got = {r.req_id: (r.status, r.done_us) for r in out.collect()}
    us = lambda m: int((T0 + dt.timedelta(minutes=m) - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert got == {1: ("success", us(40)), 2: ("timeout", None), 7: ("timeout", None)}


def test_first_match_stream_equals_batch(spark, tmp_path):
    import random
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        user = 0 if i % 3 else rnd.randrange(1, 6)          # user 0 is hot
        rows.append(ev(i, rnd.randrange(0, 8 * 60), user, rnd.choice(["signup", "purchase", "view"])))
    rows.sort(key=lambda r: r[1])
    folder = _batches(spark, str(tmp_path / "fmb"), [rows[j:j + 100] for j in range(0, 400, 100)])
    out = srun.run_append(spark, smt.first_match_stream(_stream(spark, folder)), "t_fmb")
    got = {r.req_id: r.status for r in out.collect()}
    exp = {}
    for rid, t, user, typ, _ in rows:
        if typ == "signup":
            c = [t2 for _, t2, u2, typ2, _ in rows
                 if u2 == user and typ2 == "purchase" and t <= t2 <= t + dt.timedelta(hours=1)]
            exp[rid] = "success" if c else "timeout"
    assert got == exp


def _v1(ticks: int) -> str:
    """A version-1 id of a 60-bit time of our own."""
    import uuid as _uuid
    return str(_uuid.UUID(fields=(ticks & 0xFFFFFFFF, (ticks >> 32) & 0xFFFF, 0x1000 | ((ticks >> 48) & 0x0FFF),
                                  0x9C, 0x4B, 0x0242AC120002)))


def test_first_completion_wins_over_a_long_stream(spark, tmp_path):
    """Thirty days in files out of order, repeats weeks later: the earliest
    line wins, the stream keeps no state, and a batch reads only the days
    of its own ids."""
    from fleetlane.streaming.sources import line_stream
    rnd = random.Random(3)
    day = 24 * 3600 * 10 ** 7
    ids = [_v1(0x1EE1D3E5F0C2A10 + (i // 4) * day + rnd.randrange(day)) for i in range(120)]
    lines = [(d, f"{u}:::logs/{d}-{i}") for i, u in enumerate(ids) for d in {i // 4, i // 4 + rnd.randint(0, 9)}]
    lines += [(35, f"{ids[0]}:::logs/late"), (35, "broken-id:::x"), (36, f"sh run x y {ids[5]}")]
    by_day = {}
    for d, text in lines:
        by_day.setdefault(d, []).append(text)
    order = sorted(by_day)
    for i in range(0, len(order) - 1, 5):      # neighbouring days arrive swapped
        order[i], order[i + 1] = order[i + 1], order[i]
    folder = tmp_path / "log"
    folder.mkdir()
    for d in order:
        p = folder / f"day-{d:02d}"
        p.write_text("\n".join(by_day[d]) + "\n")
        os.utime(p, (1_700_000_000 + d, 1_700_000_000 + d))
    parsed = tk.parse_completions(line_stream(spark, str(folder), max_files=3))
    out, read = str(tmp_path / "firsts"), []

    def write(df, batch_id, path):
        days = [r[0] for r in sdd.batch_firsts(df).select("day").distinct().collect()]
        files = sdd.written(spark, path, sdd._schema(df), days, batch_id).inputFiles()
        read.append({int(f.split("day=")[1].split("/")[0]) for f in files} - set(days))
        sdd.write_firsts(df, batch_id, path)

    q = srun.foreach_batch(parsed, write, out, out + "-c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert not any(p["stateOperators"] for p in q.recentProgress)
    assert len(read) > 5 and not any(read)
    got = {r.uuid: r.path for r in sdd.read_firsts(spark.read.parquet(out)).collect()}
    want = {}
    for d in sorted(by_day):
        for text in by_day[d]:
            u = text.split(":::")[0] if ":::" in text else text.split()[-1]
            want.setdefault(u, text.split(":::")[1] if ":::" in text else None)
    del want["broken-id"]
    assert got == want
    # a batch that is run again changes nothing
    df = tk.parse_completions(spark.createDataFrame([(1, f"{ids[7]}:::logs/x")], "pos long, value string"))
    for _ in range(2):
        sdd.write_firsts(df, 99, str(tmp_path / "again"))
    assert spark.read.parquet(str(tmp_path / "again")).count() == 1


def test_stream_scale_equals_batch(spark, tmp_path):
    """Depth continues over triggers and a restart, without the driver."""
    import random
    from pyspark.sql import functions as F
    from fleetlane.operators import scaling as sc
    from fleetlane.plans.standins import listed_name
    from fleetlane.streaming import scale as ssc
    rnd = random.Random(5)
    rows = sorted((ev(i, rnd.randrange(0, 48 * 60), rnd.randrange(1, 9),
                      rnd.choice(["signup", "purchase", "purchase", "view"])) for i in range(600)),
                  key=lambda r: r[1])
    # ticks span files, and rows of neighbouring files overlap by minutes
    parts = [sorted(rows[k * 120:(k + 1) * 120 + 5][5 * (k > 0):], key=lambda r: r[0]) for k in range(5)]
    folder = _batches(spark, str(tmp_path / "sc"), parts)
    s = _stream(spark, folder)
    delta = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", -1)
    ticks = ssc.closed_ticks(s.withColumn("delta", delta).withColumn("name", listed_name()))
    got = srun.run_append(spark, ssc.decisions_stream(ticks), "t_scale", rocksdb=True, state_partitions=2)
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("tick", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss"))
    bd = batch.where(F.col("event_type").isin("signup", "purchase")).select(
        "tick", F.when(F.col("event_type") == "signup", 1).otherwise(-1).alias("delta"))
    up = sc.groups_up(batch.select("tick", listed_name().alias("name")))
    exp = sc.scale_decision(sc.queue_depth(bd), up).select("tick", "depth", "groups", "action", "target")
    assert sorted(got.collect()) == sorted(exp.collect())
    assert got.count() > 20 and {0} < {r.depth for r in got.collect()}


def test_snapshot_files_stream_per_window(spark, tmp_path):
    from fleetlane.operators import usage as us
    from fleetlane.sources.stats import snapshot_stream
    hdr = "NAME,CPU %,MEM USAGE / LIMIT,MEM %\n"
    root = tmp_path / "stats"
    t0 = 1_700_000_000.0
    exp = {}
    for i in range(1, 9):
        d = root / "resource_1"
        d.mkdir(parents=True, exist_ok=True)
        p = d / f"resource_log_{i}"
        p.write_text(hdr + f"hadoop-master-0,{i}.00%,1GiB / 62.36GiB,1.60%\n"
                           f"hadoop-slave-0-1,0.50%,1GiB / 62.36GiB,1.60%\n")
        t = t0 + 6.5 * i
        os.utime(p, (t, t))
        start = t - (t % 6.5)
        exp[start] = round(i / 100 + 0.005, 3)
    end = root / "resource_1" / "resource_log_end_1"   # far later: closes every window
    end.write_text(hdr + "hadoop-master-0,0.00%,1GiB / 62.36GiB,1.60%\n")
    os.utime(end, (t0 + 10_000, t0 + 10_000))
    typed = us.typed_stats(snapshot_stream(spark, str(root), max_files=1), keep=["ts"])
    out = srun.run_append(spark, sus.usage_windows(typed, "cpu", delay="1 minute", keys=["run_id"]),
                          "t_snap")
    got = {r.w.start.timestamp(): r.cpu for r in out.collect()}  # naive local time, round-trips
    assert got == exp


STREAM_KEYS = ["stream_match", "stream_lifecycle", "stream_usage", "stream_scale", "stream_end_phase", "stream_dedup"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables not present")
@pytest.mark.parametrize("key", STREAM_KEYS)
def test_registered_streams_do_not_depend_on_batches(spark, tmp_path, monkeypatch, key):
    """One batch against four files, one per batch."""
    from fleetlane.plans import catalog
    sf = "/root/testdata/sf0.001"
    name, order = ("lineitem", "l_shipdate") if key == "stream_dedup" else ("events", "ts")
    t = spark.read.parquet(f"{sf}/{name}.parquet").toPandas().sort_values(order, kind="stable")
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    folder = tmp_path / f"{name}.parquet"
    folder.mkdir()
    for i in range(4):
        sub = str(tmp_path / f"part{i}")
        part = t.iloc[len(t) * i // 4:len(t) * (i + 1) // 4]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(sub)
        f = [x for x in os.listdir(sub) if x.endswith(".parquet")][0]
        os.replace(os.path.join(sub, f), folder / f"b{i}.parquet")
        os.utime(folder / f"b{i}.parquet", (1_700_000_000 + i * 10,) * 2)
    one = sorted(map(str, catalog.REGISTRY[key](spark, sf).collect()))
    real = srun.file_stream
    monkeypatch.setattr(catalog.srun, "file_stream",
                        lambda s, p, sc, fmt="parquet", max_files=None: real(s, p, sc, fmt, 1))
    assert sorted(map(str, catalog.REGISTRY[key](spark, str(tmp_path)).collect())) == one
    assert one
