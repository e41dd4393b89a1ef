"""snapshot CSVs -> typed rows -> sums, time axis, alignment, groups."""

import os

from pyspark.sql import functions as F

from file_trees import write_files
from fleetlane.operators import usage as us
from fleetlane.sinks import writers
from fleetlane.sources.stats import read_snapshots

HDR = "NAME,CPU %,MEM USAGE / LIMIT,MEM %\n"


def _snap(rows):
    return HDR + "".join(",".join(r) + "\n" for r in rows)


def _tree(tmp_path):
    one = [("hadoop-slave-0-2", "1.72%", "726.2MiB / 62.36GiB", "1.14%"),
           ("hadoop-slave-0-1", "1.74%", "704.6MiB / 62.36GiB", "1.10%"),
           ("hadoop-master-0", "2.30%", "1.078GiB / 62.36GiB", "1.73%")]
    two = one + [("hadoop-master-1", "186.39%", "1.227MiB / 62.36GiB", "0.00%"),
                 ("hadoop-slave-1-1", "6.10%", "1.23MiB / 62.36GiB", "0.00%")]
    files = {}
    for i in range(1, 12):  # _10 and _11 sort before _2 as text
        files[f"resource_1/resource_log_{i}"] = _snap(one if i < 5 else two)
    for j in range(1, 5):
        files[f"resource_1/resource_log_end_{j}"] = _snap(one)
    files["resource_2/resource_log_1"] = _snap(two)
    return write_files(str(tmp_path / "stats"), files)


def test_scan_identity_and_typing(spark, tmp_path):
    root = _tree(tmp_path)
    raw = read_snapshots(spark, os.path.join(root, "resource_*"))
    assert raw.count() == 4 * 3 + 7 * 5 + 4 * 3 + 5
    t = us.typed_stats(raw)
    m = t.where((F.col("run_id") == 1) & (F.col("sample_no") == 5) & (F.col("name") == "hadoop-master-1")).first()
    assert (m.role, m.group_no, m.slot) == ("master", 1, 0)
    assert float(m.cpu) == 1.8639 and m.mem_used == round(1.227 * 1024 ** 2)
    s = t.where(F.col("name") == "hadoop-slave-0-2").first()
    assert (s.role, s.group_no, s.slot) == ("slave", 0, 2) and s.mem_used == round(726.2 * 1024 ** 2)
    assert s.mem_limit == round(62.36 * 1024 ** 3)
    # memory invariant: MEM % = 100 * used / limit within 0.006 points
    bad = t.where(F.abs(F.col("mem_used") / F.col("mem_limit") * 100 - F.col("mem") * 100) > 0.006)
    assert bad.count() == 0
    assert set(r.phase for r in t.select("phase").distinct().collect()) == {"", "end"}


def test_cpu_sum_and_axis(spark, tmp_path):
    t = us.typed_stats(read_snapshots(spark, os.path.join(_tree(tmp_path), "resource_*")))
    cpu = us.usage_by_snapshot(t, "cpu")
    first = cpu.where((F.col("run_id") == 1) & (F.col("sample_no") == 1) & (F.col("phase") == "")).first()
    assert first.cpu == 0.058  # 1.72 + 1.74 + 2.30 %
    ax = {(r.phase, r.sample_no): (r.idx, r.t_sec)
          for r in us.time_axis(cpu, 0.0, 6.5).where("run_id = 1").collect()}
    assert ax[("", 2)] == (1, 6.5) and ax[("", 10)] == (9, 58.5) and ax[("end", 1)] == (11, 71.5)
    head = us.series_head(cpu, 3).where("run_id = 1").orderBy("sample_no").collect()
    assert [r.sample_no for r in head] == [1, 2, 3]


def test_series_align_lengths_and_padding(spark):
    rows = [(1, "", i, float(i)) for i in range(1, 8)] + [(2, "", i, 10.0 + i) for i in range(1, 5)]
    s = spark.createDataFrame(rows, "run_id long, phase string, sample_no long, cpu double")
    out = us.series_align(s, "cpu", 1, 0.0, 6.5)
    per_run = {r.run_id: r.n for r in out.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert per_run == {1: 6, 2: 6}  # L = longest measured run
    r2 = [(r.idx, r.value, r.padded) for r in out.where("run_id = 2").orderBy("idx").collect()]
    assert r2 == [(0, 12.0, False), (1, 13.0, False), (2, 14.0, False), (3, 14.0, True),
                  (4, 14.0, True), (5, 14.0, True)]


def test_group_timeline_and_name_count(spark, tmp_path):
    t = us.typed_stats(read_snapshots(spark, os.path.join(_tree(tmp_path), "resource_1")))
    g = {(r.phase, r.sample_no): (r.n_groups, r.changed) for r in us.group_timeline(t).collect()}
    assert g[("", 4)] == (1, False) and g[("", 5)] == (2, True) and g[("end", 1)] == (1, True)
    c = spark.createDataFrame([(1, "hadoop-master-0"), (1, "hadoop-slave-0-1"), (1, "registry"),
                               (2, "hadoop-master-0"), (2, "hadoop-master-1")], "snap long, name string")
    assert {r.snap: r.n_groups for r in us.name_count(c, ["snap"]).collect()} == {1: 1, 2: 2}
    f = us.fleet_filter(c.union(spark.createDataFrame([(3, "hadoop-x-"), (3, "my-hadoop-master-9z")],
                                                      "snap long, name string")))
    assert f.where("name = 'registry' or name = 'hadoop-x-'").count() == 0
    assert f.where("name = 'my-hadoop-master-9z'").count() == 1


def test_stats_sink_roundtrip(spark, tmp_path):
    t = us.typed_stats(read_snapshots(spark, os.path.join(_tree(tmp_path), "resource_*")))
    out = str(tmp_path / "k4")
    writers.write_stats(t, out)
    writers.write_stats(t, out)  # append
    back = spark.read.parquet(out)
    assert back.count() == 2 * t.count()
    assert back.where("run_id = 2").count() == 2 * 5


def test_end_phase_batch(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, i, t0 + dt.timedelta(seconds=i)) for i in range(10)] + [(2, 0, t0)]
    s = spark.createDataFrame(rows, "run long, sid long, ts timestamp")
    marker = spark.createDataFrame([(1, t0 + dt.timedelta(seconds=3))], "run long, marker_ts timestamp")
    got = sorted((r.run, r.sid, r.phase) for r in us.end_phase(s, "run", "ts", marker, 4).collect())
    assert got == [(1, i, "") for i in range(4)] + [(1, i, "end") for i in range(4, 8)] + [(2, 0, "")]


def test_memory_units_and_malformed(spark):
    from fleetlane.functions import stats as st
    cases = [("512B", 512), ("1.5KiB", 1536), ("2kB", 2000), ("3MB", 3_000_000), ("1GB", 10 ** 9),
             ("726.2MiB", round(726.2 * 1024 ** 2)), ("62.36GiB", round(62.36 * 1024 ** 3)),
             ("1TiB", 1024 ** 4), (" 7MiB ", 7 * 1024 ** 2), ("12", None), ("x MiB", None), ("5 PB", None)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "s string")
    got = [r.b for r in df.select(st.size_bytes(F.col("s")).alias("b")).collect()]
    assert got == [e for _, e in cases]
    pct = spark.createDataFrame([("186.39%",), ("0.00%",), ("n/a",), ("12.5",)], "p string")
    assert [None if r.v is None else float(r.v) for r in pct.select(st.pct_decimal(F.col("p")).alias("v")).collect()] \
        == [1.8639, 0.0, None, 0.125]
    names = spark.createDataFrame([("hadoop-master-3",), ("hadoop-slave-3-2",), ("hadoop-slave-3",),
                                   ("registry",)], "n string")
    got = [(r.role, r.g, r.s) for r in names.select(st.container_role(F.col("n")).alias("role"),
                                                     st.container_group(F.col("n")).alias("g"),
                                                     st.container_slot(F.col("n")).alias("s")).collect()]
    assert got == [("master", 3, 0), ("slave", 3, 2), ("slave", 3, None), (None, None, None)]
