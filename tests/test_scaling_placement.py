"""F12 scaling ticks, F13 placement, F7 contrast goldens."""

from pyspark.sql import functions as F

from fleetlane.operators import contrast as ct
from fleetlane.operators import placement as pl
from fleetlane.operators import scaling as sc
from fleetlane.operators.indexing import clamped_depth, range_rank


def test_service_policy_cases(spark):
    cases = [(0, 1, "hold", 1), (0, 3, "shrink", 1), (1, 1, "hold", 1), (4, 2, "extend", 4),
             (9, 2, "extend", 6), (9, 6, "hold", 6), (2, 5, "hold", 5)]
    df = spark.createDataFrame([(d, g) for d, g, _, _ in cases], "depth long, groups long")
    got = [(r.depth, r.groups, r.action, r.target) for r in sc.service_policy(df, 6).collect()]
    assert sorted(got) == sorted(cases)


def test_queue_depth_running_sum(spark):
    d = spark.createDataFrame([("h1", 1), ("h1", 1), ("h2", -1), ("h3", -1), ("h3", -1), ("h4", 1)],
                              "tick string, delta int")
    got = [(r.tick, r.depth) for r in sc.queue_depth(d).orderBy("tick").collect()]
    assert got == [("h1", 2), ("h2", 1), ("h3", 0), ("h4", 1)]  # an empty queue stays empty


def test_clamped_depth_over_many_ranges(spark):
    """Equal to removing one by one, however the rows fall into ranges."""
    import random
    rnd = random.Random(1)
    for n, step in ((1, 1), (400, 3), (400, 40)):
        deltas = [rnd.randint(-step, step) - (i > n // 2) for i in range(n)]
        want, depth = [], 0
        for x in deltas:
            depth = max(0, depth + x)
            want.append(depth)
        df = spark.createDataFrame([(i, x) for i, x in enumerate(deltas)], "t long, delta long").repartition(5)
        got = [r.depth for r in clamped_depth(df, ["t"]).orderBy("t").collect()]
        assert got == want and 0 in got
    assert clamped_depth(df.limit(0), ["t"]).count() == 0


def test_no_window_over_all_ticks(spark):
    """Windows without a key see one row per range partition only."""
    d = spark.createDataFrame([("h1", 1)], "tick string, delta int")
    plan = sc.queue_depth(d)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    keyless = [x for x in windows if "_pid" not in x.split("windowspecdefinition(")[1].split(" ASC")[0]]
    assert windows and not keyless


def test_observed_groups(spark):
    listing = spark.createDataFrame([("t1", "hadoop-master-0"), ("t1", "hadoop-master-0"), ("t1", "hadoop-master-3"),
                                     ("t2", "registry-1"), ("t3", "hadoop-slave-1-1")], "tick string, name string")
    up = sc.groups_up(listing)
    assert {r.tick: r.groups for r in up.collect()} == {"t1": 2, "t2": 0, "t3": 0}
    ticks = spark.createDataFrame([("t1", 0), ("t2", 3), ("t4", 9)], "tick string, depth long")
    got = {r.tick: (r.groups, r.action, r.target) for r in sc.scale_decision(ticks, up).collect()}
    assert got == {"t1": (2, "shrink", 1), "t2": (1, "extend", 3), "t4": (1, "extend", 6)}


def test_scale_actions_members(spark):
    d = spark.createDataFrame([("t1", 1, "extend", 3), ("t2", 4, "shrink", 1), ("t3", 2, "hold", 2)],
                              "tick string, groups long, action string, target long")
    got = sorted((r.tick, r.step, r.group_no) for r in sc.scale_actions(d).collect())
    assert got == [("t1", 1, 1), ("t1", 2, 2), ("t2", 1, 3), ("t2", 2, 2), ("t2", 3, 1)]
    m = sc.scale_actions(d).first().members
    assert m == "hadoop-master-1,hadoop-slave-1-1,hadoop-slave-1-2"


def _workers(spark, names):
    return pl.index_workers(spark.createDataFrame([(n,) for n in names], "name string"))


def test_placement_cases(spark):
    w = _workers(spark, ["hadoop-master-2", "hadoop-master-0", "hadoop-master-1"])
    tasks = spark.createDataFrame([(p, p, c) for p, c in enumerate(
        ["hadoop-master-0", "hadoop-master-1", "hadoop-master-0", "hadoop-master-0", "hadoop-master-2"])],
        "pos long, rank0 long, container string")
    got = {r.pos: r.new_container for r in pl.worker_reassign(tasks, w).collect()}
    assert got == {0: "hadoop-master-0", 1: "hadoop-master-1", 2: "hadoop-master-2",
                   3: "hadoop-master-0", 4: "hadoop-master-2"}
    single = {r.pos: r.new_container for r in pl.worker_reassign(tasks, _workers(spark, ["hadoop-master-0"])).collect()}
    assert single[2] == "hadoop-master-0"
    new = {r.pos: r.container for r in pl.worker_assign_new(tasks.drop("container"), w).collect()}
    assert new == {0: "hadoop-master-1", 1: "hadoop-master-2", 2: "hadoop-master-1", 3: "hadoop-master-2",
                   4: "hadoop-master-1"}
    only0 = pl.worker_assign_new(tasks.drop("container"), _workers(spark, ["hadoop-master-0"]))
    assert {r.container for r in only0.collect()} == {"hadoop-master-0"}
    none = pl.worker_assign_new(tasks.drop("container"), _workers(spark, []).limit(0))
    assert {r.container for r in none.collect()} == {pl.DEFAULT_WORKER}
    rr = {r.pos: r.container for r in pl.worker_assign(tasks.drop("container"), w).collect()}
    assert rr == {0: "hadoop-master-0", 1: "hadoop-master-1", 2: "hadoop-master-2", 3: "hadoop-master-0",
                  4: "hadoop-master-1"}


def test_workers_text_order(spark):
    w = _workers(spark, ["hadoop-master-2", "hadoop-master-10", "hadoop-master-0"])
    assert [r.name for r in w.orderBy("widx").collect()] == ["hadoop-master-0", "hadoop-master-10",
                                                             "hadoop-master-2"]


def test_ranks_match_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 + 3).alias("pos"))
    r = {r.pos: r.rank0 for r in range_rank(df.repartition(7), ["pos"]).collect()}
    assert r == {7 * i + 3: i for i in range(5000)}


# Benchmark makespans (seconds, n = 1..15) of the reference
# runs used as goldens: elastic-from-zero vs. no-scaling at n = 10, and the
# 2-host elastic series by total tasks and by average tasks per host.
B8_N10, B9_N10 = 123.429, 94.657
B12 = [65.554, 58.649, 61.790, 65.177, 62.811, 71.838, 73.860, 73.961, 79.639, 81.998, 82.563,
       83.191, 102.655, 102.915, 98.424]
B14 = [58.649, 65.177, 71.838, 73.961, 81.998, 83.191, 102.915, 102.386, 106.017, 122.526, 126.466,
       140.656, 150.064, 154.065, 162.720]


def test_phase_share_golden(spark):
    s = spark.createDataFrame([("warm", 1, 10, B9_N10), ("cold", 1, 10, B8_N10), ("cold", 1, 11, 1.0)],
                              "strategy string, nodes long, n_tasks long, seconds double")
    r = ct.phase_share(s, "warm", "cold").collect()
    assert len(r) == 1 and r[0].work_pct == 76.7 and r[0].scaling_pct == 23.3
    zero = spark.createDataFrame([("warm", 1, 1, 1.0), ("cold", 1, 1, 0.0001)], s.schema)
    assert ct.phase_share(zero, "warm", "cold").first().work_pct is None


def test_strategy_join_keeps_node_counts(spark):
    s = spark.createDataFrame([("a", 1, 5, 10.0), ("a", 2, 5, 20.0), ("b", 2, 5, 7.0)],
                              "strategy string, nodes long, n_tasks long, seconds double")
    got = sorted(tuple(r) for r in ct.strategy_join(s, ["a", "b"]).fillna(0).collect())
    assert got == [(1, 5, 10.0, 0.0), (2, 5, 20.0, 7.0)]
    c = {r.tasks_per_node: (r.sec_1, r.sec_2) for r in ct.node_contrast(
        spark.createDataFrame([("e", 1, 2, 3.0), ("e", 2, 4, 5.0)], s.schema), [1, 2]).collect()}
    assert c == {2: (3.0, 5.0)}


def test_keys_beyond_32_bits(spark):
    from fleetlane.functions.ids import standin_uuid
    from fleetlane.operators import tasks as tk
    keys = [1, (1 << 32) - 1, 1 << 32, (1 << 32) + 1, 1 << 40]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    lines = df.select(F.col("k").alias("pos"), F.concat(standin_uuid(F.col("k")), F.lit(":::logs/a:::b")).alias("value"))
    parsed = tk.parse_completions(lines)
    assert tk.first_completions(parsed).count() == 5 and {r.path for r in parsed.collect()} == {"logs/a:::b"}
    tasks = df.select("k", F.col("k").alias("pos"), standin_uuid(F.col("k")).alias("uuid"), F.lit("i").alias("input"))
    assert tk.pending_tasks(tasks, parsed).count() == 0
    assert tk.completion_match(tasks, tk.first_completions(parsed)).count() == 5
    arr = df.select(F.col("k").alias("pos"), (F.col("k") % 2).alias("day"))
    got = [r.pos for r in pl.queue_length_at_arrival(arr, spark.createDataFrame([], "day long"))
           .orderBy("queue_len").collect()]
    assert got == sorted(keys, key=lambda k: (k % 2, k))


def test_node_normalise_golden(spark):
    s = spark.createDataFrame([("elastic", 2, n + 1, v) for n, v in enumerate(B12)],
                              "strategy string, nodes long, n_tasks long, seconds double")
    got = [r.seconds for r in ct.node_normalise(s).orderBy("tasks_per_node").collect()]
    assert got == B14[:7]


def test_series_contrast_pivot(spark):
    s = spark.createDataFrame([(1, 0, 1.0), (2, 0, 2.0), (1, 1, 3.0)], "run_id long, idx long, value double")
    rows = {r.idx: (r.run_1, r.run_2) for r in ct.series_contrast(s, [1, 2]).collect()}
    assert rows == {0: (1.0, 2.0), 1: (3.0, None)}


def test_queue_length_at_arrival(spark):
    # day 1: tasks 1,2 arrive; day 2: task 1 finishes, task 3 arrives; day 3: task 4 arrives
    arr = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3)], "pos long, day long")
    rem = spark.createDataFrame([(2,)], "day long")
    got = {r.pos: r.queue_len for r in pl.queue_length_at_arrival(arr, rem).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 2}
    # more tasks finish than are queued: the queue is empty, not in debt
    rem = spark.createDataFrame([(0,), (1,), (1,), (1,), (1,)], "day long")
    got = {r.pos: r.queue_len for r in pl.queue_length_at_arrival(arr, rem).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1}
