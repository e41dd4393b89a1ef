"""Registered queries: key -> fn(spark, sf_dir) -> DataFrame.

Each query reads the driver's tables (whole tables, no row caps) through
the stand-in views of :mod:`fleetlane.plans.standins` and runs one library
operator on them.  Keys follow SURVEY §2; the SQL twin of every key lives
in :mod:`fleetlane.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlane.functions.ids import standin_uuid
from fleetlane.functions.text import strip_ws
from fleetlane.functions.timefmt import ts_text
from fleetlane.operators import contrast as ct
from fleetlane.operators import placement as pl
from fleetlane.operators import scaling as sc
from fleetlane.operators import tasks as tk
from fleetlane.operators import usage as us
from fleetlane.operators import wordcount as wc
from fleetlane.operators.indexing import range_rank
from fleetlane.plans import standins as si
from fleetlane.session import prepare, scratch_path
from fleetlane.sinks.writers import write_snapshots
from fleetlane.sources.requests import parse_requests
from fleetlane.sources.stats import read_snapshots
from fleetlane.sources.tables import spread, table
from fleetlane.sources.tail import first_lines, growing_lines, last_lines
from fleetlane.streaming import dedup as sdd
from fleetlane.streaming import end_phase as sep
from fleetlane.streaming import lifecycle as slc
from fleetlane.streaming import match as smt
from fleetlane.streaming import runner as srun
from fleetlane.streaming import scale as ssc
from fleetlane.streaming import usage as sus

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def query(key: str):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[key] = run
        return run
    return deco


def _documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("source").alias("input_set")))


# ---------------------------------------------------------------- text family
@query("wordcount")
def q_wordcount(spark, sf_dir):
    """Tokens of every document, counted."""
    return wc.wordcount(_documents(spark, sf_dir))


@query("wordcount_by_set")
def q_wordcount_by_set(spark, sf_dir):
    """One word count per input set (documents.source)."""
    return wc.wordcount_by_set(_documents(spark, sf_dir))


@query("wordcount_sorted")
def q_wordcount_sorted(spark, sf_dir):
    """Word count in byte order of the token."""
    return wc.wordcount_sorted(_documents(spark, sf_dir))


@query("text_scan")
def q_text_scan(spark, sf_dir):
    """Files, lines and characters per input set."""
    return wc.text_scan_summary(_documents(spark, sf_dir))


@query("union_inputs")
def q_union_inputs(spark, sf_dir):
    """Documents and benchmark passages as one bag of inputs."""
    docs = _documents(spark, sf_dir).select(
        "input_set", F.col("doc_id").alias("item_id"), "text")
    bench = table(spark, sf_dir, "benchmark").select(
        F.lit("benchmark").alias("input_set"), "item_id", "text")
    return wc.union_inputs(docs, bench)


@query("task_report")
def q_task_report(spark, sf_dir):
    """K5: every task's report (task = input set) as ordered lines."""
    return wc.task_report_lines(_documents(spark, sf_dir))


# ---------------------------------------------------------------- task family
QUEUE_HEAD_N = 7       # lines the batch controller reads per round
COMPLETION_TAIL_N = 10
# Driver-data pattern for O11 (the prose has no timing lines): the first
# stretch from "the" to "of", across line breaks, any case.
PROSE_PATTERN = "(?is)(the .*? of )"


def _tasks(spark, sf_dir):
    return tk.parse_queue(si.queue_lines(spark, sf_dir))


def _parsed_completions(spark, sf_dir):
    return tk.parse_completions(si.completion_lines(spark, sf_dir))


@query("queue_scan")
def q_queue_scan(spark, sf_dir):
    """Queue lines parsed; blanks skipped, last token = id."""
    return _tasks(spark, sf_dir)


@query("completion_scan")
def q_completion_scan(spark, sf_dir):
    """Both completion formats, bad ids rejected, first per id wins."""
    return tk.first_completions(_parsed_completions(spark, sf_dir))


@query("report_scan")
def q_report_scan(spark, sf_dir):
    """Whole report texts of non-empty files, stripped."""
    d = table(spark, sf_dir, "documents")
    return (d.where(F.length("text") > 0)
             .select(F.col("doc_id").alias("report_id"), strip_ws(F.col("text")).alias("report")))


@query("completion_match")
def q_completion_match(spark, sf_dir):
    """Task queue joined with the deduplicated completion log."""
    return tk.completion_match(_tasks(spark, sf_dir),
                               tk.first_completions(_parsed_completions(spark, sf_dir)))


@query("pending_tasks")
def q_pending_tasks(spark, sf_dir):
    """Queued tasks with no valid completion."""
    return tk.pending_tasks(_tasks(spark, sf_dir), _parsed_completions(spark, sf_dir))


@query("busy_groups")
def q_busy_groups(spark, sf_dir):
    """Containers running at least one open line item."""
    running = (table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == "O")
               .select(F.col("l_suppkey").alias("container_id")))
    return tk.busy_groups(si.containers(spark, sf_dir), running).select("container_id", "name")


@query("result_lookup")
def q_result_lookup(spark, sf_dir):
    """Labelled completions looked up in the report files."""
    return tk.result_lookup(si.label_completions(spark, sf_dir),
                            si.report_files(spark, sf_dir), si.LOG_ROOT)


@query("timeout_status")
def q_timeout_status(spark, sf_dir):
    """Signup -> first purchase of the user within 3,600 s."""
    e = si.event_times(spark, sf_dir).where(F.col("event_type").isin("signup", "purchase"))
    rows = e.select(F.col("event_id").alias("req_id"), "user_id", "ts",
                    F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("kind"))
    r = tk.first_done_within(rows, "user_id", 3600)
    return r.select(F.col("req_id").alias("event_id"), "user_id",
                    ts_text(F.timestamp_micros("submit_us")).alias("submit_ts"),
                    ts_text(F.timestamp_micros("done_us")).alias("done_ts"), "status")


@query("queue_head")
def q_queue_head(spark, sf_dir):
    """The first 7 queue lines, blanks dropped."""
    return tk.queue_head(si.queue_lines(spark, sf_dir), QUEUE_HEAD_N)


@query("queue_pop")
def q_queue_pop(spark, sf_dir):
    """The queue without its first line."""
    return tk.queue_pop(si.queue_lines(spark, sf_dir), 1)


@query("completion_tail")
def q_completion_tail(spark, sf_dir):
    """The newest 10 completion lines."""
    return tk.completion_tail(si.completion_lines(spark, sf_dir), COMPLETION_TAIL_N)


def _written_lines(spark, lines: DataFrame, name: str) -> str:
    """A log written by Spark: ``lines`` in order of pos, then value, over
    several files whose names follow that order."""
    path = scratch_path(spark, name)
    (lines.repartitionByRange("pos", "value").sortWithinPartitions("pos", "value").select("value").write.text(path))
    return path


@query("log_tail")
def q_log_tail(spark, sf_dir):
    """O38 on files: the last lines of a written completion log, read from
    its end by byte ranges."""
    path = _written_lines(spark, si.completion_lines(spark, sf_dir), "completion-log")
    return last_lines(spark, path, COMPLETION_TAIL_N, order="name").select("value")


@query("log_head")
def q_log_head(spark, sf_dir):
    """O36 on files: the first lines of a written queue, blanks dropped."""
    path = _written_lines(spark, si.queue_lines(spark, sf_dir), "queue-log")
    return tk.parse_queue(first_lines(spark, path, QUEUE_HEAD_N, order="name")).drop("pos")


@query("queue_status")
def q_queue_status(spark, sf_dir):
    """Per priority class, tasks, running ones, any running."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("run"),
        F.when(F.col("o_orderstatus") == "O", "running").otherwise("queued").alias("status"))
    return tk.queue_status(o, "run", "status")


@query("exec_time_mining")
def q_exec_time_mining(spark, sf_dir):
    """First pattern match of each job output (short outputs = failed)."""
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("output"),
        F.when(F.col("n_chars") < 100, 1).otherwise(0).cast("bigint").alias("rc"))
    return tk.exec_time_mining(d, PROSE_PATTERN).select("doc_id", "rc", "matched", "result")


@query("access_log")
def q_access_log(spark, sf_dir):
    """Access-log lines of the served requests (icon fetches skipped)."""
    return tk.access_log_lines(si.access_records(spark, sf_dir)).select("event_id", "log_line")


@query("callback_outbox")
def q_callback_outbox(spark, sf_dir):
    """JSON callbacks of finished (F) and timed-out (O) tasks; urgent
    tasks report with the nested result payload."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    uuid = si.standin_uuid(F.col("o_orderkey"))
    ok = F.col("o_orderstatus") == "F"
    out_path = F.concat(F.lit("output/o"), F.col("o_orderkey").cast("string"))
    in_path = F.concat(F.lit("input/c"), F.col("o_custkey").cast("string"))
    msg = F.when(ok, F.concat(F.lit("wordcount finished: "), out_path)).otherwise(
        F.lit(tk.TIMEOUT_MESSAGE))
    flat = tk.callback_payload(uuid, ok, msg, F.col("o_orderdate"))
    nested = tk.nested_callback_payload(
        uuid, F.when(ok, "success").otherwise("failed"),
        F.concat(F.lit(tk.JOB_CMD + " "), in_path, F.lit(" "), out_path),
        msg, in_path, out_path, F.col("o_orderdate"))
    payload = F.when(F.col("o_orderpriority") == "1-URGENT", nested).otherwise(flat)
    return o.select(uuid.alias("uuid"), payload.alias("payload"))


@query("request_scan")
def q_request_scan(spark, sf_dir):
    """Request bodies checked for their variant's required keys."""
    return parse_requests(si.request_bodies(spark, sf_dir)).drop("body", "ts")


# --------------------------------------------------------------- usage family
SERIES_SKIP = 3      # warm-up snapshots dropped before aligning runs
SERIES_HEAD_N = 34   # snapshots kept by series_head


def _typed(spark, sf_dir):
    return us.typed_stats(si.snapshot_rows(spark, sf_dir))


def _cpu_series(spark, sf_dir):
    return us.usage_by_snapshot(_typed(spark, sf_dir), "cpu")


@query("stat_scan")
def q_stat_scan(spark, sf_dir):
    """The snapshots written as the sampler's files and read back by
    the file reader, identity from their paths."""
    root = scratch_path(spark, "snapshots")
    write_snapshots(si.snapshot_rows(spark, sf_dir), root)
    return read_snapshots(spark, f"{root}/resource_*")


@query("stat_typed")
def q_stat_typed(spark, sf_dir):
    """Typed snapshot rows (fractions, bytes, name parts)."""
    t = _typed(spark, sf_dir)
    return t.withColumn("cpu", F.col("cpu").cast("double")).withColumn("mem", F.col("mem").cast("double"))


@query("fleet_filter")
def q_fleet_filter(spark, sf_dir):
    """Fleet containers among all containers."""
    return us.fleet_filter(si.containers(spark, sf_dir)).select("container_id", "name")


@query("name_count")
def q_name_count(spark, sf_dir):
    """Running groups (master containers) per nation listing."""
    return us.name_count(si.containers(spark, sf_dir), ["nation"])


@query("cpu_by_snapshot")
def q_cpu_by_snapshot(spark, sf_dir):
    """Fleet CPU per snapshot."""
    return us.usage_by_snapshot(_typed(spark, sf_dir), "cpu")


@query("mem_by_snapshot")
def q_mem_by_snapshot(spark, sf_dir):
    """Fleet memory share per snapshot."""
    return us.usage_by_snapshot(_typed(spark, sf_dir), "mem")


@query("run_makespan")
def q_run_makespan(spark, sf_dir):
    """Per (user, day) run, first/last event in ms and elapsed seconds."""
    e = si.event_times(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return us.run_makespan(e, ["user_id", "day"])


@query("time_axis")
def q_time_axis(spark, sf_dir):
    """Snapshot -> seconds since run start (6.5 s sampling step)."""
    return us.time_axis(si.snapshot_rows(spark, sf_dir), 0.0, 6.5)


@query("series_align")
def q_series_align(spark, sf_dir):
    """CPU series without warm-up, padded to the longest run."""
    return us.series_align(_cpu_series(spark, sf_dir), "cpu", SERIES_SKIP, 0.0, 6.5)


@query("series_head")
def q_series_head(spark, sf_dir):
    """First 34 snapshots of every run."""
    return us.series_head(_cpu_series(spark, sf_dir), SERIES_HEAD_N)


@query("group_timeline")
def q_group_timeline(spark, sf_dir):
    """Groups up per snapshot and change flags."""
    return us.group_timeline(_typed(spark, sf_dir))


@query("end_phase")
def q_end_phase(spark, sf_dir):
    """T6 (batch): per user, events up to the first error are phase '',
    the next 4 phase 'end', later ones are not sampled."""
    e = si.event_times(spark, sf_dir)
    marker = (e.where(F.col("event_type") == "error")
               .select("user_id", F.col("ts").alias("marker_ts")))
    samples = e.select("user_id", "ts", "event_id")
    r = us.end_phase(samples, "user_id", "ts", marker, 4)
    return r.select("user_id", "event_id", ts_text(F.col("ts")).alias("ts"), "phase")


# ------------------------------------------------------------ contrast family
def _makespans_lineitem(spark, sf_dir):
    """Makespan stand-in: strategy = return flag, n_tasks = ship month,
    seconds = summed price / 100,000 (exact decimal, 3 places)."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_returnflag").alias("strategy"),
                       F.month("l_shipdate").cast("bigint").alias("n_tasks"))
              .agg(F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))
                           * F.lit(0.00001).cast("decimal(6,5)"), 3).cast("double").alias("seconds"))
              .withColumn("nodes", F.lit(1).cast("bigint")))


@query("strategy_join")
def q_strategy_join(spark, sf_dir):
    """Strategies aligned on task count."""
    return ct.strategy_join(_makespans_lineitem(spark, sf_dir), ["A", "N", "R"])


@query("phase_share")
def q_phase_share(spark, sf_dir):
    """Work vs. scaling share, warm (A) against cold (R) start."""
    return ct.phase_share(_makespans_lineitem(spark, sf_dir), "A", "R")


@query("series_contrast")
def q_series_contrast(spark, sf_dir):
    """One row per time index, one CPU column per run."""
    series = us.with_sample_index(_cpu_series(spark, sf_dir)).select(
        "run_id", "idx", F.col("cpu").alias("value"))
    return ct.series_contrast(series, [1, 2, 3])


@query("node_normalise")
def q_node_normalise(spark, sf_dir):
    """Makespan by tasks per node, across node counts (orders: priority = strategy,
    status = node count F/O/P -> 1/2/4, month = task count)."""
    o = table(spark, sf_dir, "orders")
    nodes = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(4)
    series = (o.groupBy(F.col("o_orderpriority").alias("strategy"), nodes.cast("bigint").alias("nodes"),
                        F.month("o_orderdate").cast("bigint").alias("n_tasks"))
               .agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)"))
                            * F.lit(0.000001).cast("decimal(7,6)"), 3).cast("double").alias("seconds")))
    return ct.node_contrast(series)


# ----------------------------------------------------------- placement family
def _workers(spark, sf_dir):
    c = us.fleet_filter(si.containers(spark, sf_dir))
    return pl.index_workers(c.where(F.col("name").startswith("hadoop-master-")))


def _ranked_tasks(spark, sf_dir):
    return range_rank(_tasks(spark, sf_dir), ["pos"])


@query("worker_assign")
def q_worker_assign(spark, sf_dir):
    """Queued task r -> worker r mod n (workers in name order)."""
    r = pl.worker_assign(_ranked_tasks(spark, sf_dir), _workers(spark, sf_dir))
    return r.select("pos", "uuid", "rank0", "slot", "container")


@query("worker_assign_new")
def q_worker_assign_new(spark, sf_dir):
    """Each new task goes to others[L mod n] where L = tasks still
    queued when it arrives: orders arrive on their order date (by key
    within a day) and leave the queue on their last ship date."""
    o = table(spark, sf_dir, "orders")
    day = F.unix_date(F.to_date("o_orderdate")).cast("bigint")
    arrivals = o.select(F.col("o_orderkey").alias("pos"), day.alias("day"))
    removals = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
                .agg(F.unix_date(F.to_date(F.max("l_shipdate"))).cast("bigint").alias("day"))
                .select("day"))
    q = pl.queue_length_at_arrival(arrivals, removals)
    r = pl.worker_assign_new(q.withColumn("rank0", F.col("queue_len")), _workers(spark, sf_dir))
    return r.select("pos", standin_uuid(F.col("pos")).alias("uuid"), "queue_len", "container")


@query("worker_reassign")
def q_worker_reassign(spark, sf_dir):
    """After scale-out, tasks on the default worker are spread again.
    Open orders were submitted after scale-out (O22 pick), the others
    while only the default worker was up."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pos"), standin_uuid(F.col("o_orderkey")).alias("uuid"),
        "o_orderstatus")
    ranked = range_rank(o, ["pos"])
    workers = _workers(spark, sf_dir)
    first = pl.worker_assign_new(ranked, workers)
    bound = first.withColumn("container", F.when(F.col("o_orderstatus") == "O", F.col("container"))
                             .otherwise(F.lit(pl.DEFAULT_WORKER)))
    r = pl.worker_reassign(bound, workers)
    return r.select("pos", "uuid", "container", "new_container")


@query("task_intake")
def q_task_intake(spark, sf_dir):
    """Accepted /hadoop requests -> task rows with their worker."""
    req = parse_requests(si.request_bodies(spark, sf_dir))
    acc = req.where(F.col("accepted") & (F.col("variant") == "hadoop"))
    ranked = range_rank(acc.withColumnRenamed("event_id", "pos"), ["pos"])
    placed = pl.worker_assign_new(ranked, _workers(spark, sf_dir))
    uuid = standin_uuid(F.col("pos"))
    return placed.select(
        uuid.alias("uuid"),
        F.format_string(tk.SERVICE_JOB_CMD + " %s %s %s", F.col("input"), F.col("output"),
                        uuid).alias("command"),
        "container", F.col("callback_url"), ts_text(F.col("ts")).alias("submit_ts"),
        F.lit("pending").alias("status"))


# ------------------------------------------------------------- scaling family
def _ticks(spark, sf_dir):
    """Hourly queue ticks: a signup adds a task, a purchase removes one."""
    e = si.event_times(spark, sf_dir).where(F.col("event_type").isin("signup", "purchase"))
    return e.select(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("tick"),
                    F.when(F.col("event_type") == "signup", 1).otherwise(-1).alias("delta"))


def _depth(spark, sf_dir):
    return sc.queue_depth(_ticks(spark, sf_dir))


def _decisions(spark, sf_dir):
    """Depth per hour and the groups seen in that hour's container listing."""
    return sc.scale_decision(_depth(spark, sf_dir), sc.groups_up(si.listings(spark, sf_dir)))


@query("queue_depth")
def q_queue_depth(spark, sf_dir):
    """Queue length after each hour."""
    return _depth(spark, sf_dir)


@query("scale_decision")
def q_scale_decision(spark, sf_dir):
    """Service scaling decision per hour."""
    return _decisions(spark, sf_dir).select("tick", "depth", "groups", "action", "target")


@query("scale_actions")
def q_scale_actions(spark, sf_dir):
    """Groups to add/remove per decision, in order, with member names."""
    return sc.scale_actions(_decisions(spark, sf_dir))


# ------------------------------------------------------------------ streaming
# Stream twins run the driver's table as a file stream (availableNow) into
# a sink under the shared checkpoint folder and return the sink.

def _table_stream(spark, sf_dir, name):
    schema = table(spark, sf_dir, name).schema
    return srun.file_stream(spark, f"{sf_dir.rstrip('/')}/{name}.parquet*", schema), schema


def _state_partitions(spark) -> int:
    """As many state partitions as cores, as each costs a store a batch."""
    return min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _event_stream(spark, sf_dir):
    """The events as a stream, and the marker that ends it."""
    ev, schema = _table_stream(spark, sf_dir, "events")
    ev, marker = srun.with_end_marker(spark, ev, schema, {"event_id": -1, "ts": srun.END_TS,
                                                          "event_type": srun.END_TYPE})
    return ev.withColumn("ts", F.col("ts").cast("timestamp")), marker


@query("stream_queue")
def q_stream_queue(spark, sf_dir):
    """The queue file tailed as a stream and parsed (batch twin O02)."""
    orders, _ = _table_stream(spark, sf_dir, "orders")
    return srun.run_append(spark, tk.parse_queue(si.queue_lines_of(orders)), "stream_queue")


@query("stream_tail")
def q_stream_tail(spark, sf_dir):
    """The queue written as a log and followed by byte offset."""
    path = _written_lines(spark, si.queue_lines(spark, sf_dir), "queue-log")
    return srun.run_append(spark, tk.parse_queue(growing_lines(spark, path)).drop("pos"), "stream_tail")


@query("stream_match")
def q_stream_match(spark, sf_dir):
    """Signup -> first purchase within 3,600 s on the event stream
    (per-user state, one row per request; batch twin O20)."""
    ev, marker = _event_stream(spark, sf_dir)
    r = srun.run_append(spark, smt.first_match_stream(ev), "stream_match", marker=marker,
                        state_partitions=_state_partitions(spark))
    return r.select(F.col("req_id").alias("event_id"), F.col("r_key").alias("user_id"),
                    ts_text(F.timestamp_micros("r_us")).alias("submit_ts"),
                    ts_text(F.timestamp_micros("done_us")).alias("done_ts"), "status")


@query("stream_lifecycle")
def q_stream_lifecycle(spark, sf_dir):
    """Per-user task lifecycle with event-time timeouts."""
    ev, marker = _event_stream(spark, sf_dir)
    out = srun.run_append(spark, slc.lifecycle_stream(ev), "stream_lifecycle", marker=marker, rocksdb=True,
                          state_partitions=_state_partitions(spark))
    return out.select(F.col("key").alias("user_id"),
                      ts_text(F.timestamp_micros("submit_us")).alias("submit_ts"),
                      ts_text(F.timestamp_micros("end_us")).alias("end_ts"), "status")


@query("stream_usage")
def q_stream_usage(spark, sf_dir):
    """T4: event value summed per 6.5 s event-time window."""
    # the marker's own window (year 2100) never closes, so it is never emitted
    ev, marker = _event_stream(spark, sf_dir)
    out = srun.run_append(spark, sus.usage_windows(ev, "value"), "stream_usage", marker=marker)
    return out.select(ts_text(F.col("w.start")).alias("window_start"), "value", "n_samples")


@query("stream_scale")
def q_stream_scale(spark, sf_dir):
    """T5: hourly depth and scaling decisions, two chained stateful steps."""
    ev, marker = _event_stream(spark, sf_dir)
    delta = (F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", -1))
    ticks = ssc.closed_ticks(ev.withColumn("delta", delta).withColumn("name", si.listed_name()))
    # rows are summed per tick before the shuffle, and few ticks are open
    return srun.run_append(spark, ssc.decisions_stream(ticks), "stream_scale", marker=marker, rocksdb=True,
                           state_partitions=2)


@query("stream_end_phase")
def q_stream_end_phase(spark, sf_dir):
    """The event stream phased by each user's first error (batch twin:
    end_phase); a run that is silent for good keeps its state, as the
    table's users come back after any time."""
    ev, marker = _event_stream(spark, sf_dir)
    samples = ev.select(F.col("user_id").alias("run"), F.col("event_id").alias("sample_id"), "ts",
                        (F.col("event_type") == "error").alias("is_marker"))
    out = srun.run_append(spark, sep.end_phase_stream(samples, 4, linger_s=100 * 366 * 86400), "stream_end_phase", marker=marker,
                          state_partitions=_state_partitions(spark))
    return out.select(F.col("run").alias("user_id"), F.col("sample_id").alias("event_id"),
                      ts_text(F.timestamp_micros("ts_us")).alias("ts"), "phase")


@query("stream_dedup")
def q_stream_dedup(spark, sf_dir):
    """The first completion of each id, with its place and path."""
    li, _ = _table_stream(spark, sf_dir, "lineitem")
    return sdd.first_completions_stream(spark, tk.parse_completions(si.completion_lines_of(li)), "stream_dedup")
