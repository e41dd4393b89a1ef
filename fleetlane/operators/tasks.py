"""Task family: queue and completion-log parsing, task/completion matching,
time-outs, queue head/tail, queue status, output mining, access log lines
and callback payloads.

Inputs are plain DataFrames: queue/completion *lines* are ``(pos, value)``
(file order = ``pos``), tasks are ``(pos, uuid, ...)``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlane.functions.ids import is_uuid
from fleetlane.functions.paths import normalise_log_path
from fleetlane.functions.text import strip_ws
from fleetlane.functions.timefmt import epoch_us, hms, idiv

# The command a queue line runs (the word-count job script),
# as the batch controller and the service write it.
JOB_CMD = "sh run-wordcount2.sh"
SERVICE_JOB_CMD = "sh /root/run-wordcount2.sh"

# Whitespace run between the tokens of a command line.
WS_RUN_RE = "[ \\t\\n\\r\\f\\x0b]+"
# New completion format: <uuid>:::<log path>
NEW_COMPLETION_RE = "^(\\S+?):::(.*)$"


# ------------------------------------------------------------------ parsing
def parse_queue(lines: DataFrame) -> DataFrame:
    """Queue lines -> (pos, cmd, input, output, uuid); blank lines are
    skipped, the last token is the task id."""
    cmd = strip_ws(F.col("value"))
    toks = F.split(cmd, WS_RUN_RE)
    return (lines.select("pos", cmd.alias("cmd"), toks.alias("_t"))
                 .where(F.col("cmd") != "")
                 .select("pos", "cmd",
                         F.try_element_at("_t", F.lit(3)).alias("input"),
                         F.try_element_at("_t", F.lit(4)).alias("output"),
                         F.coalesce(F.element_at("_t", -1), F.lit("")).alias("uuid")))


def parse_completions(lines: DataFrame, keep=()) -> DataFrame:
    """Completion lines in either format -> (pos, uuid, path, valid).

    ``<uuid>:::<path>`` (new) or a command line whose last token is the id
    (old, no path).  Nothing is filtered here: a blank line yields id ''
    (invalid).  Consumers drop invalid ids *after* an aggregate - a row
    filter on these parsed columns would be pushed below the projection
    and run the whole parse a second time inside the Filter."""
    v = strip_ws(F.col("value"))
    new_id = F.regexp_extract(v, NEW_COMPLETION_RE, 1)
    # the path is what follows "<id>:::" (same as the pattern's group 2,
    # without matching the line a second time)
    new_path = F.substring(v, F.length(new_id) + 4, F.length(v))
    is_new = new_id != ""
    uuid = F.when(is_new, new_id).otherwise(F.element_at(F.split(v, WS_RUN_RE), -1))
    # non-nullable, so the optimizer infers no isnotnull(uuid) join filter
    # (it would be pushed into the scan and repeat the parse)
    uuid = F.coalesce(uuid, F.lit(""))
    return (lines.select(*keep, "pos", uuid.alias("uuid"),
                         F.when(is_new, strip_ws(new_path)).alias("path"))
                 .withColumn("valid", is_uuid(F.col("uuid"))))


def completed_ids(parsed: DataFrame) -> DataFrame:
    """Distinct valid ids of a parsed completion log (partial aggregate on
    every map task, validity checked per id after it)."""
    return (parsed.groupBy("uuid").agg(F.max("valid").alias("_v"))
                  .where(F.col("_v")).select("uuid"))


def first_completions(parsed: DataFrame) -> DataFrame:
    """First occurrence per id wins -> (uuid, first_pos, path, dup_count).

    An aggregate (partial before the shuffle), not a window: a hot id is
    folded on every map task instead of being sorted in one.  Ties on pos
    are broken by the path text."""
    first = F.min(F.struct(F.col("pos").alias("pos"),
                           F.coalesce(F.col("path"), F.lit("")).alias("p")))
    return (parsed.groupBy("uuid")
                  .agg(first.alias("_f"), F.count(F.lit(1)).alias("dup_count"),
                       F.max("valid").alias("_v"))
                  .where(F.col("_v"))
                  .select("uuid", F.col("_f.pos").alias("first_pos"),
                          F.nullif(F.col("_f.p"), F.lit("")).alias("path"), "dup_count"))


# -------------------------------------------------------------------- joins
def completion_match(tasks: DataFrame, firsts: DataFrame) -> DataFrame:
    """Completed tasks with their log path (inner join on id)."""
    return tasks.join(firsts, "uuid").select(
        "uuid", "pos", "input", "path", F.col("first_pos").alias("done_pos"))


def pending_tasks(tasks: DataFrame, parsed: DataFrame) -> DataFrame:
    """Tasks without any valid completion (anti join on id)."""
    return tasks.join(completed_ids(parsed), "uuid", "left_anti").select("pos", "uuid", "input")


def busy_groups(containers: DataFrame, running: DataFrame,
                key: str = "container_id") -> DataFrame:
    """Distinct containers bound to a running task.

    The running side is reduced to its distinct keys first (partial hash
    aggregate on every map task), so the semi join shuffles at most one row
    per key and map task however many tasks a container runs."""
    keys = running.select(key).distinct()
    return containers.join(keys, key, "left_semi")


def result_lookup(completions: DataFrame, reports: DataFrame, log_root: str) -> DataFrame:
    """Completed task -> report file on the normalised path.

    ``completions``: (uuid, path); ``reports``: (path, text).  A report is
    found when the file exists and is not empty (size > 0, before any
    stripping); its text is returned stripped, so a file of white space
    gives ''.  Otherwise the task keeps waiting (found = false, NULL)."""
    c = completions.select("uuid", F.col("path").alias("log_path"),
                           normalise_log_path(F.col("path"), log_root).alias("_p"))
    r = (reports.where(F.length("text") > 0)
                .select(F.col("path").alias("_p"), strip_ws(F.col("text")).alias("report")))
    return (c.join(r, "_p", "left")
             .select("uuid", "log_path", F.col("report").isNotNull().alias("found"), "report"))


def first_completion_within(requests: DataFrame, completions: DataFrame, key: str, timeout_s: int) -> DataFrame:
    """O20 over two tables: requests (req_id, key, ts), completions (key,
    ts); see :func:`first_done_within`."""
    return first_done_within(requests.select("req_id", key, "ts", F.lit(0).alias("kind")).unionByName(
        completions.select(F.lit(None).cast("bigint").alias("req_id"), key, "ts", F.lit(1).alias("kind"))), key, timeout_s)


def first_done_within(rows: DataFrame, key: str, timeout_s: int) -> DataFrame:
    """Per request, the first completion of the same key in
    [ts, ts + timeout] -> success, else timeout.

    rows: (req_id, key, ts, kind), kind 0 a request, 1 a completion; a null
    key matches nothing.  An as-of search in one exchange: rows are range
    partitioned by (key, time), latest first, and a task carries the last
    completion it has seen of a key forward to the requests before it.  Only
    the requests at the head of a partition, whose key began in an earlier
    one, may have their answer there: of each partition one row (its last
    key and that key's last completion) is kept, and these are scanned at
    the top.  No request is paired with more than one candidate, and a key
    that holds a large share of the rows is cut by time like any other."""
    both = rows.select("req_id", F.col(key).alias("k"), epoch_us(F.col("ts")).alias("t"), F.col("kind").cast("int").alias("kind"))
    both = both.where("k is not null or kind = 0")
    ranged = both.withColumn("back", -F.col("t")).repartitionByRange("k", "back").sortWithinPartitions(
        "k", "back", F.desc("kind"))
    kind = ranged.schema["k"].dataType.simpleString()
    seen = (ranged.select("req_id", "k", "t", "kind")
                  .mapInArrow(_next_in_partition, f"part int, req_id bigint, k {kind}, t bigint, done bigint, "
                                                  f"head boolean, first_k {kind}, ends boolean").checkpoint())
    # one row per partition: its first key, its last and that key's last completion
    ends = seen.where("ends").select("part", "first_k", F.when(F.col("done").isNotNull(), F.struct("k", "done")).alias("end"))
    before = F.last("end", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("part", "first_k", before.alias("end")).where("end.k = first_k")
    asked = seen.where("not ends")
    j = asked.join(F.broadcast(ends.select("part", F.col("end.done").alias("carried"))), "part", "left")
    nearest = F.coalesce("done", F.when(F.col("head"), F.col("carried")))
    done = F.when(nearest <= F.col("t") + F.lit(timeout_s * 1_000_000), nearest)
    return j.select("req_id", F.col("k").alias(key), F.col("t").alias("submit_us"), done.alias("done_us"),
                    F.when(done.isNotNull(), "success").otherwise("timeout").alias("status"))


def _next_in_partition(batches):
    """Requests of a sorted partition with the last completion of their key
    seen before them; ``head`` marks those of the partition's first key for
    which there was none.  The last row has the partition's ends."""
    part = TaskContext.get().partitionId()
    begun, first, last, carried = False, None, None, None     # first key; last key and its last completion
    for b in batches:
        keys = b.column(1)
        if not len(b):
            continue
        t, is_done = b.column(2).to_numpy(), b.column(3).to_numpy() == 1
        code = pc.fill_null(keys.dictionary_encode().indices, -1).to_numpy()
        new = np.flatnonzero(np.diff(code, prepend=-2))
        start = np.repeat(new, np.diff(np.append(new, len(code))))      # where a row's key starts
        at = np.maximum.accumulate(np.where(is_done, np.arange(len(code)), -1))
        found = at >= start
        done = np.where(found, t[np.maximum(at, 0)], 0)
        k0, k1 = keys[0].as_py(), keys[len(keys) - 1].as_py()
        begun, first = True, first if begun else k0
        if last == k0 and carried is not None:      # the key goes on from the batch before
            rest = (start == 0) & ~found
            done, found = np.where(rest, carried, done), found | rest
        last, carried = k1, int(done[-1]) if found[-1] else None
        head = ~found & (start == 0) & (k0 == first)
        asked = pa.array(~is_done)   # of a null key only requests are here, so they find nothing
        n = int((~is_done).sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part, np.int32)), b.column(0).filter(asked), keys.filter(asked), b.column(2).filter(asked),
             pa.array(done, mask=~found).filter(asked), pa.array(head).filter(asked), pa.nulls(n, keys.type),
             pa.array(np.zeros(n, bool))], names=_NEXT)
    if begun:
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), pa.array([last], keys.type), pa.nulls(1, pa.int64()),
             pa.array([carried], pa.int64()), pa.array([False]), pa.array([first], keys.type), pa.array([True])], names=_NEXT)


_NEXT = ["part", "req_id", "k", "t", "done", "head", "first_k", "ends"]


# ------------------------------------------------------------ head / tail
def queue_head(lines: DataFrame, n: int) -> DataFrame:
    """The oldest n lines; blank lines use a slot but are dropped.
    A top-k (TakeOrderedAndProject), not a global sort."""
    return parse_queue(lines.orderBy("pos").limit(n))


def queue_pop(lines: DataFrame, consumed: int = 1) -> DataFrame:
    """The queue after dropping its first ``consumed`` lines."""
    head = lines.select("pos").orderBy("pos").limit(consumed)
    cut = head.agg(F.max("pos").alias("_cut"))
    return lines.where(F.col("pos") > cut.scalar()).select("pos", "value")


def completion_tail(lines: DataFrame, n: int) -> DataFrame:
    """The newest n completion lines (top-k by position)."""
    return lines.orderBy(F.col("pos").desc(), F.col("value").desc()).limit(n).select("pos", "value")


# ------------------------------------------------------------------ status
def queue_status(tasks: DataFrame, run_col: str, status_col: str,
                 running_value: str = "running") -> DataFrame:
    """Per run, task count, running count, any slot still busy."""
    running = F.col(status_col) == running_value
    return (tasks.groupBy(run_col)
                 .agg(F.count(F.lit(1)).alias("n_tasks"),
                      F.count_if(running).alias("n_running"),
                      F.bool_or(running).alias("any_running")))


# -------------------------------------------------------- output mining
# Fixed value: the timing line a model run prints (case-insensitive,
# dot matches newline); the first match is the job's result.
TIMING_LINE_RE = ("(?is)(I\\d{4} \\d{2}:\\d{2}:\\d{2}\\.\\d{6} +\\d+ caffe\\.cpp:495\\] "
                  "execution time: .*? us)")


def exec_time_mining(outputs: DataFrame, pattern: str = TIMING_LINE_RE,
                     text_col: str = "output", rc_col: str = "rc") -> DataFrame:
    """result = first match of ``pattern`` (stripped) for a successful
    job, else the whole output; failed jobs (rc <> 0) return the whole
    output.  ``pattern`` must have one group around the whole match."""
    m = F.regexp_extract(F.col(text_col), pattern, 1)
    ok = F.col(rc_col) == 0
    matched = ok & (m != "")
    return outputs.select(
        "*", matched.alias("matched"),
        F.when(matched, strip_ws(m)).otherwise(F.col(text_col)).alias("result"))


# -------------------------------------------------------------- access log
def access_log_lines(records: DataFrame) -> DataFrame:
    """One access-log line per request; ``/favicon.ico`` is skipped.

    records: (client, method, path, protocol, status, bytes, start_ts, end_ts).
    """
    elapsed_ms = (epoch_us(F.col("end_ts")) - epoch_us(F.col("start_ts"))) / 1000.0
    line = F.format_string('%s - INFO - [access] %s - "%s %s %s" %d %s - %.2fms',
                           hms(F.col("end_ts")), F.col("client"), F.col("method"),
                           F.col("path"), F.col("protocol"), F.col("status"),
                           F.coalesce(F.col("bytes"), F.lit("-")), elapsed_ms)
    return records.where(F.col("path") != "/favicon.ico").withColumn("log_line", line)


# --------------------------------------------------------------- callbacks
# Payload keys below are fixed values; the message is our own wording.
TIMEOUT_MESSAGE = "task timed out (over 1 hour)"


def callback_payload(uuid: Column, success: Column, message: Column, at: Column) -> Column:
    """O13 flat payload: {"uuid", "success", "message", "timestamp"}."""
    return F.to_json(F.struct(uuid.alias("uuid"), success.alias("success"),
                              message.alias("message"), hms(at).alias("timestamp")))


def nested_callback_payload(uuid: Column, status: Column, cmd: Column, output: Column,
                            input_path: Column, output_path: Column, at: Column) -> Column:
    """O13 nested payload: {"uuid", "task_status", "result": {...}}."""
    result = F.struct(status.alias("status"), cmd.alias("cmd"), output.alias("output"),
                      input_path.alias("input_path"), output_path.alias("output_path"),
                      hms(at).alias("execution_time"))
    return F.to_json(F.struct(uuid.alias("uuid"), status.alias("task_status"),
                              result.alias("result")))


def error_callback_payload(uuid: Column, message: Column) -> Column:
    """O13 error payload: {"uuid", "task_status": "error", "error_msg"}."""
    return F.to_json(F.struct(uuid.alias("uuid"), F.lit("error").alias("task_status"),
                              message.alias("error_msg")))
