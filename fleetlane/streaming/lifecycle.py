"""Per-task lifecycle on a stream, with event-time timeouts.

A key (a task submitter) goes pending -> running -> success | failed |
timeout.  A submit while a task is open is a duplicate and is ignored, as is
a completion with no open task.  A task still open ``timeout_s`` after its
submit times out: either a later event of the key shows it, or the watermark
passes submit + timeout.  Output: one row per finished task (key, submit_us,
end_us, status).

Events wait until the watermark has passed them and are then folded in time
order, so rows that come late, but within the delay, give what they would
have given in order, whatever micro-batch they are in.

State is kept in buckets of keys, so that a trigger makes few calls.  Events
wait in a map from a stretch of time to its events, with one timer at what
is due first.  A trigger writes only the stretches it has rows for; a timer
reads only those that the watermark has reached, and removes what it has
passed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from fleetlane.streaming.runner import END_TYPE

OUT_SCHEMA = "key long, submit_us long, end_us long, status string"
OPEN_SCHEMA = "key array<long>, status array<string>, submit_us array<long>"
WAITING_SCHEMA = "key array<long>, t_us array<long>, event_id array<long>, event_type array<string>"
STRETCH_US = 8 * 3600 * 1_000_000
RUNNING_TYPES = ("click", "view")


def step(events, open_task, timeout_us):
    """Fold sorted (ts_us, type) events over one key's open task.

    ``open_task`` is None or (status, submit_us).  Returns (emitted rows,
    open task after).  Shared by the stream and its batch test twin."""
    out = []
    for t, typ in events:
        if typ == END_TYPE or (open_task is not None and t < open_task[1]):
            continue  # an event from before the open task's submit is not its own
        if open_task is not None and t > open_task[1] + timeout_us:
            out.append((open_task[1], open_task[1] + timeout_us, "timeout"))
            open_task = None
        if typ == "signup":
            if open_task is None:
                open_task = ("pending", t)
        elif typ in RUNNING_TYPES:
            if open_task is not None and open_task[0] == "pending":
                open_task = ("running", open_task[1])
        elif typ in ("purchase", "error"):
            if open_task is not None:
                out.append((open_task[1], t, "success" if typ == "purchase" else "failed"))
                open_task = None
    return out, open_task


class Lifecycle(StatefulProcessor):
    """State of a bucket of keys: open tasks, events by stretch, the timer."""

    def __init__(self, timeout_s: int):
        self.timeout_us = timeout_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN_SCHEMA)
        self.waiting = handle.getMapState("waiting", "stretch long", WAITING_SCHEMA)
        self.timer = handle.getValueState("timer", "ms long")

    def _wake(self, due_us: int) -> None:
        """Have the timer when the watermark has passed ``due_us``, or
        earlier."""
        ms = due_us // 1000 + 1
        now = self.timer.get()[0] if self.timer.exists() else None
        if now is None or ms < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows), ignore_index=True)
        got = got[got["key"].notna()]  # the end marker has no key
        if not len(got):
            return iter([])
        there = {k[0] for k in self.waiting.keys()}
        for stretch, part in got.groupby(got["t_us"] // STRETCH_US):
            at, new = (int(stretch),), [part[c].tolist() for c in ("key", "t_us", "event_id", "event_type")]
            new[0] = list(map(int, new[0]))
            if stretch in there:
                new = [list(x) + y for x, y in zip(self.waiting.getValue(at), new)]
            self.waiting.updateValue(at, tuple(new))
        self._wake(int(got["t_us"].min()))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Fold the events that the watermark has passed."""
        wm_us = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        tasks = {k: (st, s) for k, st, s in zip(*self.open.get())} if self.open.exists() else {}
        events: dict[int, list] = {}
        later = []                                   # when what is left becomes due
        for stretch in sorted(k[0] for k in self.waiting.keys()):
            if stretch * STRETCH_US > wm_us:
                later.append(stretch * STRETCH_US)
                continue
            rest = []
            for row in zip(*self.waiting.getValue((stretch,))):
                if row[1] <= wm_us:
                    events.setdefault(row[0], []).append(row[1:])
                else:
                    rest.append(row)
            if rest:
                self.waiting.updateValue((stretch,), tuple(list(c) for c in zip(*rest)))
                later.append(min(r[1] for r in rest))
            else:
                self.waiting.removeKey((stretch,))
        out, left = [], {}
        for k in {*events, *tasks}:
            rows, task = step(((t, typ) for t, _, typ in sorted(events.get(k, ()))), tasks.get(k), self.timeout_us)
            if task is not None and task[1] + self.timeout_us <= wm_us:
                rows.append((task[1], task[1] + self.timeout_us, "timeout"))
            elif task is not None:
                left[k] = task
                later.append(task[1] + self.timeout_us)
            out += [(int(k), *r) for r in rows]
        if left:
            self.open.update((list(left), [st for st, _ in left.values()], [s for _, s in left.values()]))
        elif tasks:
            self.open.clear()
        if later:
            self._wake(min(later))
        if out:
            yield pd.DataFrame(out, columns=["key", "submit_us", "end_us", "status"])

    def close(self) -> None:
        pass


def lifecycle_stream(events: DataFrame, key: str = "user_id", timeout_s: int = 3600,
                     delay: str = "1 hour", buckets: int = 32) -> DataFrame:
    """events: (event_id, key, ts, event_type) stream, marker included.
    Needs the RocksDB state store (see runner.run_append); ``buckets`` must
    stay as it is over restarts."""
    # the processor is opened once beside the driver, where the package may
    # not be on the path: its code travels with it
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    ev = (events.withWatermark("ts", delay)
                .select("event_id", F.col(key).alias("key"), "event_type", "ts",
                        F.unix_micros("ts").alias("t_us"),
                        F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).alias("bucket")))
    # the marker is not filtered here: a filter would be pushed below the
    # watermark and the watermark would never see it
    return (ev.groupBy("bucket").transformWithStateInPandas(
        Lifecycle(timeout_s), StructType.fromDDL(OUT_SCHEMA), "Append", "EventTime"))
