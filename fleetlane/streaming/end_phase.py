"""T6 on a stream: after a run's end marker, exactly ``keep_after`` further
samples are kept as phase 'end', the rest is dropped (batch twin:
operators.usage.end_phase).

Samples wait in the run's state until the watermark has passed them and are
then taken in order of time, so those that come late, but within the delay,
are phased as if they had come in order.  A run's state is its marker, a
count, and its samples of the watermark delay; it expires when the run has
shown nothing for ``linger``.  :class:`RunsClosed` tells a caller that
every run is closed, so that the query can be stopped, as the sampler stops
after its last sample.
"""

from __future__ import annotations

import threading
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout

OUT_SCHEMA = "run long, sample_id long, ts_us long, phase string, closed boolean"
STATE_SCHEMA = ("marker_us long, n_after long, last_us long, t_us array<long>, sample_id array<long>, "
                "is_marker array<boolean>")


def phase_rows(rows, marker: int | None, n_after: int, keep_after: int):
    """Phase sorted (ts_us, sample_id, is_marker) rows; a marker row may be
    a sample too (its sample_id is not null).  Returns (rows out, marker,
    count after it)."""
    out = []
    for t, sid, is_marker in rows:
        if is_marker and marker is None:
            marker = t
        if sid is None:
            continue
        if marker is None or t <= marker:
            out.append((sid, t, "", False))
        elif n_after < keep_after:
            n_after += 1
            out.append((sid, t, "end", n_after == keep_after))
    return out, marker, n_after


def _fn(keep_after: int, linger_us: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if key[0] is None or pd.isna(key[0]):  # the end marker's group
            for _ in pdfs:
                pass
            return
        wm_us = state.getCurrentWatermarkMs() * 1000
        marker, n_after, last, waiting = None, 0, wm_us, []
        if state.exists:
            marker, n_after, last, *cols = state.get
            waiting = list(zip(*cols))
        if not state.hasTimedOut:
            for pdf in pdfs:
                sid = [None if pd.isna(x) else int(x) for x in pdf["sample_id"]]
                waiting += zip(pdf["ts_us"].tolist(), sid, pdf["is_marker"].tolist())
        waiting.sort(key=lambda r: (r[0], r[1] is not None, r[1]))
        if waiting:
            last = max(last, waiting[-1][0])
        final = bisect_right(waiting, wm_us, key=lambda r: r[0])
        out, marker, n_after = phase_rows(waiting[:final], marker, n_after, keep_after)
        # nothing after the last sample of a closed run is kept
        waiting = [] if n_after >= keep_after else waiting[final:]
        if waiting or wm_us < last + linger_us:
            state.update((marker, n_after, last, *([list(c) for c in zip(*waiting)] or [[], [], []])))
            due = waiting[0][0] if waiting else last + linger_us
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame([(int(key[0]), *r) for r in out], columns=["run", "sample_id", "ts_us", "phase", "closed"])
    return fn


def end_phase_stream(samples: DataFrame, keep_after: int = 4, delay: str = "1 hour",
                     linger_s: int = 7 * 86400) -> DataFrame:
    """samples: (run, sample_id, ts, is_marker) stream -> OUT_SCHEMA; the
    number of runs closed by a trigger is observed as end_phase.closed."""
    s = samples.withWatermark("ts", delay).select("run", "sample_id", F.unix_micros("ts").alias("ts_us"), "is_marker", "ts")
    out = (s.groupBy("run").applyInPandasWithState(_fn(keep_after, linger_s * 1_000_000), OUT_SCHEMA, STATE_SCHEMA,
                                                   "append", GroupStateTimeout.EventTimeTimeout))
    return out.observe("end_phase", F.count_if("closed").alias("closed"))


class RunsClosed(StreamingQueryListener):
    """Sets ``done`` once ``runs`` runs were closed.  A batch that is run
    again counts once."""

    def __init__(self, runs: int):
        self.runs, self.done, self._closed = runs, threading.Event(), {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get("end_phase")
        if seen is not None:
            self._closed[event.progress.batchId] = seen["closed"]
            if sum(self._closed.values()) >= self.runs:
                self.done.set()

    def onQueryTerminated(self, event) -> None:
        pass


def run_until_closed(spark, writer, runs: int, timeout_s: float | None = None) -> bool:
    """Start ``writer`` (of an end_phase_stream), stop the query when all
    runs are closed; whether they were."""
    listener = RunsClosed(runs)
    spark.streams.addListener(listener)
    query = writer.start()
    try:
        return listener.done.wait(timeout_s)
    finally:
        query.stop()
        spark.streams.removeListener(listener)
