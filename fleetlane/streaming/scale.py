"""T5: scaling decisions on a stream (batch twin: O31 + O43).

Two stateful steps of one query.  The first sums the +1/-1 rows of an hour
and collects the masters seen in it, in an event-time window; a tick comes
out once, when the watermark has closed it.  The second continues the depth
of the queue: its state is one number, and as ticks come out of the first
in order of time - all of a trigger before all of the next - it folds a
trigger's ticks in that order and emits a decision for each.  Nothing is
read or carried by the driver; a restart continues from the checkpoint.
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

from fleetlane.operators.scaling import MAX_GROUPS, service_policy

DEPTH_SCHEMA = "queue string, tick string, depth bigint, groups bigint"


def closed_ticks(events: DataFrame, ts_col: str = "ts", delay: str = "1 hour") -> DataFrame:
    """(ts, delta, name) stream -> (tick, delta, groups) per closed hour:
    the sum of delta and the number of masters among the names.  Rows with
    a null delta are no part of the sum; an hour without others has a null
    delta."""
    master = F.when(F.col("name").contains("hadoop-master"), F.col("name"))
    w = (events.withWatermark(ts_col, delay).groupBy(F.window(ts_col, "1 hour").alias("w"))
               .agg(F.sum("delta").cast("bigint").alias("delta"),
                    F.size(F.collect_set(master)).cast("bigint").alias("groups")))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("tick"), "delta", "groups")


class QueueDepth(StatefulProcessor):
    """Continues one queue's depth over the ticks that a trigger closed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.depth = handle.getValueState("depth", "depth long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.depth.get()[0] if self.depth.exists() else 0
        t = pd.concat(list(rows), ignore_index=True).sort_values("tick", kind="stable")
        cum = before + t["delta"].cumsum()
        # removing from an empty queue changes nothing
        t["depth"] = cum - cum.cummin().clip(upper=0)
        if len(t):
            self.depth.update((int(t["depth"].iloc[-1]),))
        yield t.assign(queue=key[0])[["queue", "tick", "depth", "groups"]]

    def close(self) -> None:
        pass


def depth_stream(ticks: DataFrame, queue: str = "main") -> DataFrame:
    """(tick, delta, groups) per closed tick, in order -> with its depth."""
    # the processor is opened once beside the driver, where the package may
    # not be on the path: its code travels with it
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    t = ticks.where("delta is not null").withColumn("queue", F.lit(queue))
    return (t.groupBy("queue").transformWithStateInPandas(
        QueueDepth(), StructType.fromDDL(DEPTH_SCHEMA), "Append", "None"))


def decisions_stream(ticks: DataFrame, cap: int = MAX_GROUPS) -> DataFrame:
    """(tick, depth, groups, action, target) per closed tick."""
    d = depth_stream(ticks).withColumn("groups", F.greatest("groups", F.lit(1)).cast("bigint"))
    return service_policy(d, cap).select("tick", "depth", "groups", "action", "target")
