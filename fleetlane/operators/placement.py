"""Placement family: which worker runs which task (O21, O22, O23, O09),
and the queue length a new task sees (the input of O22).

Workers are indexed by name in text order (so ``-10`` sorts before ``-2``).
Tasks carry ``rank0``, their 0-based position among queued tasks.  The
worker table is ranked once, kept in the shared checkpoint folder, and
joined on the computed slot; tasks that need no worker get a slot of their
own that matches nothing, so they do not meet in one partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlane.operators.indexing import clamped_depth, range_rank

# The default worker, and the name a task falls back to
# when no worker is up at all.
DEFAULT_WORKER = "hadoop-master-0"


def index_workers(workers: DataFrame, name_col: str = "name") -> DataFrame:
    """(widx, name): 0-based index of each worker in name (text) order."""
    w = workers.select(F.col(name_col).alias("name")).distinct()
    return range_rank(w, ["name"], "widx")


def _count(df: DataFrame):
    """Row count as a scalar-subquery column (evaluated once, no collect)."""
    return df.agg(F.count(F.lit(1))).scalar()


def worker_assign(tasks: DataFrame, workers_ix: DataFrame) -> DataFrame:
    """Initial round-robin, task at rank r -> worker r mod n."""
    n = _count(workers_ix)
    slot = F.when(n > 0, F.pmod(F.col("rank0"), n))
    t = tasks.withColumn("slot", slot).withColumn("_slot", _slot(F.col("slot")))
    w = workers_ix.select(F.col("widx").alias("_slot"), F.col("name").alias("container"))
    return t.join(w, "_slot", "left").drop("_slot")


def _slot(slot):
    """Join key of a slot: itself, or for no slot one of many negative
    numbers, which no worker has."""
    return F.coalesce(slot, -1 - F.pmod(F.xxhash64("rank0"), F.lit(4096)))


def worker_assign_new(tasks: DataFrame, workers_ix: DataFrame,
                      default_worker: str = DEFAULT_WORKER) -> DataFrame:
    """A new task avoids the default worker when any other is up:
    ``others[L mod len(others)]`` with L = tasks queued before it; with
    only the default worker up it gets that one; with none, the default
    name."""
    # one pass over the ranked workers: a worker's place among the others
    # is its place among all, less one if the default comes before it
    base = workers_ix.agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"),
                          F.min(F.when(F.col("name") == default_worker, F.col("widx"))).alias("d"))
    n_all, first, d = (base.select(c).scalar() for c in ("n", "first", "d"))
    n_others = n_all - F.when(d.isNotNull(), 1).otherwise(0)
    oidx = F.col("widx") - F.when(F.col("widx") > d, 1).otherwise(0)
    o = workers_ix.where(F.col("name") != default_worker).select(oidx.alias("_slot"), F.col("name").alias("_pick"))
    slot = F.when(n_others > 0, F.pmod(F.col("rank0"), n_others))
    j = tasks.withColumn("_slot", _slot(slot)).join(o, "_slot", "left")
    container = (F.when(F.col("_pick").isNotNull(), F.col("_pick"))
                  .when(n_all > 0, first)
                  .otherwise(F.lit(default_worker)))
    return j.withColumn("container", container).drop("_slot", "_pick")


def worker_reassign(tasks: DataFrame, workers_ix: DataFrame,
                    default_worker: str = DEFAULT_WORKER) -> DataFrame:
    """With more than one worker up, tasks bound to the default worker
    move to ``workers[queue_pos mod n]`` (which may be the default again);
    other tasks and single-worker fleets are unchanged."""
    n = _count(workers_ix)
    move = (F.col("container") == default_worker) & (n > 1)
    slot = F.when(move, F.pmod(F.col("rank0"), n))
    w = workers_ix.select(F.col("widx").alias("_slot"), F.col("name").alias("_new"))
    j = tasks.withColumn("_slot", _slot(slot)).join(w, "_slot", "left")
    return (j.withColumn("new_container", F.coalesce(F.col("_new"), F.col("container")))
             .drop("_slot", "_new"))


def queue_length_at_arrival(arrivals: DataFrame, removals: DataFrame) -> DataFrame:
    """Tasks still queued when each task arrives (before its own insert).

    arrivals: (pos, day), in order of day, then pos; removals: (day) one
    row per finished task, counted at the day's end.  A removal finds
    nothing to remove in an empty queue, as everywhere (O31), so this is
    the depth of the queue just before the arrival: removals are summed per
    day, and arrivals and days are scanned together, range by range."""
    rows = (arrivals.select("pos", "day", F.lit(0).alias("_end"), F.lit(1).cast("bigint").alias("_delta"))
                    .unionByName(removals.groupBy("day").agg((-F.count(F.lit(1))).alias("_delta"))
                                         .select(F.lit(None).cast("bigint").alias("pos"), "day", F.lit(1).alias("_end"), "_delta")))
    rows = clamped_depth(rows, ["day", "_end", "pos"], "_delta", "_depth").where("_end = 0")
    return rows.select("pos", "day", (F.col("_depth") - 1).cast("bigint").alias("queue_len"))
