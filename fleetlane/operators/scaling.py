"""Scaling family: queue depth per tick and the scale decisions taken from
it (O31, O43, O45).

Depth is a running sum of +1 (task added) / -1 (task removed).  Raw rows
are first summed per tick bucket (partial aggregate on every executor);
the per-tick table is then scanned in parallel, range by range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlane.operators.indexing import clamped_depth

# Fixed values of the controllers: most worker groups, members of one group.
MAX_GROUPS = 6
SLAVES_PER_GROUP = 2


def queue_depth(deltas: DataFrame, tick_col: str = "tick") -> DataFrame:
    """(tick, delta) rows -> (tick, delta, depth) per tick.  Removing
    from an empty queue changes nothing.  Rows are summed per tick on every
    task, and ticks are scanned in parallel by range."""
    per_tick = deltas.groupBy(tick_col).agg(F.sum("delta").cast("bigint").alias("delta"))
    return clamped_depth(per_tick, [tick_col]).select(tick_col, "delta", "depth")


def service_policy(ticks: DataFrame, cap: int = MAX_GROUPS) -> DataFrame:
    """O43 decision for observed (depth, groups): depth > groups -> extend
    to min(depth, cap) if that is more; depth = 0 and groups > 1 -> shrink
    to 1; else hold.  Adds action, target."""
    ext = F.least(F.col("depth"), F.lit(cap))
    action = (F.when((F.col("depth") > F.col("groups")) & (ext > F.col("groups")), "extend")
               .when((F.col("depth") == 0) & (F.col("groups") > 1), "shrink")
               .otherwise("hold"))
    target = (F.when(F.col("action") == "extend", ext)
               .when(F.col("action") == "shrink", F.lit(1))
               .otherwise(F.col("groups")))
    return ticks.withColumn("action", action).withColumn("target", target.cast("bigint"))


def groups_up(listing: DataFrame, tick_col: str = "tick", name_col: str = "name") -> DataFrame:
    """Groups observed per tick: distinct masters in the tick's listing of
    containers (the count of O14, taken at every tick)."""
    master = F.when(F.col(name_col).contains("hadoop-master"), F.col(name_col))
    return listing.groupBy(tick_col).agg(F.count_distinct(master).alias("groups"))


def scale_decision(ticks: DataFrame, groups: DataFrame, cap: int = MAX_GROUPS, tick_col: str = "tick") -> DataFrame:
    """O43 over a depth series and the groups observed at its ticks (a tick
    whose listing shows no group still has one), then
    :func:`service_policy`."""
    t = ticks.join(groups.select(tick_col, F.col("groups").alias("_up")), tick_col, "left")
    return service_policy(t.withColumn("groups", F.greatest(F.coalesce("_up", F.lit(1)), F.lit(1)).cast("bigint"))
                           .drop("_up"), cap)


def group_members(group_no):
    """Container names of one group: its master and its slaves."""
    g = group_no.cast("string")
    names = [F.concat(F.lit("hadoop-master-"), g)] + [
        F.concat(F.lit("hadoop-slave-"), g, F.lit(f"-{i}")) for i in range(1, SLAVES_PER_GROUP + 1)]
    return F.concat_ws(",", *names)


def scale_actions(decisions: DataFrame, tick_col: str = "tick") -> DataFrame:
    """One row per group to add (ascending groups..target-1) or to
    remove (descending groups-1..target), with its place in that order
    (step, from 1) and its member names."""
    ext = F.sequence(F.col("groups"), F.col("target") - 1)
    red = F.sequence(F.col("groups") - 1, F.col("target"), F.lit(-1).cast("bigint"))
    d = decisions.where(F.col("action").isin("extend", "shrink"))
    g = F.posexplode(F.when(F.col("action") == "extend", ext).otherwise(red)).alias("step", "group_no")
    return (d.select(tick_col, "action", g).withColumn("step", (F.col("step") + 1).cast("bigint"))
             .withColumn("members", group_members(F.col("group_no"))))
