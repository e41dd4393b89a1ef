"""Global ranks and running depths without a single-task window.

``row_number() over (order by x)`` without a partition key runs in one task.
:func:`range_rank` gives the same 0-based rank: range-partition and sort,
count the rows of each partition, add the partition's offset.  It holds for
any key, dense or sparse, one or several columns; the only global window is
over one row per partition.  The sorted rows are written to the shared
checkpoint folder, so they are computed once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranged(df: DataFrame, order_cols: Sequence[str | Column]) -> DataFrame:
    """``df`` range-partitioned and sorted, kept in the checkpoint folder,
    with the partition (_pid) and the row's place in it (_mid)."""
    ranged = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    return (ranged.withColumn("_pid", F.spark_partition_id())
                  .withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True))


def clamped_depth(df: DataFrame, order_cols: Sequence[str | Column], delta: str = "delta",
                  name: str = "depth") -> DataFrame:
    """Depth of a queue after each row: it grows and shrinks by ``delta``
    but never falls below 0 (removing from an empty queue changes nothing).

    The depth is the running sum less its lowest value below 0 so far, and
    the pair (sum, lowest) of consecutive stretches combines: the sums add,
    the lowest is the lower of the first's and the first's sum + the
    second's.  So each range partition is scanned by itself, one row per
    partition is scanned at the top, and its result is added to the rows."""
    tagged = _ranged(df, order_cols)
    own = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumn("_cum", F.sum(delta).over(own).cast("bigint"))
    local = local.withColumn("_low", F.min("_cum").over(own))
    parts = local.groupBy("_pid").agg(F.max_by("_cum", "_mid").alias("_sum"), F.min("_cum").alias("_least"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    parts = parts.select("_pid", "_base", F.coalesce(F.min(F.col("_base") + F.col("_least")).over(before),
                                                     F.lit(0)).alias("_floor"))
    depth = F.col("_base") + F.col("_cum") - F.least(F.lit(0), "_floor", F.col("_base") + F.col("_low"))
    # one row per partition: a proven bound for the broadcast
    return (local.join(F.broadcast(parts), "_pid").withColumn(name, depth.cast("bigint"))
                 .drop("_pid", "_mid", "_cum", "_low", "_base", "_floor"))


def range_rank(df: DataFrame, order_cols: Sequence[str | Column],
               name: str = "rank0") -> DataFrame:
    """0-based rank by ``order_cols`` (ties broken arbitrarily but stably)."""
    tagged = _ranged(df, order_cols)
    per_part = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"),
                                          F.min("_mid").alias("_m0"))
    offsets = per_part.select(
        "_pid", "_m0",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    # one row per partition: a proven bound for the broadcast
    return (tagged.join(F.broadcast(offsets), "_pid")
                  .withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("bigint"))
                  .drop("_pid", "_mid", "_m0", "_off"))
