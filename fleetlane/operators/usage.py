"""Usage family: container snapshots -> typed stats -> per-snapshot sums ->
aligned series (O04, O06-O08, O14, O27, O28, O32, O33, O35, O40, T6 batch).

Snapshot identity is (run_id, phase, sample_no); phase '' sorts before
'end'.  Every window here is partitioned by run and runs over per-snapshot
aggregates (one row per snapshot), never over raw container rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlane.functions import stats as st
from fleetlane.functions.timefmt import epoch_ms_rounded

SNAP = ("run_id", "phase", "sample_no")


def phase_rank(phase: str = "phase"):
    return F.when(F.col(phase) == "end", 1).otherwise(0)


def typed_stats(raw: DataFrame, keep=()) -> DataFrame:
    """O06 (+O08): raw text snapshot rows -> typed columns.

    raw: (run_id, phase, sample_no, name, cpu_pct, mem_usage, mem_pct)
    plus any ``keep`` columns.  cpu/mem are exact DECIMAL fractions
    (186.39% -> 1.8639)."""
    return raw.select(
        *SNAP, *keep, "name",
        st.container_role(F.col("name")).alias("role"),
        st.container_group(F.col("name")).alias("group_no"),
        st.container_slot(F.col("name")).alias("slot"),
        st.pct_decimal(F.col("cpu_pct")).alias("cpu"),
        st.mem_used_bytes(F.col("mem_usage")).alias("mem_used"),
        st.mem_limit_bytes(F.col("mem_usage")).alias("mem_limit"),
        st.pct_decimal(F.col("mem_pct")).alias("mem"))


def fleet_filter(containers: DataFrame, name_col: str = "name") -> DataFrame:
    """Containers whose name contains ``hadoop-<word>-<digit>``."""
    return containers.where(st.is_fleet(F.col(name_col)))


def name_count(containers: DataFrame, snapshot_cols, name_col: str = "name") -> DataFrame:
    """Running groups per snapshot = names containing ``hadoop-master``."""
    return (containers.groupBy(*snapshot_cols)
                      .agg(F.count_if(st.is_master(F.col(name_col))).alias("n_groups")))


def usage_by_snapshot(typed: DataFrame, metric: str) -> DataFrame:
    """Sum of ``metric`` (cpu or mem) over containers per snapshot,
    rounded to 3 decimals (exact decimal sum, rounded half-up)."""
    return (typed.groupBy(*SNAP)
                 .agg(F.round(F.sum(metric), 3).cast("double").alias(metric)))


def run_makespan(events: DataFrame, run_cols, ts_col: str = "ts") -> DataFrame:
    """Per run, start/end rounded to ms and elapsed seconds."""
    return (events.groupBy(*run_cols)
                  .agg(F.min(ts_col).alias("_s"), F.max(ts_col).alias("_e"))
                  .select(*run_cols, epoch_ms_rounded(F.col("_s")).alias("start_ms"),
                          epoch_ms_rounded(F.col("_e")).alias("end_ms"))
                  .withColumn("elapsed_s",
                              ((F.col("end_ms") - F.col("start_ms")).cast("double") / 1000.0)))


def time_axis(snapshots: DataFrame, start: float = 0.0, step: float = 6.5) -> DataFrame:
    """Sample -> seconds, ``start + idx * step`` with idx the 0-based
    position of the snapshot inside its run (phase, then sample number)."""
    snaps = snapshots.select(*SNAP).distinct()
    w = Window.partitionBy("run_id").orderBy(phase_rank(), F.col("sample_no"))
    idx = (F.row_number().over(w) - 1).cast("bigint")
    return (snaps.withColumn("idx", idx)
                 .withColumn("t_sec", F.lit(float(start)) + F.col("idx").cast("double") * float(step)))


def with_sample_index(series: DataFrame, name: str = "idx") -> DataFrame:
    """0-based position of each snapshot in its run, for a series that
    already has one row per snapshot (no distinct, no join back)."""
    w = Window.partitionBy("run_id").orderBy(phase_rank(), F.col("sample_no"))
    return series.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))


def series_head(series: DataFrame, n: int) -> DataFrame:
    """The first n snapshots of every run (by phase, sample number).
    The ``row_number() <= n`` filter becomes a per-partition group limit
    before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy("run_id").orderBy(phase_rank(), F.col("sample_no"))
    return series.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def series_align(series: DataFrame, value_col: str, skip: int,
                 start: float = 0.0, step: float = 6.5) -> DataFrame:
    """Drop each run's first ``skip`` snapshots, then extend every run
    to the common length L (longest measured run) by holding its last
    measured value (our padding rule).  -> (run_id, idx, t_sec, value, padded)

    The grid is generated per run with ``sequence`` (no cross join) and the
    forward fill is a window over one run's L grid points.  ``series`` has
    one row per snapshot (e.g. :func:`usage_by_snapshot`)."""
    measured = (with_sample_index(series)
                .where(F.col("idx") >= skip)  # stays above the window
                .select("run_id", (F.col("idx") - skip).alias("idx"),
                        F.col(value_col).alias("value")))
    lengths = measured.groupBy("run_id").agg(F.count(F.lit(1)).alias("_len"))
    common = F.max("_len").over(Window.partitionBy())  # over the runs only
    grid = (lengths.withColumn("_L", common)
                   .select("run_id", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                          F.col("_L") - 1)).alias("idx")))
    fill = Window.partitionBy("run_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return (grid.join(measured, ["run_id", "idx"], "left")
                .select("run_id", "idx",
                        (F.lit(float(start)) + F.col("idx").cast("double") * float(step)).alias("t_sec"),
                        F.last("value", ignorenulls=True).over(fill).alias("value"),
                        F.col("value").isNull().alias("padded")))


def group_timeline(typed: DataFrame) -> DataFrame:
    """Groups up per snapshot (distinct master names) and whether the
    number changed since the run's previous snapshot."""
    per_snap = (typed.groupBy(*SNAP)
                     .agg(F.count_distinct(F.when(st.is_master(F.col("name")), F.col("name")))
                          .alias("n_groups")))
    w = Window.partitionBy("run_id").orderBy(phase_rank(), F.col("sample_no"))
    prev = F.lag("n_groups").over(w)
    return per_snap.withColumn("changed", F.coalesce(F.col("n_groups") != prev, F.lit(False)))


def end_phase(samples: DataFrame, run_col: str, ts_col: str, marker: DataFrame,
              keep_after: int = 4) -> DataFrame:
    """T6 (batch): per run, samples up to the end marker are phase '', the
    next ``keep_after`` samples phase 'end', later ones are not taken.

    marker: (run_col, marker_ts).  Runs without a marker keep every sample.
    The top-``keep_after`` after the marker is a window group limit, so a
    run with many samples is cut to ``keep_after`` rows per map task before
    the shuffle."""
    m = marker.groupBy(run_col).agg(F.min("marker_ts").alias("_m"))
    j = samples.join(m, run_col, "left")
    before = j.where(F.col("_m").isNull() | (F.col(ts_col) <= F.col("_m"))).withColumn(
        "phase", F.lit(""))
    w = Window.partitionBy(run_col).orderBy(ts_col, *[c for c in samples.columns
                                                     if c not in (run_col, ts_col)])
    after = (j.where(F.col(ts_col) > F.col("_m"))
              .withColumn("_rn", F.row_number().over(w))
              .where(F.col("_rn") <= keep_after)
              .drop("_rn")
              .withColumn("phase", F.lit("end")))
    return before.unionByName(after).drop("_m")
