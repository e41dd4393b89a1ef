"""Contrast family: makespan series across strategies / node counts
(O24, O29, O30, O30b).

A makespan series is a long table (strategy, nodes, n_tasks, seconds); a
usage series is (run_id, idx, value).  Ratios are rounded with integer
arithmetic on milliseconds so that every engine gets the same digits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def _ms(c):
    return F.round(c * 1000).cast("bigint")


def strategy_join(series: DataFrame, strategies: Sequence[str],
                  keys: Sequence[str] = ("nodes", "n_tasks")) -> DataFrame:
    """Align the strategies on node and task count, one column
    ``sec_<strategy>`` each; a combination missing for a strategy is NULL,
    of several values the smallest counts.  Same rows as a chain of full
    outer equi-joins, as one pivot aggregation over one pass."""
    p = series.groupBy(*keys).pivot("strategy", list(strategies)).agg(F.min("seconds"))
    return p.select(*keys, *[F.col(f"`{s}`").alias(f"sec_{s.lower()}") for s in strategies])


def _round_ratio_tenths(num, den):
    """round(1000 * num / den) half-up for non-negative BIGINTs, exactly:
    floor((2000 * num + den) / (2 * den))."""
    n = F.lit(2000) * num + den
    d = F.nullif(F.lit(2) * den, F.lit(0).cast("bigint"))  # no share of nothing
    return F.call_function("div", n - F.pmod(n, d), d)


def phase_share(series: DataFrame, warm: str, cold: str,
                keys: Sequence[str] = ("nodes", "n_tasks")) -> DataFrame:
    """Work share warm/cold and scaling share (cold - warm)/cold, in
    percent with one decimal, aligned on ``keys`` (so values of different
    node or task counts are never paired); NULL if cold rounds to 0 ms."""
    j = strategy_join(series, [warm, cold], keys)
    w, c = _ms(F.col(f"sec_{warm.lower()}")), _ms(F.col(f"sec_{cold.lower()}"))
    work = _round_ratio_tenths(w, c)
    return (j.where(F.col(f"sec_{warm.lower()}").isNotNull() & F.col(f"sec_{cold.lower()}").isNotNull())
             .select(*keys, F.col(f"sec_{warm.lower()}").alias("warm_s"),
                     F.col(f"sec_{cold.lower()}").alias("cold_s"),
                     (work.cast("double") / 10).alias("work_pct"),
                     ((F.lit(1000) - work).cast("double") / 10).alias("scaling_pct")))


def series_contrast(series: DataFrame, runs: Sequence, idx: str = "idx",
                    run_col: str = "run_id", value_col: str = "value",
                    prefix: str = "run_") -> DataFrame:
    """One wide row per index with a column per run.  The run list is
    passed explicitly, so the pivot is a single aggregation (no extra job
    to discover the values)."""
    p = (series.groupBy(idx).pivot(run_col, list(runs)).agg(F.first(value_col)))
    return p.select(idx, *[F.col(f"`{r}`").alias(f"{prefix}{r}") for r in runs])


def node_normalise(series: DataFrame) -> DataFrame:
    """Makespan by average tasks per node: keep n_tasks divisible by
    nodes, x = n_tasks / nodes."""
    return (series.where(F.pmod(F.col("n_tasks"), F.col("nodes")) == 0)
                  .withColumn("tasks_per_node", (F.col("n_tasks") / F.col("nodes")).cast("bigint")))


def node_contrast(series: DataFrame, nodes: Sequence[int] = (1, 2, 4)) -> DataFrame:
    """The strategies' makespans by average tasks per node, one
    column ``sec_<n>`` per node count."""
    p = (node_normalise(series).groupBy("strategy", "tasks_per_node").pivot("nodes", list(nodes))
         .agg(F.min("seconds")))
    return p.select("strategy", "tasks_per_node", *[F.col(f"`{n}`").alias(f"sec_{n}") for n in nodes])
