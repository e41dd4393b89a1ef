"""T4: fleet usage per sampling window on a stream (batch twin: O27)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_windows(samples: DataFrame, value_col: str, ts_col: str = "ts",
                  window: str = "6500 milliseconds", delay: str = "1 hour", keys=()) -> DataFrame:
    """Tumbling event-time windows (per ``keys``, e.g. run), exact decimal
    sum rounded to 3.  In append mode a window is emitted once the
    watermark passes its end."""
    return (samples.withWatermark(ts_col, delay)
                   .groupBy(*keys, F.window(ts_col, window).alias("w"))
                   .agg(F.round(F.sum(F.col(value_col).cast("decimal(18,4)")), 3)
                        .cast("double").alias(value_col),
                        F.count(F.lit(1)).alias("n_samples")))
