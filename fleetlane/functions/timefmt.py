"""Time helpers: epoch conversions and the HH:MM:SS text of the logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_ts(c: Column) -> Column:
    """TIMESTAMP_NTZ (how Spark reads the parquet) -> TIMESTAMP in UTC."""
    return c.cast("timestamp")


def epoch_us(c: Column) -> Column:
    return F.unix_micros(as_ts(c))


def idiv(x: Column, n: int) -> Column:
    """Exact floor division of a BIGINT by a positive constant (integer
    arithmetic, so also above 2^53)."""
    x = x.cast("bigint")
    return F.call_function("div", x - F.pmod(x, F.lit(n).cast("bigint")), F.lit(n).cast("bigint"))


def epoch_ms_rounded(c: Column) -> Column:
    """Epoch milliseconds rounded half-up (the logs keep 3 decimals)."""
    return idiv(epoch_us(c) + F.lit(500), 1000)


def hms(c: Column) -> Column:
    return F.date_format(c, "HH:mm:ss")


def ts_text(c: Column) -> Column:
    """Stable text form of a timestamp (microseconds)."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
