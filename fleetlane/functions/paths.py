"""Completion-log path normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlane.functions.text import strip_ws


def normalise_log_path(path: Column, log_root: str) -> Column:
    """Strip one leading ``logs/``; absolute paths are kept, relative ones
    are joined to ``log_root``."""
    p = F.regexp_replace(strip_ws(path), "^logs/", "")
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(log_root.rstrip("/") + "/"), p))
