"""Parsing of container snapshot fields (CPU %, memory usage, names)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Container naming scheme of the fleet and the pattern that
# selects fleet containers from a listing.
FLEET_NAME_RE = "hadoop-[a-z]*-[0-9]"
CONTAINER_RE = "^hadoop-(master|slave)-([0-9]+)(?:-([0-9]+))?$"
MASTER_TOKEN = "hadoop-master"

# Byte factors of the memory units a container listing prints.
MEM_UNITS = {
    "B": 1,
    "kB": 1000, "KB": 1000, "MB": 1000 ** 2, "GB": 1000 ** 3, "TB": 1000 ** 4,
    "KiB": 1024, "MiB": 1024 ** 2, "GiB": 1024 ** 3, "TiB": 1024 ** 4,
}

_NUM_UNIT_RE = "^\\s*([0-9]+(?:\\.[0-9]+)?)\\s*([A-Za-z]+)\\s*$"


def pct_decimal(c: Column) -> Column:
    """'186.39%' -> 1.8639 as DECIMAL (exact); malformed -> NULL."""
    return F.trim(c, F.lit("%")).try_cast("decimal(18,4)") * F.lit(0.01).cast("decimal(2,2)")


def _unit_factor(unit: Column) -> Column:
    expr = None
    for u, f in MEM_UNITS.items():
        expr = (F.when(unit == u, F.lit(f)) if expr is None else expr.when(unit == u, F.lit(f)))
    return expr.cast("decimal(18,0)")


def size_bytes(c: Column) -> Column:
    """'726.2MiB' -> 761466061 (bytes, rounded); malformed -> NULL."""
    num = F.regexp_extract(c, _NUM_UNIT_RE, 1).try_cast("decimal(18,4)")
    unit = F.regexp_extract(c, _NUM_UNIT_RE, 2)
    return F.round(num * _unit_factor(unit), 0).cast("bigint")


def mem_used_bytes(usage_limit: Column) -> Column:
    return size_bytes(F.split_part(usage_limit, F.lit("/"), F.lit(1)))


def mem_limit_bytes(usage_limit: Column) -> Column:
    return size_bytes(F.split_part(usage_limit, F.lit("/"), F.lit(2)))


def container_role(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, CONTAINER_RE, 1), F.lit(""))


def container_group(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, CONTAINER_RE, 2), F.lit("")).try_cast("bigint")


def container_slot(name: Column) -> Column:
    """Slave number inside its group; a master is slot 0 of its group."""
    slot = F.nullif(F.regexp_extract(name, CONTAINER_RE, 3), F.lit("")).try_cast("bigint")
    return F.coalesce(slot, F.when(container_role(name) == "master", F.lit(0).cast("bigint")))


def is_fleet(name: Column) -> Column:
    return F.coalesce(name.rlike(FLEET_NAME_RE), F.lit(False))


def is_master(name: Column) -> Column:
    return F.coalesce(name.contains(MASTER_TOKEN), F.lit(False))
