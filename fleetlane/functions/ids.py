"""Task-id helpers (version-1 UUIDs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlane.functions.timefmt import idiv

# Shape of a well-formed lower-case UUID and the offset between
# the UUID epoch (1582-10-15) and the Unix epoch in 100 ns ticks.
UUID_RE = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
UUID_EPOCH_OFFSET_100NS = 122192928000000000

# Stand-in ids for driver rows: the key's low 32 bits fill time_low, its
# high 32 bits the end of the node field, so any BIGINT gives a valid id.
# (The format of the SQL twin; standin_uuid() writes the same.)
STANDIN_UUID_FMT = "%08x-0000-1000-8000-00aa%08x"


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike(UUID_RE), F.lit(False))


def standin_uuid(key: Column) -> Column:
    """Deterministic v1-shaped id for an integer key (tests and stand-ins)."""
    k = key.cast("bigint")
    low, high = (F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0") for x in (k, F.shiftrightunsigned(k, 32)))
    return F.lower(F.concat(low, F.lit("-0000-1000-8000-00aa"), high))


def uuid_v1_time(u: Column) -> Column:
    """Creation time embedded in a version-1 UUID (session time zone UTC)."""
    hexts = F.concat(F.substring(u, 16, 3), F.substring(u, 10, 4), F.substring(u, 1, 8))
    ticks = F.conv(hexts, 16, 10).cast("bigint")
    return F.timestamp_micros(idiv(ticks - F.lit(UUID_EPOCH_OFFSET_100NS), 10))
