"""Time-zone-free conversions between timestamps and epoch micros.

``TIMESTAMP_NTZ`` values are wall-clock times; casting them to ``TIMESTAMP``
goes through the session time zone, so epoch numbers would depend on where
the cluster runs.  These helpers measure NTZ values from the NTZ epoch
instead (UTC semantics, like DuckDB), and use instants for ``TIMESTAMP``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _ntz(dtype) -> bool:
    return isinstance(dtype, T.TimestampNTZType)


def epoch_us(c: Column, dtype) -> Column:
    """Microseconds since 1970-01-01 (NTZ: wall clock read as UTC)."""
    if _ntz(dtype):
        return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), c)
    return F.unix_micros(c)


def from_epoch_us(us: Column, dtype) -> Column:
    """Inverse of :func:`epoch_us` for a column of type ``dtype``."""
    if _ntz(dtype):
        return F.timestamp_add("MICROSECOND", us, F.expr(_EPOCH_NTZ))
    return F.timestamp_micros(us)


def epoch_ms(c: Column, dtype) -> Column:
    """Epoch millis, truncated (floor) like ``unix_millis``."""
    return F.floor(epoch_us(c, dtype) / F.lit(1000)).cast("long")
