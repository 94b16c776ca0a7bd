"""Epoch-second calendar fields computed by integer arithmetic.

Arithmetic keeps the result independent of ``spark.sql.session.timeZone`` and inside
whole-stage codegen; 1970-01-01 was a Thursday (Monday = 0 gives 3).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400
EPOCH_WEEKDAY = 3  # fixed value: Monday=0 index of 1970-01-01


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds_ntz(ts: str) -> Column:
    """Whole seconds since 1970-01-01 of a TIMESTAMP_NTZ column read as UTC wall time, floored.

    ``timestampdiff`` between two NTZ values is plain arithmetic, so no session zone applies.
    """
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")
    return F.floor(micros / F.lit(1_000_000)).cast("bigint")


def hour_utc(t) -> Column:
    """UTC hour 0-23 of epoch seconds."""
    return F.floor(F.pmod(_c(t), F.lit(SECONDS_PER_DAY)) / F.lit(3600)).cast("int")


def dow_monday0(t) -> Column:
    """Weekday of epoch seconds, Monday = 0 (not Spark's Sunday = 1 ``dayofweek``)."""
    days = F.floor(_c(t) / F.lit(SECONDS_PER_DAY))
    return F.pmod(days + F.lit(EPOCH_WEEKDAY), F.lit(7)).cast("int")
