"""Time columns: epoch seconds and date text, independent of the session time zone."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE_FORMAT = "yyyy-MM-dd"  # the reference's %Y-%m-%d
BOUND_FORMAT = "%Y-%b-%d"   # the reference's plot bound format, e.g. 2020-Jan-05


def epoch_seconds(c: Column, dtype: T.DataType) -> Column:
    """Whole seconds since 1970-01-01 UTC (floored).

    TIMESTAMP_NTZ and DATE carry wall-clock fields; they are read as UTC without a session
    time-zone cast, so the value does not depend on ``spark.sql.session.timeZone``.
    """
    if isinstance(dtype, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("bigint") * F.lit(86400)
    if isinstance(dtype, T.TimestampNTZType):
        micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), c)
        return _floor_div(micros, 1_000_000)
    if isinstance(dtype, T.TimestampType):
        return _floor_div(F.unix_micros(c), 1_000_000)
    if isinstance(dtype, (T.LongType, T.IntegerType)):
        return c.cast("bigint")
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return F.floor(c).cast("bigint")
    raise TypeError(f"cannot take epoch seconds of {dtype}")


def _floor_div(x: Column, d: int) -> Column:
    """Integer floor division (exact; also below zero)."""
    return ((x - F.pmod(x, F.lit(d))) / F.lit(d)).cast("bigint")


def date_of(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        return F.to_date(c)
    return F.to_date(c.cast("string"))


def date_text(c: Column) -> Column:
    """C6."""
    return F.date_format(c, DATE_FORMAT)


def bound_epoch(text: str) -> int:
    """A bound typed as ``%Y-%b-%d`` -> epoch seconds at UTC midnight (decision Q14)."""
    d = _dt.datetime.strptime(text, BOUND_FORMAT).replace(tzinfo=_dt.timezone.utc)
    return int(d.timestamp())
