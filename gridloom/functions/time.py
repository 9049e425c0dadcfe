"""Columns on instants (`timestamp_ntz`, microseconds, UTC)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZERO = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(column: str) -> Column:
    """Microseconds since 1970 of a `timestamp_ntz` (a column's name or SQL), whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {_ZERO}, {column})")


def instant(column: str) -> Column:
    """The `timestamp_ntz` of microseconds since 1970 (a column's name or SQL)."""
    return F.expr(f"timestampadd(MICROSECOND, {column}, {_ZERO})")


def moment(d: datetime) -> Column:
    """A naive datetime as a `timestamp_ntz`, whatever the zone of the session or the machine."""
    return F.lit(d.isoformat(sep=" ")).cast("timestamp_ntz")


def text(c: Column, micro: bool = False) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS" if micro else "yyyy-MM-dd HH:mm:ss")
