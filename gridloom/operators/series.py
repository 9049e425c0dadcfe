"""Observations as distinct values with offsets, range reads, and interpolation on a grid.

Observations are rows of series keys (any columns), a timestamp (`timestamp_ntz`) and a value (string).
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.time import micros, moment
from gridloom.options import Interpolation

KEYS = ["TableName", "EntityId", "PropertyName"]
#: Offsets of one value are kept in lists of an hour each, so that no list grows with the history.
LIST_MS = 3_600_000


def base_values(obs: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Each distinct value of a series with the instant it was first observed. A null value counts as the empty text."""
    v = F.coalesce(F.col(value).cast("string"), F.lit("")).alias("Value")
    return obs.where(F.col(ts).isNotNull()).groupBy(*keys, v).agg(F.min(ts).alias("BaseTimestamp"))


def with_offsets(obs: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Observations with their value's BaseTimestamp and OffsetMs (whole milliseconds, cut off)."""
    rows = obs.where(F.col(ts).isNotNull()).withColumn("Value", F.coalesce(F.col(value).cast("string"), F.lit("")))
    base = base_values(obs, keys, ts, value)
    same = [rows[k].eqNullSafe(base[k]) for k in keys] + [rows["Value"] == base["Value"]]
    out = rows.join(base, _all(same)).select(*[rows[k] for k in keys], rows["Value"], rows[ts].alias("Timestamp"), base["BaseTimestamp"])
    return out.withColumn("OffsetMs", F.expr("timestampdiff(MILLISECOND, BaseTimestamp, Timestamp)"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def encode(obs: DataFrame, keys: list[str], ts: str, value: str, list_ms: int = LIST_MS) -> DataFrame:
    """keys, Value, BaseTimestamp, StartMs, Deltas, LastTimestamp, Version: one row per value and stretch of offsets.

    Deltas are steps in ms from StartMs, the first one 0; repeats of an instant are steps of 0. Version counts them.
    """
    rows = with_offsets(obs, keys, ts, value).withColumn("Stretch", F.floor(F.col("OffsetMs") / list_ms))
    lists = rows.groupBy(*keys, "Value", "BaseTimestamp", "Stretch").agg(F.array_sort(F.collect_list("OffsetMs")).alias("o"))
    return lists.select(
        *keys,
        "Value",
        "BaseTimestamp",
        F.expr("o[0]").alias("StartMs"),
        F.expr("transform(o, (x, i) -> x - coalesce(get(o, i - 1), x))").alias("Deltas"),
        F.expr("element_at(o, -1)").alias("LastTimestamp"),
        F.size("o").alias("Version"),
    )


def decode(encoded: DataFrame, keys: list[str], start: Column | None = None, end: Column | None = None) -> DataFrame:
    """keys, Timestamp, Value of each observation with start <= Timestamp <= end, both ends included.

    Rows of values first seen after `end` are left out by the scan.
    """
    rows = encoded if end is None else encoded.where(F.col("BaseTimestamp") <= end)
    sums = F.expr("aggregate(Deltas, cast(array() AS array<bigint>), (a, d) -> concat(a, array(d + coalesce(try_element_at(a, -1), StartMs))))")
    out = rows.select(*keys, "Value", "BaseTimestamp", F.explode(sums).alias("ms"))
    out = out.select(*keys, F.expr("timestampadd(MILLISECOND, ms, BaseTimestamp)").alias("Timestamp"), "Value")
    if start is not None:
        out = out.where(F.col("Timestamp") >= start)
    return out if end is None else out.where(F.col("Timestamp") <= end)


def varint_encode(deltas: list[int]) -> bytes:
    """The compact form of deltas: magnitude in groups of 7 bits, lowest first, then one byte for the sign."""
    out = bytearray()
    for d in deltas:
        size = abs(d)
        while size > 0x7F:
            out.append((size & 0x7F) | 0x80)
            size >>= 7
        out += bytes((size, d < 0))
    return bytes(out)


def varint_decode(data: bytes) -> list[int]:
    out, size, shift, at = [], 0, 0, 0
    while at < len(data):
        byte = data[at]
        at += 1
        size |= (byte & 0x7F) << shift
        shift += 7
        if not byte & 0x80:
            if at >= len(data):
                raise ValueError("deltas end without a sign")
            out.append(-size if data[at] else size)
            at, size, shift = at + 1, 0, 0
    if shift:
        raise ValueError("deltas end within a number")
    return out


def interpolate(samples: DataFrame, keys: list[str], start: datetime, end: datetime, step: timedelta, method: Interpolation | str, ts: str = "Timestamp", value: str = "Value", order: str | None = None, compat: bool = False) -> DataFrame:
    """keys, Timestamp, Value (text, two decimals; raw for None), Number: the series on the grid start, start + step, ... <= end.

    * Only samples within [start, end] count; a series without any has no rows.
    * None: grid points that have a sample, with its raw text (of several, the first by `order`).
    * Linear: on the line between the samples around; beyond the first or last one, its value. On a sample, its value, or
      no row with `compat`. Nearest: the nearer one, the earlier of two equally near. Previous, Next: or no row.
    * A text that is no number gives no row; with Nearest it raises.

    Samples shrink to one row per series and grid step before the shuffle, so a long series is no large group.
    """
    method = method if isinstance(method, Interpolation) else Interpolation.parse(method)
    us = int(step / timedelta(microseconds=1))
    if us <= 0:
        raise ValueError("the interval must be positive")
    zero = int((start - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    last = int((end - start) / timedelta(microseconds=1)) // us
    t = F.col(ts)
    inside = samples.where((t >= moment(start)) & (t <= moment(end)))
    tie = F.col(order) if order else F.lit(0)
    point = inside.select(*keys, micros(ts).alias("at"), tie.alias("tie"), F.col(value).cast("string").alias("v"))
    point = point.withColumn("cell", F.floor((F.col("at") - zero) / us).cast("long"))
    s = F.struct("at", "tie", "v")
    on = F.when(F.col("at") == zero + F.col("cell") * us, s)
    cells = point.groupBy(*keys, "cell").agg(F.min(s).alias("first"), F.max(s).alias("last"), F.min(on).alias("on_first"), F.max(on).alias("on_last"))
    if method is Interpolation.NONE:
        hit = cells.where("on_first IS NOT NULL")
        return hit.select(*keys, _instant(zero, us, "cell").alias("Timestamp"), F.col("on_first.v").alias("Value"), F.col("on_first.v").try_cast("double").alias("Number"))
    # Empty stretches are filled from the nearest cells that have samples, which a scan over cells finds.
    scan = Window.partitionBy(*keys).orderBy("cell")
    linked = cells.withColumn("before", F.lag("last").over(scan)).withColumn("after", F.struct(F.lead("cell").over(scan).alias("cell"), F.lead("first").over(scan).alias("s")))
    first_cell = F.when(F.lag("cell").over(scan).isNull(), F.lit(0)).otherwise(F.col("cell"))
    linked = linked.withColumn("from_cell", first_cell)
    until = F.coalesce(F.col("after.cell") - 1, F.lit(last))
    grid = linked.withColumn("g", F.explode(F.sequence("from_cell", until.cast("long"))))
    here, gone = F.col("g") == F.col("cell"), F.col("g") > F.col("cell")
    prev = F.when(gone, F.col("last")).when(here, F.coalesce(F.col("on_last"), F.col("before")))
    nxt = F.when(gone, F.col("after.s")).when(here, F.col("first")).otherwise(F.col("first"))
    out = grid.select(*keys, (F.lit(zero) + F.col("g") * us).alias("at"), prev.alias("p"), nxt.alias("n"))
    cast = "cast" if method is Interpolation.NEAREST else "try_cast"
    pv, nv = F.expr(f"{cast}(p.v AS double)"), F.expr(f"{cast}(n.v AS double)")
    if method is Interpolation.PREVIOUS:
        number = F.expr("try_cast(p.v AS double)")
    elif method is Interpolation.NEXT:
        number = F.expr("try_cast(n.v AS double)")
    elif method is Interpolation.NEAREST:
        nearer = F.abs(F.col("p.at") - F.col("at")) <= F.abs(F.col("n.at") - F.col("at"))
        number = F.when(F.col("p").isNull(), nv).when(F.col("n").isNull(), pv).when(nearer, pv).otherwise(nv)
    else:
        share = (F.col("at") - F.col("p.at")) / F.when(F.col("n.at") > F.col("p.at"), F.col("n.at") - F.col("p.at"))
        line = F.when(F.col("n.at") > F.col("p.at"), pv + (nv - pv) * share)
        if not compat:
            line = F.coalesce(line, F.when(F.col("n.at") == F.col("p.at"), pv))
        number = F.when(F.col("p").isNull(), nv).when(F.col("n").isNull(), pv).otherwise(line)
    out = out.select(*keys, _instant(0, 1, "at").alias("Timestamp"), number.alias("Number")).where("Number IS NOT NULL")
    return out.select(*keys, "Timestamp", F.format_string("%.2f", "Number").alias("Value"), "Number")


def _instant(zero: int, us: int, column: str) -> Column:
    return F.expr(f"timestampadd(MICROSECOND, {zero}L + {column} * {us}L, TIMESTAMP_NTZ'1970-01-01 00:00:00')")


_SPAN = re.compile(r"\s*(-)?(?:(\d+)\.)?(\d{1,2}):(\d{2})(?::(\d{2})(\.\d{1,7})?)?\s*")


def parse_interval(text: str) -> timedelta:
    """`[d.]hh:mm[:ss[.fffffff]]`; plain numbers, which would be days, are refused."""
    m = _SPAN.fullmatch(text)
    if not m or int(m[3]) > 23 or int(m[4]) > 59 or int(m[5] or 0) > 59:
        raise ValueError("Invalid interval format.")
    span = timedelta(days=int(m[2] or 0), hours=int(m[3]), minutes=int(m[4]), seconds=int(m[5] or 0), microseconds=round(float(m[6] or 0) * 1e6))
    return -span if m[1] else span


def parse_expression(text: str) -> tuple[str, str, str, datetime, datetime, timedelta, Interpolation]:
    """The series expression `table,entity,property,start,end[,interval[,method]]`; one second and None by default."""
    parts = [p.strip() for p in text.split(",")]
    if not 5 <= len(parts) <= 7:
        raise ValueError("Timeseries expression must have 5 to 7 components: tableName,entityId,propertyName,start,end[,interval,method]")
    try:
        start = _moment(parts[3])
    except ValueError:
        raise ValueError("Invalid start date format.") from None
    try:
        end = _moment(parts[4])
    except ValueError:
        raise ValueError("Invalid end date format.") from None
    step = parse_interval(parts[5]) if len(parts) > 5 else timedelta(seconds=1)
    method = Interpolation.parse(parts[6]) if len(parts) > 6 else Interpolation.NONE
    return parts[0], parts[1], parts[2], start, end, step, method


def _moment(text: str) -> datetime:
    d = datetime.fromisoformat(text)
    return d.replace(tzinfo=None) if d.tzinfo is None else (d - d.utcoffset()).replace(tzinfo=None)


def read_expression(samples: DataFrame, text: str, compat: bool = False) -> DataFrame:
    """The series an expression names, of samples with KEYS, Timestamp, Value. Method None reads the raw samples."""
    name, entity, prop, start, end, step, method = parse_expression(text)
    mine = samples.where((F.col("TableName") == name) & (F.col("EntityId") == entity) & (F.col("PropertyName") == prop))
    if method is Interpolation.NONE:
        t = F.col("Timestamp")
        return mine.where((t >= moment(start)) & (t <= moment(end))).select(*KEYS, "Timestamp", "Value")
    return interpolate(mine, KEYS, start, end, step, method, compat=compat).select(*KEYS, "Timestamp", "Value")
