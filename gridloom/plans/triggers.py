"""Which changes start which programs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.options import StepType
from gridloom.plans import sqltext
from gridloom.plans.program import Program

#: Triggers that go to every task.
MAX_BROADCAST = 100_000
TRIGGERS = "AnalyticsId string, TableName string, PropertyName string"


def triggers_of(spark: SparkSession, program: Program, compat: bool = False, schemas: Mapping[str, StructType] | None = None) -> list[tuple[str, str | None]]:
    """(table, column) pairs a program depends on; a column of None means any.

    Series steps: the table and property they name. Queries: what their plan reads; with `compat` the words after FROM and JOIN
    with those in aggregates of one word.
    """
    found: list[tuple[str, str | None]] = []
    for s in program.steps:
        if s.kind is StepType.SERIES:
            parts = [p.strip() for p in s.config.split(",")]
            if len(parts) >= 3:
                found.append((parts[0], parts[2]))
        elif s.kind is StepType.SQL:
            if compat:
                found += sqltext.tables_and_aggregates(s.config)
            else:
                found += sqltext.tables_and_columns(spark, s.config, {t.lower(): x.names for t, x in (schemas or {}).items()})[1]
    return list(dict.fromkeys(found))


def matches(events: DataFrame, triggers: DataFrame) -> DataFrame:
    """AnalyticsId, EventId of each program and each event that starts it.

    Inserts and deletions start it by table (regardless of case), updates if a trigger's column changed as well. Triggers are
    few (steps of programs); up to MAX_BROADCAST of them are broadcast, more meet the events by table.
    """
    t = triggers.select("AnalyticsId", F.lower("TableName").alias("t"), "PropertyName")
    few = t.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    hit = events.join(F.broadcast(t) if few else t, F.lower(events["TableName"]) == t["t"])
    changed = (F.col("Operation") != "Update") | F.col("PropertyName").isNull() | F.map_contains_key(F.col("Changed"), F.coalesce("PropertyName", F.lit("")))
    return hit.where(changed).select("AnalyticsId", "EventId").distinct()


def throttled(runs: DataFrame, seconds: int = 10, by: str = "AnalyticsId", at: str = "Timestamp") -> DataFrame:
    """Of each program's triggered instants, those that run: not within `seconds` of the last that did. Others are dropped.

    The instants of one program collapse to distinct ones first; what remains within one program is walked in order.
    """
    listed = runs.groupBy(by).agg(F.array_sort(F.collect_set(at)).alias("all"))
    walk = F.expr(f"aggregate(all, filter(all, x -> false), (a, x) -> IF(size(a) = 0 OR x >= timestampadd(SECOND, {int(seconds)}, element_at(a, -1)), array_append(a, x), a))")
    return listed.select(by, F.explode(walk).alias(at))
