"""The change log as ordered transitions of attributes.

An attribute is (table_name, entity_id, property_name). Shared by the history (what held when)
and the replay (what holds at the end).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import fold_guid, json_value

ATTRIBUTE = ["table_name", "entity_id", "property_name"]
#: The table whose values are kept as they are rather than as JSON.
RAW_TABLES = ("sysAnalytics",)
KINDS = ("insert", "update", "delete")


def named(log: DataFrame) -> DataFrame:
    """The rows that are changes at all, with ids of programs (guids) in lower case."""
    raw = F.col("table_name").isin(*RAW_TABLES)
    return (
        log.where(F.lower("change_type").isin(*KINDS) & F.col("changed_at").isNotNull())
        .dropna(subset=ATTRIBUTE)
        .withColumn("entity_id", F.when(raw, fold_guid(F.col("entity_id"))).otherwise(F.col("entity_id")))
    )


def distinct_changes(log: DataFrame) -> DataFrame:
    """The distinct changes: attribute, changed_at, kind, old, new.

    Repeats (same instant, kind without letter case, decoded values) collapse before the shuffle. Rows without
    an attribute part or an instant, or of an unknown kind, are no changes. Entity ids of programs are guids.
    """
    raw = F.col("table_name").isin(*RAW_TABLES)
    decoded = {n: F.when(raw, F.col(c)).otherwise(json_value(F.col(c))) for n, c in (("old", "original_value"), ("new", "new_value"))}
    kind = F.lower("change_type")
    return (
        named(log)
        .select(
            *ATTRIBUTE,
            "changed_at",
            kind.alias("kind"),
            decoded["old"].alias("old"),
            # A deletion leaves nothing, whatever its row says.
            F.when(kind != "delete", decoded["new"]).alias("new"),
        )
        .distinct()
    )


def _walk(changes: str) -> str:
    """SQL: the effect of the changes of one instant, walked so that each starts where the one before it ended.

    The walk begins at a change whose old value no other change made, known old values first. A closed
    ring of changes ends where it began: no effect.
    """
    is_start = "NOT exists({0}, y -> y.new <=> x.old)"
    pick = f"""coalesce(
        get(filter(a.rest, x -> a.moving AND x.old <=> a.at), 0),
        get(filter(a.rest, x -> x.old IS NOT NULL AND {is_start.format("a.rest")}), 0),
        get(filter(a.rest, x -> {is_start.format("a.rest")}), 0),
        get(a.rest, 0))"""
    step = f"""element_at(transform(array({pick}), p -> named_struct(
        'rest', filter(a.rest, x -> NOT (x <=> p)),
        'moving', true,
        'at', p.new,
        'effect', CASE WHEN p.kind = 'insert' THEN 'set' WHEN p.kind = 'delete' THEN 'gone'
                       WHEN a.effect = 'none' THEN 'change' ELSE a.effect END,
        'value', CASE WHEN p.kind = 'update' AND a.effect = 'gone' THEN a.value ELSE p.new END)), 1)"""
    start = f"""named_struct('rest', {changes}, 'moving', false, 'at', cast(null AS string),
        'effect', 'none', 'value', cast(null AS string))"""
    return f"""CASE
        WHEN size({changes}) = 1 THEN named_struct(
            'effect', CASE {changes}[0].kind WHEN 'insert' THEN 'set' WHEN 'delete' THEN 'gone' ELSE 'change' END,
            'value', {changes}[0].new)
        WHEN NOT exists({changes}, x -> {is_start.format(changes)}) THEN
            named_struct('effect', 'none', 'value', cast(null AS string))
        ELSE aggregate({changes}, {start}, (a, i) -> {step}, a -> named_struct('effect', a.effect, 'value', a.value))
    END"""


def transitions(changes: DataFrame) -> DataFrame:
    """One row per attribute and instant: effect `set` (value), `gone`, or `change` (value, if the row lives).

    What collects here is only the distinct changes of one attribute in one microsecond.
    """
    return (
        changes.groupBy(*ATTRIBUTE, "changed_at")
        .agg(F.array_sort(F.collect_list(F.struct("old", "new", "kind"))).alias("at_once"))
        .select(*ATTRIBUTE, "changed_at", F.expr(_walk("at_once")).alias("e"))
        .select(*ATTRIBUTE, "changed_at", "e.effect", "e.value")
        .where("effect <> 'none'")
    )
