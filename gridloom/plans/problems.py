"""The queries of the general problems (p2 to p6) over the store's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.time import text
from gridloom.operators.changes import ATTRIBUTE
from gridloom.operators.faults import faulty_readings
from gridloom.operators.grid import SOURCE, regular_series, usable_readings
from gridloom.operators.history import attribute_history
from gridloom.operators.references import check_references, orphans_by_period, parents, references
from gridloom.operators.replay import current_values
from gridloom.runtime import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    h = attribute_history(table(spark, folder, "syschangelog"))
    ended = F.coalesce(text(F.col("valid_to"), micro=True), F.lit(""))
    return h.select(*ATTRIBUTE, text(F.col("valid_from"), micro=True).alias("valid_from"), ended.alias("valid_to"))


def p2_history(spark: SparkSession, folder: str) -> DataFrame:
    h = attribute_history(table(spark, folder, "syschangelog"))
    return h.select(*ATTRIBUTE, "value", text(F.col("valid_from"), micro=True).alias("valid_from"), text(F.col("valid_to"), micro=True).alias("valid_to"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    s = regular_series(usable_readings(table(spark, folder, "systimeseriesbasevalues")))
    return s.where("is_missing").select(*SOURCE, text(F.col("slot_start")).alias("slot_start"))


def p3_series(spark: SparkSession, folder: str) -> DataFrame:
    s = regular_series(usable_readings(table(spark, folder, "systimeseriesbasevalues")))
    return s.select(*SOURCE, text(F.col("slot_start")).alias("slot_start"), "n", "is_missing", F.round("slot_value", 6).alias("slot_value"), F.round("previous_value", 6).alias("previous_value"), F.round("next_value", 6).alias("next_value"), F.round("linear_value", 6).alias("linear_value"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return faulty_readings(table(spark, folder, "systimeseriesbasevalues"), table(spark, folder, "property_limits")).select("id")


def p4_faults(spark: SparkSession, folder: str) -> DataFrame:
    return faulty_readings(table(spark, folder, "systimeseriesbasevalues"), table(spark, folder, "property_limits"))


def _reference_states(spark: SparkSession, folder: str) -> DataFrame:
    t = {n: table(spark, folder, n) for n in ("systimeseriesbasevalues", "systimeseriesdeltas", "sysanalytics", "sysanalyticssteps", "sysembeddings", "sensors", "rooms", "syschangelog")}
    received, key = F.col("received_at"), F.col("id")
    log = t["syschangelog"].where(F.lower("change_type") == "delete")
    there = (
        parents(t["systimeseriesbasevalues"], F.lit("base"), key, True, received)
        .unionByName(parents(t["sysanalytics"], F.lit("sysAnalytics"), key, True, received))
        .unionByName(parents(t["sensors"], F.lit("Sensors"), key, False, received))
        .unionByName(parents(t["rooms"], F.lit("Rooms"), key, False, received))
        .unionByName(parents(log.where("table_name = 'sysAnalytics'"), F.col("table_name"), F.col("entity_id"), True, None, deleted=True))
        .unionByName(parents(log.where("table_name <> 'sysAnalytics'"), F.col("table_name"), F.col("entity_id"), False, None, deleted=True))
    )
    refs = (
        references(t["systimeseriesdeltas"], "systimeseriesdeltas", key, F.lit("base"), F.col("base_value_id"), True, received)
        .unionByName(references(t["sysanalyticssteps"], "sysanalyticssteps", key, F.lit("sysAnalytics"), F.col("analytics_id"), True, received))
        .unionByName(references(t["sysembeddings"], "sysembeddings", key, F.col("table_name"), F.col("entity_id"), False, received))
    )
    return check_references(refs, there)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _reference_states(spark, folder).where("ref_state <> 'ok'").select("source_table", "record_id", "ref_state")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    r = orphans_by_period(_reference_states(spark, folder))
    return r.select("source_table", text(F.col("period")).alias("period"), "ref_state", "n", "share")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return current_values(table(spark, folder, "syschangelog")).select(*ATTRIBUTE, "current_value")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_history, p3_found, p3_series, p4_found, p4_faults, p5_found, p5_report, p6_found)
}
