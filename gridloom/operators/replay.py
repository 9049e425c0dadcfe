"""Applying a feed of inserts, updates and deletes: the state at the end (problem 6).

Changes are made distinct and chained within their instants; of the instants with an effect the latest per key is
kept, and the outcome is merged into a base, dropping what was deleted. The latest is aggregated before the
shuffle by key, so a key with a third of all changes sends only one row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.changes import ATTRIBUTE, distinct_changes, transitions


def current_values(log: DataFrame) -> DataFrame:
    """The attributes that hold a non-null value after all changes: attribute, current_value, changed_at.

    * Repeated and late rows don't matter; order is changed_at, within one instant by chained values.
    * An update whose latest earlier insert or delete is a delete has no effect; without any such
      earlier row (the first rows can be lost) it counts.
    * An empty log gives an empty result; rows with a null key part, instant or unknown kind are no changes.
    """
    # Any number of the last instants can be rings of changes, without effect: all instants are walked before the latest is taken.
    steps = transitions(distinct_changes(log))
    last_row = F.max(F.when(F.col("effect") != "change", F.struct("changed_at", "effect")))
    last_value = F.max(F.when(F.col("effect") != "gone", F.struct("changed_at", "value")))
    return (
        steps.groupBy(*ATTRIBUTE)
        .agg(last_row.alias("row"), last_value.alias("val"))
        .where("NOT coalesce(row.effect = 'gone', false) AND val.value IS NOT NULL")
        .select(*ATTRIBUTE, F.col("val.value").alias("current_value"), F.col("val.changed_at").alias("changed_at"))
    )


def apply_changes(base: DataFrame, log: DataFrame) -> DataFrame:
    """A base of (attribute, current_value) after the log: attributes the log names take the log's outcome."""
    named = distinct_changes(log).select(*ATTRIBUTE).distinct()
    kept = base.select(*ATTRIBUTE, "current_value").join(named, ATTRIBUTE, "left_anti")
    return kept.unionByName(current_values(log).select(*ATTRIBUTE, "current_value"))
