"""Two states of a table compared: change log rows and change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paired(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """EntityId, o, n: each row's state before and after (null where there is none), matched by key as text."""
    a = old.select(F.col(key).cast("string").alias("EntityId"), F.struct(*old.columns).alias("o"))
    b = new.select(F.col(key).cast("string").alias("EntityId"), F.struct(*new.columns).alias("n"))
    return a.join(b, "EntityId", "full_outer")


def operation() -> Column:
    return F.when(F.col("o").isNull(), "Insert").when(F.col("n").isNull(), "Delete").otherwise("Update")


def json_text(df: DataFrame, side: str, column: str) -> Column:
    """A value as JSON text (non-ASCII letters as they are), or null."""
    c = F.col(f"{side}.{column}")
    if df.schema[side].dataType[column].dataType.typeName() in ("struct", "array", "map"):
        return F.to_json(c)
    wrapped = f"to_json(struct({side}.`{column}` AS v))"
    return F.when(c.isNotNull(), F.expr(f"substring({wrapped}, 6, length({wrapped}) - 6)"))


def change_log(pairs: DataFrame, table: str, tracked: list[str], changed_at: Column, changed_by: str = "System") -> DataFrame:
    """Log rows of the tracked columns that differ; values as JSON, null for none.

    Inserts log values that aren't null, deletions old values that aren't null, updates any difference.
    """
    each = F.array(*[F.struct(F.lit(c).alias("PropertyName"), json_text(pairs, "o", c).alias("OriginalValue"), json_text(pairs, "n", c).alias("NewValue")) for c in tracked])
    rows = pairs.select("EntityId", operation().alias("ChangeType"), F.explode(each).alias("c"))
    rows = rows.where("NOT c.OriginalValue <=> c.NewValue").select("EntityId", "ChangeType", "c.*")
    return rows.select(
        F.sha2(F.concat_ws("|", F.lit(table), "EntityId", "PropertyName", "ChangeType", changed_at.cast("string")), 256).alias("Id"),
        F.lit(table).alias("TableName"),
        "EntityId",
        F.lit(changed_by).alias("ChangedBy"),
        "PropertyName",
        changed_at.alias("ChangedAt"),
        "OriginalValue",
        "NewValue",
        "ChangeType",
    )


def change_events(pairs: DataFrame, table: str, columns: list[str], at: Column) -> DataFrame:
    """One event per changed row: all columns that differ, by name, as texts; none for inserts and deletions.

    Rows that didn't change give no event.
    """
    names = F.array(*[F.lit(c) for c in columns])
    values = F.array(*[F.struct(F.col(f"o.{c}").cast("string").alias("old"), F.col(f"n.{c}").cast("string").alias("new")) for c in columns])
    differing = F.map_filter(F.map_from_arrays(names, values), lambda _, v: ~v["old"].eqNullSafe(v["new"]))
    rows = pairs.withColumn("Operation", operation()).withColumn("Changed", F.when(F.col("Operation") == "Update", differing).otherwise(F.map_filter(differing, lambda k, v: F.lit(False))))
    rows = rows.where((F.col("Operation") != "Update") | (F.size("Changed") > 0))
    ident = F.sha2(F.concat_ws("|", F.lit(table), "EntityId", "Operation", at.cast("string")), 256)
    return rows.select(ident.alias("EventId"), F.lit(table).alias("TableName"), "EntityId", "Operation", "Changed", at.alias("Timestamp"))
