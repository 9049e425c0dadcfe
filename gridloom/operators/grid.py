"""Irregular readings onto a regular grid, slots without a reading marked and filled (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.text import number

SOURCE = ["table_name", "entity_id", "property_name"]
#: Stamps before this are lost clocks.
FIRST_YEAR = "2020-01-01 00:00:00"


def usable_readings(values: DataFrame) -> DataFrame:
    """Base values whose text is a number and whose stamp is no lost clock, with that number as `number`.

    Rows with a null source part, stamp or text are not usable. Repeated rows are kept.
    """
    kept = values.where(F.col("reading_timestamp") >= F.lit(FIRST_YEAR).cast("timestamp_ntz")).dropna(subset=SOURCE)
    return kept.withColumn("number", number(F.col("reading_value"))).where("number IS NOT NULL")


def regular_series(readings: DataFrame, minutes: int = 15) -> DataFrame:
    """One row per source and slot from its first to its last usable reading.

    Columns: source, slot_start, n (readings in the slot), slot_value (latest in the slot, ties: greatest),
    is_missing, previous_value (last before an empty slot), next_value, linear_value (on the line between
    the two, at the slot's start).

    Each source is cut into shards of a day. Readings first shrink to one row a slot, before any shuffle, so a
    shard is small whatever the number of readings. Its summary (first and last slot) passes to its neighbours by
    a scan over summaries, and each shard then fills itself, with the gap up to the next shard's first slot.
    A source with one usable slot gives that slot; no usable reading gives no row.
    """
    step = minutes * 60
    seconds = "timestampdiff(SECOND, TIMESTAMP_NTZ'2000-01-01 00:00:00', reading_timestamp)"
    slots = (
        readings.select(*SOURCE, "reading_timestamp", "number", F.expr(f"floor({seconds} / {step})").cast("long").alias("slot"))
        .groupBy(*SOURCE, "slot")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("reading_timestamp", "number")).alias("last"), F.min(F.struct("reading_timestamp", "number")).alias("first"))
        .withColumn("shard", F.floor(F.col("slot") * step / 86400).cast("long"))
    )
    item = F.struct("slot", "n", F.col("last.number").alias("value"), F.col("first.reading_timestamp").alias("first_at"), F.col("first.number").alias("first_value"), F.col("last.reading_timestamp").alias("last_at"))
    shards = slots.groupBy(*SOURCE, "shard").agg(F.array_sort(F.collect_list(item)).alias("own"))
    scan = Window.partitionBy(*SOURCE).orderBy("shard")
    shards = shards.withColumn("carry", F.lead(F.expr("own[0]")).over(scan))
    # Within a shard each slot knows its successor; the last one takes the carried summary.
    linked = shards.select(*SOURCE, F.explode(F.expr("transform(own, (x, i) -> struct(x AS here, coalesce(get(own, i + 1), carry) AS after))")).alias("p"))
    grid = linked.select(*SOURCE, "p.here", "p.after", F.explode(F.expr("sequence(p.here.slot, coalesce(p.after.slot - 1, p.here.slot))")).alias("slot"))
    start = f"timestampadd(SECOND, slot * {step}, TIMESTAMP_NTZ'2000-01-01 00:00:00')"
    gone = "timestampdiff(MICROSECOND, here.last_at, {0})"
    share = f"{gone.format(start)} / {gone.format('after.first_at')}"
    missing = F.col("slot") > F.col("here.slot")
    return grid.select(
        *SOURCE,
        F.expr(start).alias("slot_start"),
        F.when(missing, F.lit(0)).otherwise(F.col("here.n")).cast("long").alias("n"),
        F.when(~missing, F.col("here.value")).alias("slot_value"),
        missing.alias("is_missing"),
        F.when(missing, F.col("here.value")).alias("previous_value"),
        F.when(missing, F.col("after.first_value")).alias("next_value"),
        F.when(missing, F.expr(f"here.value + (after.first_value - here.value) * ({share})")).alias("linear_value"),
    )
