"""Hash chains of values: computed, appended to, verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAIN = ["TableName", "EntityId", "PropertyName"]


class DataIntegrityError(ValueError):
    """A value that isn't what the log says, or a broken chain."""

    def __init__(self, table: str, entity: str, column: str, expected: str, actual: str):
        super().__init__(f"Data integrity violation in {table}, entity {entity}, property {column}: expected {expected}, got {actual}")
        self.table, self.entity, self.column, self.expected, self.actual = table, entity, column, expected, actual


def value_hash(c: Column) -> Column:
    """Base64 of the SHA-256 of a value's text; null as the empty text."""
    return F.base64(F.unhex(F.sha2(F.coalesce(c.cast("string"), F.lit("")), 256)))


def chain(rows: DataFrame, keys: list[str], ts: str, value: str, order: list[str] | None = None) -> DataFrame:
    """keys, ts, order, Hash, PreviousHash: each value's hash and that of the one before it in its chain (empty for the first)."""
    w = Window.partitionBy(*keys).orderBy(ts, *(order or []))
    hashed = rows.select(*keys, ts, *(order or []), value_hash(F.col(value)).alias("Hash"))
    return hashed.withColumn("PreviousHash", F.coalesce(F.lag("Hash").over(w), F.lit("")))


def latest(log: DataFrame) -> DataFrame:
    """The last hash of each chain. Of several at one instant, the greatest."""
    return log.groupBy(*CHAIN).agg(F.max(F.struct("Timestamp", "Hash")).alias("x")).select(*CHAIN, F.col("x.Hash").alias("Hash"))


def append(log: DataFrame, values: DataFrame, at: Column) -> DataFrame:
    """New log rows of values (CHAIN, Value), linked to the last ones of the log."""
    last = latest(log).withColumnRenamed("Hash", "PreviousHash")
    new = values.select(*CHAIN, value_hash(F.col("Value")).alias("Hash"))
    out = new.join(last, CHAIN, "left").withColumn("PreviousHash", F.coalesce("PreviousHash", F.lit("")))
    ident = F.sha2(F.concat_ws("|", *CHAIN, "Hash", at.cast("string")), 256)
    return out.select(ident.alias("Id"), *CHAIN, "Hash", "PreviousHash", at.alias("Timestamp"))


def unpivot(rows: DataFrame, table: str, key: str, columns: list[str]) -> DataFrame:
    """CHAIN and Value of the given columns of a table."""
    each = F.array(*[F.struct(F.lit(c).alias("PropertyName"), F.col(c).cast("string").alias("Value")) for c in columns])
    out = rows.select(F.col(key).cast("string").alias("EntityId"), F.explode(each).alias("c"))
    return out.select(F.lit(table).alias("TableName"), "EntityId", "c.PropertyName", "c.Value")


def violations(values: DataFrame, log: DataFrame) -> DataFrame:
    """Values whose hash isn't the last one of their chain: CHAIN, Expected, Actual. Values without a chain pass."""
    joined = values.join(latest(log).withColumnRenamed("Hash", "Expected"), CHAIN)
    return joined.withColumn("Actual", value_hash(F.col("Value"))).where("Expected <> Actual").select(*CHAIN, "Expected", "Actual")


def broken_links(log: DataFrame, strict_anchor: bool = False) -> DataFrame:
    """Log rows whose PreviousHash isn't the hash before them: CHAIN, Timestamp, Expected, Actual.

    The oldest row's is only checked (to be empty) with `strict_anchor`.
    """
    before = F.lag("Hash").over(Window.partitionBy(*CHAIN).orderBy("Timestamp", "Id"))
    rows = log.withColumn("Expected", F.coalesce(before, F.lit("")) if strict_anchor else before)
    return rows.where("Expected IS NOT NULL AND NOT Expected <=> PreviousHash").select(*CHAIN, "Timestamp", "Expected", F.col("PreviousHash").alias("Actual"))


def raise_first(found: DataFrame) -> None:
    """Raise for the first violation, if there is any."""
    for r in found.limit(1).collect():
        raise DataIntegrityError(r["TableName"], r["EntityId"], r["PropertyName"], r["Expected"], r["Actual"])
