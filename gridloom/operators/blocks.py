"""Long ordered groups cut into blocks of rows, each with a margin of its neighbours' rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.runtime import hot_groups, materialize

#: Stretches a long group is cut into at most; their bounds are quantiles, true to 1 / ACCURACY of the group's rows.
STRETCHES, ACCURACY = 1_024, 20_000


def with_bounds(rows: DataFrame, keys: list[str], at: str, pieces: Column) -> DataFrame:
    """keys and `bounds`: up to STRETCHES - 1 values of `at` (bigint) that cut a group's rows into `pieces` of about equally many, however its times lie.

    `pieces` is over the greatest `group_rows` of the group. The quantiles' sketches are merged from parts, so no task sees a group.
    """
    cuts = F.array(*[F.lit(k / STRETCHES) for k in range(1, STRETCHES)])
    q = rows.groupBy(*keys).agg(F.percentile_approx(at, cuts, ACCURACY).alias("q"), F.max("group_rows").alias("group_rows"))
    q = q.withColumn("pieces", F.least(pieces, F.lit(STRETCHES)).cast("int"))
    pick = f"transform(filter(sequence(1, greatest(pieces - 1, 1)), k -> k < pieces), k -> element_at(q, cast(greatest(1, least({STRETCHES - 1}, round(k * {STRETCHES} / pieces))) AS int)))"
    return q.select(*keys, F.expr(f"array_sort({pick})").alias("bounds"))


def piece_of(at: str) -> Column:
    """How many of the row's `bounds` are at or before it, by halving."""
    step = f"IF(a + shiftleft(1, k) <= size(bounds) AND get(bounds, a + shiftleft(1, k) - 1) <= {at}, a + shiftleft(1, k), a)"
    return F.expr(f"IF(bounds IS NULL, 0, aggregate(sequence({STRETCHES.bit_length() - 1}, 0, -1), 0, (a, k) -> {step}))").cast("long")


def ordered_blocks(df: DataFrame, keys: list[str], at: str, ties: list[str], block_rows: int, margin: int) -> tuple[DataFrame, DataFrame | None]:
    """`df` with `block` and `is_margin`: the groups that are one block, and those that were cut, if any.

    Groups of up to `block_rows` rows are one block. Longer ones are cut into blocks of exactly that many rows in the order
    of (at, ties), where each block also gets the `margin` rows before and after it. Positions come from counts per stretch
    between quantiles of `at` and ranks within one, so no task orders a whole long group, unless it lies in one instant. `at` is a bigint.
    """
    long = hot_groups(df, keys, block_rows)
    whole = df.withColumn("block", F.lit(0).cast("long")).withColumn("is_margin", F.lit(False))
    if long is None:
        return whole, None
    long = materialize(long, "long-groups")
    rows = df.join(long, keys)
    long = long.join(materialize(with_bounds(rows, keys, at, F.ceil(F.col("group_rows") / block_rows)), "bounds"), keys)
    rows = df.join(long, keys).withColumn("stretch", piece_of(f"`{at}`"))
    counts = rows.groupBy(*keys, "stretch").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "stretch", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy(*keys, "stretch").orderBy(at, *ties)) - 1
    placed = rows.withColumn("rank", rank).join(offsets, [*keys, "stretch"]).withColumn("place", F.col("offset") + F.col("rank"))
    own, within = F.floor(F.col("place") / block_rows).cast("long"), F.col("place") % block_rows
    here = lambda b, m: F.struct(b.cast("long").alias("block"), F.lit(m).alias("is_margin"))
    spread = F.filter(
        F.array(here(own, False), F.when((within < margin) & (own > 0), here(own - 1, True)), F.when((within >= block_rows - margin) & ((own + 1) * block_rows < F.col("group_rows")), here(own + 1, True))),
        lambda x: x.isNotNull(),
    )
    cut = placed.select(*df.columns, F.explode(spread).alias("s")).select(*df.columns, "s.block", "s.is_margin")
    return whole.join(long.select(*keys), keys, "left_anti").select(*cut.columns), cut
