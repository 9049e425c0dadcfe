"""The history of changing attributes: each value with the period it held (problem 2).

Tree reduction: every transition is a unit interval up to the next one of its attribute. Leaf blocks of
bounded size merge neighbouring units of equal payload into runs; then neighbouring blocks are merged
pairwise, round by round, each round looking only at the run at either edge of a block. A history of any
length thus takes a logarithmic number of rounds and no task ever holds more than a block of it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.time import micros
from gridloom.operators.blocks import piece_of, with_bounds
from gridloom.operators.changes import ATTRIBUTE, distinct_changes, named, transitions
from gridloom.runtime import hot_groups, materialize

#: Histories of more rows are cut at quantiles of their instants into leaf blocks of about so many rows or the root of their length,
#: if that is more; into `blocks.STRETCHES` at most.
BLOCK_ROWS = 64
#: Rounds of merging between two written tables; within them Spark reuses the exchange of each round.
ROUNDS_A_JOB = 3


def _blocked(log: DataFrame, steps: DataFrame, block_rows: int) -> tuple[DataFrame, int]:
    """The transitions with `block` (0 for all short histories), and the number of blocks of the longest."""
    changes = named(log)
    long = hot_groups(changes, ATTRIBUTE, block_rows)
    if long is None:
        return steps.withColumn("block", F.lit(0).cast("long")), 1
    rows = changes.select(*ATTRIBUTE, micros("changed_at").alias("at")).join(materialize(long, "long-histories"), ATTRIBUTE)
    pieces = F.ceil(F.col("group_rows") / F.greatest(F.lit(block_rows), F.sqrt("group_rows")))
    bounds = materialize(with_bounds(rows, ATTRIBUTE, "at", pieces), "bounds")
    most = bounds.agg(F.max(F.size("bounds"))).first()[0] + 1
    placed = steps.join(bounds, ATTRIBUTE, "left").withColumn("at", micros("changed_at"))
    return placed.select(*steps.columns, piece_of("at").alias("block")), most


def _alive(units: DataFrame, blocks: int) -> DataFrame:
    """Payload of each unit: its value, or null where the row is gone. Updates of a row that is gone don't count."""
    in_block = Window.partitionBy(*ATTRIBUTE, "block").orderBy("changed_at")
    row = F.when(F.col("effect") != "change", F.col("effect"))
    units = units.withColumn("row", F.last(row, ignorenulls=True).over(in_block))
    if blocks > 1:
        # What earlier blocks leave behind: a scan over one row per block.
        ends = units.groupBy(*ATTRIBUTE, "block").agg(F.max_by("row", "changed_at").alias("end"))
        before = Window.partitionBy(*ATTRIBUTE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        carry = ends.select(*ATTRIBUTE, "block", F.last("end", ignorenulls=True).over(before).alias("carry"))
        units = units.join(carry, [*ATTRIBUTE, "block"]).withColumn("row", F.coalesce("row", "carry"))
    gone = F.coalesce(F.col("row") == "gone", F.lit(False))
    return units.select(*ATTRIBUTE, "block", "changed_at", F.when(~gone, F.col("value")).alias("payload"))


def runs(units: DataFrame, keys: list[str], at: str, payload: str, block: str, blocks: int) -> DataFrame:
    """Runs of neighbouring units of equal payload: keys, from_at, to_at (null: still open), payload.

    `units` has one row per key and instant; `block` orders the leaf blocks of a key, of which the longest
    key has `blocks`.
    """
    p = F.col(payload)
    in_leaf = Window.partitionBy(*keys, block).orderBy(at)
    starts = (
        units.withColumn("n", F.row_number().over(in_leaf))
        .withColumn("same", F.lag(payload).over(in_leaf).eqNullSafe(p) & (F.col("n") > 1))
        .where("NOT same")
        .select(*keys, F.col(block).alias("block"), F.col(at).alias("from_at"), p.alias("payload"))
    )
    in_leaf = Window.partitionBy(*keys, "block").orderBy("from_at")
    leaf = starts.withColumn("to_at", F.lead("from_at").over(in_leaf)).withColumn("first", F.lag("from_at").over(in_leaf).isNull())
    if blocks == 1:
        return leaf.select(*keys, "from_at", "to_at", "payload")
    leaf = materialize(leaf, "leaf-runs")
    # Inner runs are done. An edge row is a block's first and last run; `alone` if they are one.
    done = [leaf.where("NOT first AND to_at IS NOT NULL").select(*keys, "from_at", "to_at", "payload")]
    run = F.struct("from_at", "payload", "to_at")
    edges = (
        leaf.where("first OR to_at IS NULL")
        .groupBy(*keys, "block")
        .agg(F.min_by(run, "from_at").alias("head"), F.max_by(run, "from_at").alias("tail"))
    )
    for k in range(math.ceil(math.log2(blocks))):
        pair = (
            edges.groupBy(*keys, F.shiftright("block", 1).alias("block"))
            .agg(F.min_by(F.struct("head", "tail"), "block").alias("a"), F.max_by(F.struct("head", "tail"), "block").alias("b"), F.count(F.lit(1)).alias("parts"))
        )
        pair = pair.select(*keys, "block", F.expr(_merge()).alias("m"))
        if k % ROUNDS_A_JOB == ROUNDS_A_JOB - 1:
            pair = materialize(pair, "merged-runs")
        done.append(pair.select(*keys, F.explode("m.closed").alias("c")).select(*keys, "c.from_at", "c.to_at", "c.payload"))
        edges = pair.select(*keys, "block", "m.head", "m.tail")
    top = edges.select(*keys, F.explode(F.expr("IF(head.from_at = tail.from_at, array(tail), array(head, tail))")).alias("c"))
    done.append(top.select(*keys, "c.from_at", "c.to_at", "c.payload"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _merge() -> str:
    """SQL: the edge runs of two neighbouring blocks a and b, and the runs that thereby are complete."""
    one = "{0}.head.from_at = {0}.tail.from_at"
    closed_tail = "named_struct('from_at', a.tail.from_at, 'payload', a.tail.payload, 'to_at', b.head.from_at)"
    # Where the payload goes on, b's head is no run of its own: a's tail takes over its end.
    joined = "named_struct('from_at', a.tail.from_at, 'payload', a.tail.payload, 'to_at', b.head.to_at)"
    none = "filter(array(a.tail), x -> false)"
    a1, b1 = one.format("a"), one.format("b")
    return f"""CASE
        WHEN parts = 1 THEN named_struct('head', a.head, 'tail', a.tail, 'closed', {none})
        WHEN a.tail.payload <=> b.head.payload THEN named_struct(
            'head', IF({a1}, {joined}, a.head),
            'tail', IF({b1}, {joined}, b.tail),
            'closed', IF(NOT ({a1}) AND NOT ({b1}), array({joined}), {none}))
        ELSE named_struct(
            'head', IF({a1}, {closed_tail}, a.head),
            'tail', b.tail,
            'closed', concat(IF({a1}, {none}, array({closed_tail})), IF({b1}, {none}, array(b.head))))
    END"""


def attribute_history(log: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every longest stretch in which an attribute holds one non-null value.

    Returns attribute, value, valid_from, valid_to (null: it still holds). Late and repeated rows don't
    matter; only the last value of an instant counts, so stretches of no duration don't appear. Setting
    the value an attribute holds already doesn't end its stretch. An empty log gives an empty result.
    """
    units, blocks = _blocked(log, transitions(distinct_changes(log)), block_rows)
    found = runs(_alive(units, blocks), ATTRIBUTE, "changed_at", "payload", "block", blocks)
    return found.where("payload IS NOT NULL").select(
        *ATTRIBUTE, F.col("payload").alias("value"), F.col("from_at").alias("valid_from"), F.col("to_at").alias("valid_to")
    )


def history_from_snapshots(snapshots: DataFrame, keys: list[str], taken_at: str, value: str) -> DataFrame:
    """The same from periodic snapshots (key, taken_at, value): a row missing from a later snapshot is gone.

    A key is taken as gone at the first snapshot of the table that lacks it. Ties of one key in one
    snapshot: the greatest value. Null keys and times are left out.
    """
    rows = snapshots.dropna(subset=[*keys, taken_at]).groupBy(*keys, F.col(taken_at).alias("at")).agg(F.max(value).alias("payload"))
    times = rows.select("at").distinct()
    numbered = times.withColumn("next_at", F.lead("at").over(Window.orderBy("at")))  # one row per snapshot of the table
    own = Window.partitionBy(*keys).orderBy("at")
    rows = rows.join(numbered, "at").withColumn("own_next", F.lead("at").over(own))
    gaps = rows.where("next_at IS NOT NULL AND NOT own_next <=> next_at").select(*keys, F.col("next_at").alias("at"), F.lit(None).cast(rows.schema["payload"].dataType).alias("payload"))
    units = rows.select(*keys, "at", "payload").unionByName(gaps).withColumn("block", F.lit(0))
    found = runs(units, keys, "at", "payload", "block", 1)
    return found.where("payload IS NOT NULL").select(*keys, F.col("payload").alias("value"), F.col("from_at").alias("valid_from"), F.col("to_at").alias("valid_to"))
