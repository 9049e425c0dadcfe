"""References to records that are missing, deleted or arrive later (problem 5).

Keys become (space, prefix, integer). The keys of parents and those referred to are sorted together by ranges and numbered
densely in that order; sorted parents compress into runs of contiguous numbers, which only keys without a parent part. A key
referred to is matched as of the run that starts at or before it, and is an orphan if it lies beyond that run's end. When
parents were received is kept beside the runs, by number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.text import GUID
from gridloom.runtime import materialize, meet

KEY = ["space", "prefix", "n"]
_NUMBERED = r"^(.*?)(0|[1-9][0-9]{0,16})$"


def key_parts(key: Column, guids: bool) -> tuple[Column, Column]:
    """The prefix and the integer that together stand for a key, and for no other.

    A guid (any letter case, where `guids`) is split into 17 and 15 hexadecimal digits, a text with a number at its
    end before that number; any other text has no integer part but 0.
    """
    digits = F.translate(F.lower(key), "-", "")
    prefix, n = F.regexp_extract(key, _NUMBERED, 1), F.regexp_extract(key, _NUMBERED, 2)
    is_guid = key.rlike(GUID) & F.lit(guids)
    return (
        F.when(is_guid, F.concat(F.lit("g"), F.substring(digits, 1, 17))).when(n != "", F.concat(F.lit("n"), prefix)).otherwise(F.concat(F.lit("t"), key)),
        F.when(is_guid, F.conv(F.substring(digits, 18, 15), 16, 10)).when(n != "", n).otherwise(F.lit("0")).cast("long"),
    )


def _keyed(df: DataFrame, space: Column, key: Column, guids: bool, *others: Column) -> DataFrame:
    prefix, n = key_parts(key, guids)
    return df.select(space.alias("space"), prefix.alias("prefix"), n.alias("n"), *others)


def parents(df: DataFrame, space: Column, key: Column, guids: bool, received_at: Column | None, deleted: bool = False) -> DataFrame:
    """Parent records as keyed rows. `deleted`: rows that tell of a deletion rather than a record."""
    at = received_at if received_at is not None else F.lit(None).cast("timestamp_ntz")
    return _keyed(df.where(key.isNotNull() & space.isNotNull()), space, key, guids, at.alias("received_at"), F.lit(deleted).alias("deleted"))


def contiguous_runs(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last number of each run of contiguous ones, from ascending numbers."""
    cut = np.nonzero(np.diff(numbers) > 1)[0]
    if not len(numbers):
        return numbers, numbers
    return numbers[np.concatenate(([0], cut + 1))], numbers[np.concatenate((cut, [len(numbers) - 1]))]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted keys (a parent before the reference to it), each one referred to with what is known of its parent.

    Equal keys lie in one range, so only a batch's last parent is carried on to the next one.
    """
    carried: pa.RecordBatch | None = None
    for b in batches:
        t = pa.Table.from_batches([b] if carried is None else [carried, b]).combine_chunks()
        if not t.num_rows:
            continue
        new = np.zeros(t.num_rows, bool)
        for c in KEY:
            new[1:] |= pc.not_equal(t[c].slice(1), t[c].slice(0, t.num_rows - 1)).to_numpy(zero_copy_only=False)
        number = np.cumsum(new)
        is_ref = t["is_ref"].to_numpy(zero_copy_only=False)
        parent = np.nonzero(~is_ref)[0]
        start, stop = contiguous_runs(number[parent])
        asked = np.nonzero(is_ref)[0]
        run = np.searchsorted(start, number[asked], side="right") - 1
        inside = run >= 0
        inside[inside] = number[asked][inside] <= stop[run[inside]]
        # A number inside a run is the parent's that was counted last: its place among the parents.
        place = np.searchsorted(number[parent], number[asked])
        at = pa.array(np.where(inside, parent[np.minimum(place, max(len(parent) - 1, 0))] if len(parent) else 0, 0), mask=~inside)
        refs = t.take(pa.array(asked))
        out = [refs[c].combine_chunks() for c in (*KEY, "group_rows")]
        yield pa.RecordBatch.from_arrays([*out, t["first"].combine_chunks().take(at), pc.fill_null(t["gone"].combine_chunks().take(at), False)], [*KEY, "group_rows", "first", "gone"])
        last = t.slice(t.num_rows - 1)
        carried = None if is_ref[-1] else last.to_batches()[0]


def references(df: DataFrame, source_table: str, record_id: Column, space: Column, key: Column, guids: bool, received_at: Column) -> DataFrame:
    """Referring records as keyed rows; copies of one record are one, received when its earliest copy was. A null is no reference."""
    rows = _keyed(df.where(key.isNotNull() & space.isNotNull()), space, key, guids, F.lit(source_table).alias("source_table"), record_id.alias("record_id"), received_at.alias("referred_at"))
    return rows.groupBy("source_table", "record_id", *KEY).agg(F.min("referred_at").alias("referred_at"))


def check_references(refs: DataFrame, there: DataFrame) -> DataFrame:
    """Every reference with its ref_state: ok, late, deleted or missing; `there` are the parents.

    Columns: source_table, record_id, referred_at, ref_state. Repeats of a key collapse before any shuffle, so a key that a third of
    all references point to is one row of the sorted scan; its references then meet the outcome by broadcast (see `meet`).
    """
    refs = materialize(refs, "references")
    known = there.groupBy(*KEY).agg(F.min("received_at").alias("first"), F.max("deleted").alias("gone"))
    asked = refs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("group_rows"))
    none = F.lit(None).cast("timestamp_ntz")
    both = known.select(*KEY, F.lit(False).alias("is_ref"), F.lit(0).cast("bigint").alias("group_rows"), "first", "gone")
    both = both.unionByName(asked.select(*KEY, F.lit(True).alias("is_ref"), "group_rows", none.alias("first"), F.lit(False).alias("gone")))
    both = materialize(both, "keys")  # sorting by ranges reads them twice
    schema = "space string, prefix string, n bigint, group_rows bigint, first timestamp_ntz, gone boolean"
    outcome = both.repartitionByRange(*KEY).sortWithinPartitions(*KEY, "is_ref").mapInArrow(_scan, schema)
    hit = meet(refs, outcome, KEY, refs.count())
    state = (
        F.when(F.col("first") > F.col("referred_at"), "late")
        .when(F.col("first").isNotNull(), "ok")
        .when(F.col("gone"), "deleted")
        .otherwise("missing")
    )
    return hit.select("source_table", "record_id", "referred_at", state.alias("ref_state"))


def orphans_by_period(states: DataFrame, period: str = "month") -> DataFrame:
    """References per table, period of receipt and state, with their share of the table's references in that period."""
    counted = states.withColumn("period", F.date_trunc(period, "referred_at")).groupBy("source_table", "period", "ref_state").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("source_table", "period")
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(whole), 6)).where("ref_state <> 'ok'")
