"""History and replay of change logs against a plain walk over sorted changes."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridloom.functions.time import micros
from gridloom.operators.blocks import ordered_blocks
from gridloom.operators.changes import distinct_changes, transitions
from gridloom.operators.history import _blocked, attribute_history, history_from_snapshots
from gridloom.operators.replay import apply_changes, current_values

T0 = datetime(2025, 1, 1)
SCHEMA = "id string, table_name string, entity_id string, changed_by string, property_name string, changed_at timestamp_ntz, original_value string, new_value string, change_type string, received_at timestamp_ntz"


def quoted(v):
    return None if v is None else f'"{v}"'


def make_log(spark, changes):
    """changes: (entity, property, at, kind, old, new), values as they are."""
    rows = [(str(i), "Sensors", e, None, p, at, quoted(o), quoted(n), k, at) for i, (e, p, at, k, o, n) in enumerate(changes)]
    return spark.createDataFrame(rows, SCHEMA)


def random_changes(seed, entities, length):
    r = random.Random(seed)
    out = []
    for e in range(entities):
        value, alive, at = None, False, T0
        for _ in range(r.randint(1, length)):
            at += timedelta(microseconds=r.randint(1, 10**10))
            for _ in range(r.choice([1, 1, 1, 2, 3])):
                new = r.choice("abcd") + str(r.randint(0, 3))
                if not alive:
                    kind = r.choice(["Insert", "Insert", "Update"])
                    out.append((f"e{e}", "p", at, kind, None if kind == "Insert" else "lost", new))
                    if kind == "Insert":
                        alive, value = True, new
                    break
                if r.random() < 0.15:
                    out.append((f"e{e}", "p", at, "Delete", value, None))
                    alive, value = False, None
                    break
                if new == value or any(c[2] == at and c[0] == f"e{e}" and (c[4] == new or c[5] == new) for c in out[-4:]):
                    continue
                out.append((f"e{e}", "p", at, "UPDATE", value, new))
                value = new
    return out


def walked(changes):
    """(entity, value, from, to) by walking each entity's changes, which are given in order."""
    stretches, current = [], {}
    by = {}
    for c in changes:
        by.setdefault(c[0], []).append(c)
    for e, own in by.items():
        gone, value, states = False, None, []
        for _, _, at, kind, _, new in own:
            kind = kind.lower()
            if kind == "delete":
                gone, value = True, None
            elif kind == "insert":
                gone, value = False, new
            elif not gone:
                value = new
            states.append((at, value))
        last_of = {}
        for at, v in states:
            last_of[at] = v
        runs = []
        for at, v in sorted(last_of.items()):
            if not runs or runs[-1][1] != v:
                runs.append((at, v))
        for i, (at, v) in enumerate(runs):
            if v is not None:
                stretches.append((e, v, at, runs[i + 1][0] if i + 1 < len(runs) else None))
        if runs and runs[-1][1] is not None:
            current[e] = runs[-1][1]
    return sorted(stretches, key=str), current


@pytest.mark.parametrize("seed,block_rows", [(1, 64), (2, 3), (3, 1)])
def test_history_and_state(spark, seed, block_rows):
    changes = random_changes(seed, 12, 40) + random_changes(seed + 100, 1, 300)[:0]
    shuffled = changes + random.Random(seed).sample(changes, len(changes) // 3)
    random.Random(seed).shuffle(shuffled)
    log = make_log(spark, shuffled)
    want, state = walked(changes)
    got = attribute_history(log, block_rows).select("entity_id", "value", "valid_from", "valid_to").collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    assert {r["entity_id"]: r["current_value"] for r in current_values(log).collect()} == state


def test_one_long_history_in_many_blocks(spark):
    """A single attribute with all rows: blocks, carries and rounds of merging all take part."""
    changes = [("hot", "p", T0 + timedelta(seconds=i), "Update", f"v{(i - 1) // 7 % 3}", f"v{i // 7 % 3}") for i in range(1000)]
    log = make_log(spark, changes)
    want, _ = walked(changes)
    for block_rows in (10, 64, 10_000):
        got = attribute_history(log, block_rows).select("entity_id", "value", "valid_from", "valid_to").collect()
        assert sorted((tuple(r) for r in got), key=str) == want


def test_updates_after_a_deletion_far_back(spark):
    """The deletion lies blocks before the updates that it makes void."""
    changes = [("x", "p", T0, "Insert", None, "a"), ("x", "p", T0 + timedelta(seconds=1), "Delete", "a", None)]
    changes += [("x", "p", T0 + timedelta(seconds=2 + i), "Update", f"{i - 1}", f"{i}") for i in range(200)]
    log = make_log(spark, changes)
    got = attribute_history(log, 5).collect()
    assert [(r["value"], r["valid_from"], r["valid_to"]) for r in got] == [("a", T0, T0 + timedelta(seconds=1))]
    assert current_values(log).isEmpty()


def test_chains_within_an_instant(spark):
    at = T0
    later = T0 + timedelta(seconds=5)
    changes = [
        ("a", "p", at, "Update", "2", "3"), ("a", "p", at, "Update", "1", "2"), ("a", "p", at, "Insert", None, "1"),
        ("b", "p", at, "Insert", None, "1"), ("b", "p", later, "Update", "1", "2"), ("b", "p", later, "Update", "2", "1"),  # a ring
        ("c", "p", at, "Insert", None, "1"), ("c", "p", later, "Delete", "1", None), ("c", "p", later, "Insert", None, "9"),
        ("d", "p", at, "Delete", "0", None), ("d", "p", later, "Update", None, "5"),
        ("e", "p", at, "Update", "1", None),
    ]
    log = make_log(spark, changes)
    assert {r["entity_id"]: r["current_value"] for r in current_values(log).collect()} == {"a": "3", "b": "1", "c": "9"}
    got = {(r["entity_id"], r["value"]): (r["valid_from"], r["valid_to"]) for r in attribute_history(log).collect()}
    assert got == {("a", "3"): (at, None), ("b", "1"): (at, None), ("c", "1"): (at, later), ("c", "9"): (later, None)}


def test_many_rings_at_the_end(spark):
    """Rings of changes have no effect, however many of them come last."""
    at = lambda i: T0 + timedelta(seconds=i)
    update = [("b", "p", at(1), "Update", "A", "B")]
    rings = [("b", "p", at(2 + i), "Update", *x) for i in range(4) for x in (("B", "C"), ("C", "B"))]
    rows = [("b", "p", T0, "Insert", None, "A")]
    gone = [("g", "p", T0, "Insert", None, "A"), ("g", "p", at(1), "Delete", "A", None)]
    gone += [("g", "p", at(2 + i), *x) for i in range(3) for x in (("Insert", None, "C"), ("Delete", "C", None))]
    for log in (rows + update + rings + gone, update + rings + gone):
        log = make_log(spark, log)
        assert [(r["entity_id"], r["current_value"], r["changed_at"]) for r in current_values(log).collect()] == [("b", "B", at(1))]
        assert [r["value"] for r in attribute_history(log).where("valid_to IS NULL").collect()] == ["B"]


def test_spellings_nulls_and_empty_logs(spark):
    g = "0A1B2C3D-0000-1111-2222-333344445555"
    rows = [
        ("1", "Sensors", "s", None, "p", T0, None, '"a\\u00b0"', "Insert", T0),
        ("1", "Sensors", "s", None, "p", T0, None, '"a°" ', "INSERT", T0),
        ("2", "sysAnalytics", g, None, "Value", T0, None, '"raw"', "insert", T0),
        ("3", "sysAnalytics", g.lower(), None, "Value", T0 + timedelta(seconds=1), '"raw"', "2", "Update", T0),
        ("4", None, "s", None, "p", T0, None, '"x"', "Insert", T0),
        ("5", "Sensors", None, None, "p", T0, None, '"x"', "Insert", T0),
        ("6", "Sensors", "s", None, None, T0, None, '"x"', "Insert", T0),
        ("7", "Sensors", "s", None, "p", None, None, '"x"', "Insert", T0),
        ("8", "Sensors", "s", None, "p", T0, None, '"x"', None, T0),
        ("9", "Sensors", "s", None, "p", T0, None, '"x"', "Rename", T0),
        ("10", "Sensors", "q", None, "p", T0, None, "null", "Insert", T0),
        ("11", "Sensors", "n", None, "p", T0, None, "not json", "Insert", None),
        ("12", "Sensors", "empty", None, "p", T0, None, '""', "Insert", None),
    ]
    log = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit(1)).withColumn("group_rows", F.lit("x")).withColumn("payload", F.lit(0))
    want = {("Sensors", "s"): "a°", ("sysAnalytics", g.lower()): "2", ("Sensors", "n"): "not json", ("Sensors", "empty"): ""}
    assert {(r["table_name"], r["entity_id"]): r["current_value"] for r in current_values(log).collect()} == want
    assert attribute_history(log).count() == 5
    nothing = log.limit(0)
    assert attribute_history(nothing).isEmpty() and current_values(nothing).isEmpty()


def test_merging_into_a_base(spark):
    base = spark.createDataFrame([("Sensors", "a", "p", "old"), ("Sensors", "b", "p", "kept"), ("Sensors", "c", "p", "gone")], "table_name string, entity_id string, property_name string, current_value string")
    log = make_log(spark, [("a", "p", T0, "Update", "old", "new"), ("c", "p", T0, "Delete", "gone", None), ("d", "p", T0, "Insert", None, "more")])
    assert {r["entity_id"]: r["current_value"] for r in apply_changes(base, log).collect()} == {"a": "new", "b": "kept", "d": "more"}


def test_history_from_snapshots(spark):
    d = [T0 + timedelta(days=i) for i in range(4)]
    rows = [("a", d[0], "1"), ("a", d[1], "1"), ("a", d[2], "2"), ("a", d[3], "2"), ("b", d[0], "x"), ("b", d[2], "x"), ("b", d[3], "x"), ("b", d[3], "x"), (None, d[0], "n")]
    snaps = spark.createDataFrame(rows, "k string, day timestamp_ntz, v string")
    got = {(r["k"], r["value"], r["valid_from"], r["valid_to"]) for r in history_from_snapshots(snaps, ["k"], "day", "v").collect()}
    assert got == {("a", "1", d[0], d[2]), ("a", "2", d[2], None), ("b", "x", d[0], d[1]), ("b", "x", d[2], None)}


def test_blocks_of_a_burst_are_small(spark):
    """Nearly all changes of an attribute within a second, after a lone one years before."""
    n = 20_000
    at = F.when(F.col("id") == 0, F.lit("2020-01-01").cast("timestamp_ntz")).otherwise((F.lit(1735689600.0) + F.col("id") / 1e6).cast("timestamp").cast("timestamp_ntz"))
    log = spark.range(n).select(
        F.lit("Rooms").alias("table_name"), F.lit("r").alias("entity_id"), F.lit("Name").alias("property_name"), at.alias("changed_at"),
        ((F.col("id") + 6) % 7).cast("string").alias("original_value"), (F.col("id") % 7).cast("string").alias("new_value"), F.lit("Update").alias("change_type"),
    )
    units, blocks = _blocked(log, transitions(distinct_changes(log)), 64)
    sizes = [r["count"] for r in units.groupBy("block").count().collect()]
    assert blocks == 142 and len(sizes) >= 140 and max(sizes) <= 2 * n / 142
    assert attribute_history(log).count() == n
    readings = log.select("entity_id", micros("changed_at").alias("at"), "new_value")
    cut = ordered_blocks(readings, ["entity_id"], "at", ["new_value"], 1_000, 10)[1]
    assert {r["count"] for r in cut.where("NOT is_margin").groupBy("block").count().collect()} == {1_000} and cut.count() == n + 19 * 20
