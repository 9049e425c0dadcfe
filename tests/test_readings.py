"""Grids, faults and references against brute force."""

import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.functions.text import number
from gridloom.operators import faults
from gridloom.operators import references as references_module
from gridloom.operators.faults import APART, STUCK, faulty_readings
from gridloom.operators.grid import regular_series, usable_readings
from gridloom.operators.references import check_references, contiguous_runs, key_parts, orphans_by_period, parents, references

T0 = datetime(2025, 3, 1)
VALUES = "id string, table_name string, entity_id string, property_name string, reading_value string, reading_timestamp timestamp_ntz, received_at timestamp_ntz"
LIMITS = "property_name string, min_value double, max_value double, unit string"


def test_numbers(spark):
    texts = {" 1,5 ": 1.5, "+2": 2.0, "1e3": 1000.0, "-.5": -0.5, "5.": 5.0, "\t7 ": 7.0, "1.2.3": None, "NaN": None, "Infinity": None, "": None, "e5": None, "1,234.5": None, "1e999": None, None: None, "0x10": None, "1_0": None, "٣": None}
    df = spark.createDataFrame([(k,) for k in texts], "v string").select("v", number(F.col("v")).alias("n"))
    assert {r["v"]: r["n"] for r in df.collect()} == texts


def test_series_against_a_walk(spark):
    r = random.Random(5)
    rows, want = [], {}
    for e in range(6):
        at = T0 + timedelta(minutes=r.randint(0, 600))
        seen = []
        for i in range(r.randint(1, 60)):
            at += timedelta(minutes=r.choice([1, 3, 20, 70, 2000 if i == 10 else 5]), seconds=r.randint(0, 59))
            rows.append((f"{e}-{i}", "Sensors", f"s{e}", "Co2", str(i), at, at))
            seen.append((at, float(i)))
        slot = lambda t: t - timedelta(minutes=t.minute % 15, seconds=t.second, microseconds=t.microsecond)
        s = slot(seen[0][0])
        while s <= slot(seen[-1][0]):
            inside = [v for t, v in seen if slot(t) == s]
            before = [(t, v) for t, v in seen if t < s]
            after = [(t, v) for t, v in seen if t >= s]
            line = None
            if not inside:
                (t1, a), (t2, b) = before[-1], after[0]
                line = a + (b - a) * ((s - t1) / (t2 - t1))
            want[f"s{e}", s] = (len(inside), inside[-1] if inside else None, not inside, before[-1][1] if not inside else None, after[0][1] if not inside else None, line)
            s += timedelta(minutes=15)
    rows += [(rows[0][0], *rows[0][1:6], rows[0][6] + timedelta(hours=1))]
    rows += [("bad1", "Sensors", "s0", "Co2", "oops", T0 - timedelta(days=9), T0), ("bad2", "Sensors", "s0", "Co2", "1", datetime(1970, 1, 1), T0), ("bad3", "Sensors", None, "Co2", "1", T0, T0), ("bad4", "Sensors", "s0", "Co2", None, T0, T0), ("bad5", "Sensors", "s0", "Co2", "1", None, T0)]
    df = spark.createDataFrame(rows, VALUES).withColumn("slot", F.lit("x")).withColumn("number", F.lit("y"))
    got = {(x["entity_id"], x["slot_start"]): x for x in regular_series(usable_readings(df)).collect()}
    assert got.keys() == want.keys()
    for k, (n, v, missing, a, b, line) in want.items():
        g = got[k]
        assert (g["is_missing"], g["slot_value"], g["previous_value"], g["next_value"]) == (missing, v, a, b)
        assert g["n"] == n + (k == ("s0", min(t for e, t in want if e == "s0")))  # the repeated row
        assert line is None or abs(g["linear_value"] - line) < 1e-9
    assert regular_series(usable_readings(df.limit(0))).isEmpty()


def faulty_source(seed, n=400):
    """Values of a drifting source with a change of level, planted spikes, a stuck run and an impossible value; what was planted."""
    g = np.random.default_rng(seed)
    v = 500 + 30 * np.sin(np.arange(n) / 25) + g.normal(0, 3, n)
    v[n // 2 :] += 120
    planted = set()
    for i in (40, 41, 90, n // 2 + 1, n - 1):
        v[i] += g.choice([-1, 1]) * g.uniform(60, 300)
        planted.add(i)
    v = np.round(v, 1)
    v[250:265] = v[250]
    planted |= set(range(250, 265))
    v[300] = -5.0
    planted.add(300)
    return v, planted


def test_faults(spark):
    rows, want = [], set()
    for e in range(5):
        v, planted = faulty_source(e)
        for i, x in enumerate(v):
            at = T0 + timedelta(minutes=10 * i + (600 if i > 150 else 0))
            rows.append((f"{e}:{i}", "Sensors", f"s{e}", "Co2", repr(float(x)), at, at))
        want |= {f"{e}:{i}" for i in planted}
    hold = [(f"h{i}", "Sensors", "s9", "SetPoint", "21" if i != 30 else "99", T0 + timedelta(minutes=i), T0) for i in range(60)]
    few = [("f1", "Sensors", "s8", "Co2", "500", T0, T0), ("f2", "Sensors", "s8", "Co2", "900", T0 + timedelta(minutes=1), T0), ("f3", "Sensors", "s8", "Humidity.0000001", "101", T0, T0), ("f4", "Sensors", "s8", "Unknown", "1e9", T0, T0)]
    df = spark.createDataFrame(rows + rows[40:45] + hold + few, VALUES).withColumn("limited", F.lit(1)).withColumn("at", F.lit("x"))
    limits = spark.createDataFrame([("Co2", 250.0, 10000.0, "ppm"), ("SetPoint", 5.0, 35.0, "C"), ("Humidity", 0.0, 100.0, "%"), (None, 0.0, 0.0, None), ("Unknown", None, None, None)], LIMITS)
    got = faulty_readings(df, limits).collect()
    assert {r["id"] for r in got} == want | {"h30", "f3"}
    assert len(got) == len({r["id"] for r in got})
    assert {r["id"] for r in got if r["is_beyond"]} == {f"{e}:300" for e in range(5)} | {"h30", "f3"} | {r["id"] for r in got if not 250 <= r["number"] <= 10000 and r["id"][0].isdigit()}
    # Cut into many blocks with margins, the same comes out.
    cut = faulty_readings(df, limits, block_rows=130)
    assert {r["id"] for r in cut.collect()} == want | {"h30", "f3"}
    assert faulty_readings(df.limit(0), limits).isEmpty()
    assert (APART, STUCK) == (7.0, 10)


def test_spikes_come_from_the_ellipsoid():
    g = np.random.default_rng(2)
    v = g.normal(500, 3, 400)
    v[[50, 51, 200, 399]] += (60, 70, -80, 90)
    t, seg, bad = np.arange(400) * 600_000_000, np.zeros(400, int), np.zeros(400, bool)
    got = faults.phase_space_spikes(seg, t, v, bad)
    assert set(np.nonzero(got["candidate"])[0]) >= {50, 51, 200, 399}
    # A value beyond its own scatter times the threshold lies outside, whatever its differences and the turn are.
    for turn in (-1.2, -0.79, 0.0, 0.785, 1.5):
        for s2 in (0.1, 1.0, 5.0):
            e = faults.Ellipsoid(*(np.array([x]) for x in (1.0, 1.0, s2, turn, 400.0)))
            far = np.sqrt(e.reach2[0]) * 1.001
            for d2 in (-9.0, -2.0, 0.0, 0.5, 9.0):
                assert e.outside(np.zeros(1, int), np.array([far]), np.zeros(1), np.array([d2])).all()


def test_without_the_ellipsoid_there_are_no_spikes(monkeypatch):
    v = np.random.default_rng(2).normal(500, 3, 400)
    v[[50, 200]] += 90
    at = pa.array(np.arange(400) * 600_000_000)
    t = pa.table({"s": pa.array(["x"] * 400), "at": at, "number": pa.array(v), "is_beyond": pa.array([False] * 400)})
    assert set(np.nonzero(faults.judge(t, ["s"])["is_spike"])[0]) == {50, 200}
    monkeypatch.setattr(faults.Ellipsoid, "outside", lambda self, seg, u, d1=0.0, d2=0.0: np.zeros(len(u), bool))
    assert not faults.judge(t, ["s"])["is_spike"].any()


def test_a_small_last_block_has_no_vote(spark):
    """A source cut into blocks is judged as one that isn't, whatever lies in its last few readings."""
    g = np.random.default_rng(3)
    n = 1001
    v = np.round(g.normal(500, 3, n), 2)
    v[[100, 400, 777]] += 35
    at = lambda i: T0 + timedelta(minutes=10 * i)
    stuck, noisy = v.copy(), v.copy()
    stuck[-65:] = 500.0
    noisy[-65:] = np.round(g.normal(500, 60, 65), 2)
    rows = [(f"{e}{i}", "Sensors", e, "Co2", repr(float(x)), at(i), at(i)) for e, w in (("plain", v), ("stuck", stuck), ("noisy", noisy)) for i, x in enumerate(w)]
    df, limits = spark.createDataFrame(rows, VALUES), spark.createDataFrame([], LIMITS)
    whole = {(r["id"], r["is_stuck"], r["is_spike"]) for r in faulty_readings(df, limits).collect()}
    assert {("stuck100", False, True), ("noisy100", False, True), ("plain777", False, True)} <= whole
    for size in (500, 1000):
        assert {(r["id"], r["is_stuck"], r["is_spike"]) for r in faulty_readings(df, limits, block_rows=size).collect()} == whole


def test_two_readings_of_an_instant(spark):
    g = np.random.default_rng(1)
    rows = [(f"a{i}", "T", "s", "p", repr(round(float(x), 2)), T0 + timedelta(minutes=i), T0 + timedelta(minutes=i)) for i, x in enumerate(g.normal(10, 1, 100))]
    rows += [("twin", "T", "s", "p", "99", T0 + timedelta(minutes=50), T0 + timedelta(days=1)), ("same", *rows[20][1:6], T0 + timedelta(days=1))]
    limits = spark.createDataFrame([], LIMITS)
    assert [r["id"] for r in faulty_readings(spark.createDataFrame(rows, VALUES), limits).collect()] == ["twin"]


G = "00000000-0000-0000-0000-0000000000{:02x}"


def test_references(spark):
    hour = timedelta(hours=1)
    there = [(G.format(i), T0 + i * hour) for i in range(0, 40) if i not in (7, 8, 20)] + [(G.format(3), T0 - hour), (None, T0), ("odd one", T0)]
    base = spark.createDataFrame(there, "id string, received_at timestamp_ntz").withColumn("n", F.lit(1)).withColumn("space", F.lit(1))
    named = spark.createDataFrame([("sensor10", T0), ("sensor9", T0), ("sensor010", T0), ("Sensor9x", T0), ("", T0)], "id string, received_at timestamp_ntz")
    gone = spark.createDataFrame([("Sensors", "sensor11"), ("Sensors", "sensor10"), ("Sensors", None)], "table_name string, entity_id string")
    r = parents(base, F.lit("base"), F.col("id"), True, F.col("received_at")).unionByName(parents(named, F.lit("Sensors"), F.col("id"), False, F.col("received_at")))
    r = r.unionByName(parents(gone, F.col("table_name"), F.col("entity_id"), False, None, deleted=True))
    deltas = [(f"d{i}", G.format(i).upper(), T0 + 10 * hour) for i in range(0, 45)] + [("d0", G.format(0), T0 + 20 * hour), ("dn", None, T0), ("dx", "odd one", T0), ("dy", "other", T0), ("dz", "odd one", T0 - hour)]
    emb = [("e1", "Sensors", "sensor10", T0), ("e2", "Sensors", "sensor11", T0), ("e3", "Sensors", "sensor9", T0), ("e4", "Sensors", "sensor09", T0), ("e5", "Sensors", "SENSOR9", T0), ("e6", "Rooms", "sensor9", T0), ("e7", None, "sensor9", T0), ("e8", "Sensors", "sensor010", T0), ("e9", "Sensors", "", T0), ("e10", "Sensors", "sensor12", T0)]
    d = spark.createDataFrame(deltas, "id string, base_value_id string, received_at timestamp_ntz")
    e = spark.createDataFrame(emb, "id string, table_name string, entity_id string, received_at timestamp_ntz")
    refs = references(d, "deltas", F.col("id"), F.lit("base"), F.col("base_value_id"), True, F.col("received_at")).unionByName(references(e, "emb", F.col("id"), F.col("table_name"), F.col("entity_id"), False, F.col("received_at")))
    states = check_references(refs, r)
    got = {x["record_id"]: x["ref_state"] for x in states.collect()}
    want = {f"d{i}": "missing" if i in (7, 8, 20) or i >= 40 else "late" if i > 10 else "ok" for i in range(45)}
    want |= {"dx": "ok", "dy": "missing", "dz": "late", "e1": "ok", "e2": "deleted", "e3": "ok", "e4": "missing", "e5": "missing", "e6": "missing", "e8": "ok", "e9": "ok", "e10": "missing"}
    assert got == want
    report = orphans_by_period(states).where("source_table = 'emb'").collect()
    assert {(x["ref_state"], x["n"]) for x in report} == {("missing", 4), ("deleted", 1)}
    assert check_references(refs.limit(0), r).isEmpty()
    assert {x["ref_state"] for x in check_references(refs, r.limit(0)).collect()} == {"missing"}


def test_key_parts_are_one_to_one(spark):
    keys = ["a1", "a01", "a001", "1", "01", "", "a", "a1b", "a12345678901234567890", G.format(1), G.format(1).upper(), "g" + "0" * 17, "n1", "0", "00", "10"]
    p = spark.createDataFrame([(k,) for k in keys], "k string").select("k", *key_parts(F.col("k"), True)).collect()
    assert len({(r[1], r[2]) for r in p}) == len(keys) - 1  # only the guid's two spellings are one


def test_runs_are_contiguous():
    start, stop = contiguous_runs(np.array([0, 1, 2, 5, 6, 9]))
    assert start.tolist() == [0, 5, 9] and stop.tolist() == [2, 6, 9]
    assert contiguous_runs(np.zeros(0, int))[0].tolist() == []


def test_batches_of_sorted_keys_end_anywhere():
    rows = [("s", "p", i, is_ref) for i in range(200) for is_ref in (False, True) if (i % 7 != 3 or is_ref) and (i % 5 != 1 or not is_ref)]
    t = pa.table({"space": [r[0] for r in rows], "prefix": [r[1] for r in rows], "n": [r[2] for r in rows], "is_ref": [r[3] for r in rows], "group_rows": [1] * len(rows), "first": pa.array([None if r[3] else r[2] for r in rows], pa.int64()), "gone": [False] * len(rows)})
    want = [(i, None if i % 7 == 3 else i) for i in range(200) if i % 5 != 1]
    for size in (1, 2, 3, 50, 1000):
        got = pa.Table.from_batches(list(references_module._scan(iter(t.to_batches(max_chunksize=size)))))
        assert list(zip(got["n"].to_pylist(), got["first"].to_pylist())) == want


def test_only_runs_of_parents_are_found(spark):
    base = spark.createDataFrame([(f"s{i}", T0) for i in range(50)], "id string, received_at timestamp_ntz")
    there = parents(base, F.lit("x"), F.col("id"), False, F.col("received_at"))
    refs = references(base, "t", F.col("id"), F.lit("x"), F.col("id"), False, F.col("received_at"))
    assert {r["ref_state"] for r in check_references(refs, there).collect()} == {"ok"}
    assert {r["ref_state"] for r in check_references(refs, there.limit(0)).collect()} == {"missing"}
