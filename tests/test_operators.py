"""The store's operators by example, with the cases that aren't in the test data."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gridloom.functions.stringify import stringify
from gridloom.operators import diff, integrity, render, search, series
from gridloom.options import EngineOptions, Interpolation, StepType, check_table_name
from gridloom.plans import sqltext, triggers
from gridloom.plans.program import Program, Scripts, Step, bind_result, run
from gridloom.sources.catalog import Catalog
from gridloom.spec import Child, Embed, EntitySpec, Parent

T0 = datetime(2025, 1, 1)
MIN = timedelta(minutes=1)


def samples(spark, points):
    rows = [("T", e, "p", T0 + m * MIN, v, i) for i, (e, m, v) in enumerate(points)]
    return spark.createDataFrame(rows, "TableName string, EntityId string, PropertyName string, Timestamp timestamp_ntz, Value string, no int")


def on_grid(spark, points, method, compat=False, end=60, step=10):
    got = series.interpolate(samples(spark, points), series.KEYS, T0, T0 + end * MIN, step * MIN, method, order="no", compat=compat)
    return {(r["EntityId"], int((r["Timestamp"] - T0) / MIN)): r["Value"] for r in got.collect()}


def walk(points, method, end=60, step=10):
    """One grid point at a time."""
    out = {}
    for e in {p[0] for p in points}:
        own = [(m, float(v)) for x, m, v in points if x == e and 0 <= m <= end]
        own.sort(key=lambda p: p[0])
        for g in range(0, end + 1, step) if own else ():
            before, after = [p for p in own if p[0] <= g], [p for p in own if p[0] >= g]
            p, n = before[-1] if before else None, after[0] if after else None
            if method == "Previous":
                v = p and p[1]
            elif method == "Next":
                v = n and n[1]
            elif p is None or n is None:
                v = (p or n)[1]
            elif method == "Nearest":
                v = p[1] if g - p[0] <= n[0] - g else n[1]
            else:
                v = p[1] if n[0] == p[0] else p[1] + (n[1] - p[1]) * (g - p[0]) / (n[0] - p[0])
            if v is not None:
                out[e, g] = f"{v:.2f}"
    return out


@pytest.mark.parametrize("method", ["Linear", "Nearest", "Previous", "Next"])
def test_interpolation_against_a_walk(spark, method):
    r = random.Random(3)
    points = [(f"e{e}", r.choice([-5, *range(0, 61), 65]), str(r.randint(0, 40) * 4)) for e in range(8) for _ in range(r.randint(0, 9))]
    points += [("tie", 20, "1"), ("tie", 20, "2"), ("far", 70, "5")]
    assert on_grid(spark, points, method) == walk(points, method)


def test_interpolation_cases(spark):
    assert on_grid(spark, [("a", 0, "1"), ("a", 10, "2"), ("a", 15, "9")], "None") == {("a", 0): "1", ("a", 10): "2"}
    assert ("a", 10) not in on_grid(spark, [("a", 10, "1"), ("a", 30, "3")], "Linear", compat=True)
    assert on_grid(spark, [("a", 10, "1"), ("a", 30, "3")], "Linear", compat=True)["a", 20] == "2.00"
    assert on_grid(spark, [("a", 0, "x"), ("a", 60, "3")], "Linear") == {("a", 60): "3.00"}
    assert on_grid(spark, [], "Linear") == {}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        on_grid(spark, [("a", 0, "x"), ("a", 60, "3")], "Nearest")
    with pytest.raises(ValueError):
        series.interpolate(samples(spark, []), series.KEYS, T0, T0, timedelta(0), "Linear")


def test_encoding_round_trip(spark):
    r = random.Random(4)
    rows = [("a", T0 + timedelta(milliseconds=r.randint(0, 5 * 10**9)), r.choice(["1", "2", None])) for _ in range(300)]
    rows += rows[:5] + [(None, T0, "1"), ("a", None, "1")]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, v string")
    enc = series.encode(df, ["k"], "t", "v")
    assert enc.where("Deltas[0] <> 0 OR size(Deltas) <> Version").isEmpty()
    back = sorted((r["k"] or "", r["Timestamp"], r["Value"]) for r in series.decode(enc, ["k"]).collect())
    assert back == sorted((k or "", t, v or "") for k, t, v in rows if t)
    some = series.decode(enc, ["k"], F.lit(T0 + timedelta(days=1)), F.lit(T0 + timedelta(days=2)))
    assert some.count() == sum(1 for _, t, _ in rows if t and T0 + timedelta(days=1) <= t <= T0 + timedelta(days=2))


def test_varints():
    for d in ([], [0], [0, 1, -1, 127, 128, -128, 300, 2**31 - 1, 2**40, -(2**40)]):
        assert series.varint_decode(series.varint_encode(d)) == d
    assert series.varint_encode([300, -1]) == bytes([0xAC, 0x02, 0, 1, 1])
    for bad in (b"\x80", b"\x01"):
        with pytest.raises(ValueError):
            series.varint_decode(bad)


def test_series_expressions():
    got = series.parse_expression("T, e ,p,2025-01-01,2025-01-02T03:00:00, 1.02:03:04.5 ,linear")
    assert got == ("T", "e", "p", T0, datetime(2025, 1, 2, 3), timedelta(days=1, hours=2, minutes=3, seconds=4.5), Interpolation.LINEAR)
    assert series.parse_expression("T,e,p,2025-01-01,2025-01-02")[5:] == (timedelta(seconds=1), Interpolation.NONE)
    for text, part in (("a,b,c,d", "5 to 7"), ("T,e,p,x,2025-01-01", "start date"), ("T,e,p,2025-01-01,x", "end date"), ("T,e,p,2025-01-01,2025-01-02,60", "interval"), ("T,e,p,2025-01-01,2025-01-02,00:01,Cubic", "interpolation method")):
        with pytest.raises(ValueError, match=part):
            series.parse_expression(text)


def test_diffs(spark):
    schema = "Id int, a string, b double, c array<int>"
    old = spark.createDataFrame([(1, 'x"°', 1.0, [1]), (2, None, None, None), (3, "gone", 3.0, None), (5, "same", 1.0, None)], schema)
    new = spark.createDataFrame([(1, "y", 1.0, [1, 2]), (2, "set", None, None), (4, None, 4.5, None), (5, "same", 1.0, None)], schema)
    pairs = diff.paired(old, new, "Id")
    log = diff.change_log(pairs, "T", ["a", "b", "c"], F.lit(T0).cast("timestamp_ntz"), "me").collect()
    assert {(r["EntityId"], r["PropertyName"], r["ChangeType"], r["OriginalValue"], r["NewValue"]) for r in log} == {
        ("1", "a", "Update", '"x\\"°"', '"y"'), ("1", "c", "Update", "[1]", "[1,2]"), ("2", "a", "Update", None, '"set"'),
        ("3", "a", "Delete", '"gone"', None), ("3", "b", "Delete", "3.0", None), ("4", "b", "Insert", None, "4.5"),
    }
    events = {r["EntityId"]: (r["Operation"], r["Changed"]) for r in diff.change_events(pairs, "T", ["Id", "a", "b"], F.lit(T0).cast("timestamp_ntz")).collect()}
    assert events["1"] == ("Update", {"a": ('x"°', "y")}) and events["3"] == ("Delete", {}) and events["4"] == ("Insert", {})
    assert "5" not in events


def test_chains(spark):
    rows = [("T", "e", "p", T0 + i * MIN, v) for i, v in enumerate(["a", None, "a", "b"])]
    df = spark.createDataFrame(rows, "TableName string, EntityId string, PropertyName string, Timestamp timestamp_ntz, Value string")
    log = integrity.chain(df, integrity.CHAIN, "Timestamp", "Value").withColumn("Id", F.lit("x"))
    got = log.orderBy("Timestamp").collect()
    assert got[0]["PreviousHash"] == "" and [g["PreviousHash"] for g in got[1:]] == [g["Hash"] for g in got[:-1]]
    assert got[1]["Hash"] == "47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU="  # of the empty text
    assert integrity.broken_links(log).isEmpty()
    cut = log.where(F.col("Timestamp") != F.lit(T0 + MIN))
    assert integrity.broken_links(cut).count() == 1
    headless = log.where(F.col("Timestamp") > F.lit(T0))
    assert integrity.broken_links(headless).isEmpty() and integrity.broken_links(headless, strict_anchor=True).count() == 1
    now = spark.createDataFrame([("T", "e", "p", "c"), ("T", "new", "p", "z")], "TableName string, EntityId string, PropertyName string, Value string")
    with pytest.raises(integrity.DataIntegrityError):
        integrity.raise_first(integrity.violations(now, log))
    more = integrity.append(log, now, F.lit(T0 + timedelta(days=1)).cast("timestamp_ntz")).collect()
    assert {r["EntityId"]: r["PreviousHash"] for r in more} == {"e": got[3]["Hash"], "new": ""}


def test_templates(spark):
    rooms = spark.createDataFrame([(1, "hall", 7), (2, None, 8)], "Id int, Name string, HouseId int")
    sensors = spark.createDataFrame([("s1", 1, 20, "x"), ("s2", 1, 25, ""), ("s3", 1, None, "a")], "Id string, RoomId int, Temperature int, Note string")
    houses = spark.createDataFrame([(7, "villa")], "Id int, Title string")
    embeds = (Embed("{0} in {house.title}", 5, "HouseId"), Embed("Room {name}: {Sensors.MAX(Temperature)}/{sensors.min(temperature)}/{Sensors.COUNT(x)}{Other.MAX(y)}", 1, "Name"), Embed("end", 0))
    spec = EntitySpec("Rooms", rooms.schema, embeds=embeds, children=(Child("Sensors", "Sensors", "RoomId"),), parents=(Parent("House", "Houses", "HouseId"),))
    tables = {"Sensors": sensors, "Houses": houses}
    got = {r["EntityId"]: r["Text"] for r in render.entity_texts(rooms, spec, tables).collect()}
    assert got == {"1": "Room hall: 25/20/3  in villa end", "2": "Room : //0  in  end"}
    empty = EntitySpec("Rooms", rooms.schema, embeds=(Embed("{nothing}", 0, "Name"),))
    assert {r["Text"] for r in render.entity_texts(rooms, empty).collect()} == {None}
    r = render.Renderer(spec, tables)
    cols = [r.expression("{$.Name}").alias("a"), r.expression("{$.Sensors[s @.Note]}").alias("b"), r.expression("plain").alias("c")]
    assert [tuple(x) for x in r.joined(rooms).orderBy("Id").select(*cols).collect()] == [("hall", "a x", "plain"), ("", "", "plain")]
    with pytest.raises(ValueError):
        r.expression("{$.Nothing}")
    with pytest.raises(ValueError):
        Embed(None)


def test_vectors(spark):
    rows = [("a", [0.0, 0.0]), ("b", [3.0, 4.0]), ("c", [3.0, 4.0]), ("short", [1.0]), ("none", None)]
    v = spark.createDataFrame(rows, "EntityId string, Embedding array<float>")
    got = [(r["EntityId"], r["distance"]) for r in search.nearest_l2(v, [3.0, 4.0], 3).collect()]
    assert got == [("b", 0.0), ("c", 0.0), ("a", 5.0)]
    assert search.nearest_l2(v, [0.0, 0.0], 0).isEmpty() and search.nearest_l2(v.limit(0), [0.0, 0.0], 2).isEmpty()
    new = spark.createDataFrame([("b", [1.0, 1.0]), ("d", [2.0, 2.0])], "EntityId string, Embedding array<float>")
    after = search.remove_vectors(search.put_vectors(v, new, dimension=2), new.where("EntityId = 'd'").unionByName(new.limit(0)))
    assert {r["EntityId"]: r["Embedding"] for r in after.collect()}["b"] == [1.0, 1.0] and after.count() == 5
    with pytest.raises(Exception, match="must have 3 entries"):
        search.put_vectors(v, new, dimension=3).collect()


def test_embedding_of_texts(spark):
    p = search.HashingProvider(64)
    long = " ".join(f"w{i}" for i in range(600))
    one = search.embed_text(long, p)
    parts = [search.mean_pool(p.token_vectors(t), np.ones(len(t))) for t in (long.split(" ")[:256], long.split(" ")[256:512], long.split(" ")[512:])]
    assert np.allclose(one, search.normalize(np.mean(parts, axis=0)), atol=1e-6) and abs(np.linalg.norm(one) - 1) < 1e-6
    assert (search.normalize(np.zeros(3)) == 0).all() and (search.mean_pool(np.ones((2, 3)), np.zeros(2)) == 0).all()
    df = spark.createDataFrame([("1", "some text"), ("2", None), ("3", "")], "EntityId string, Text string")
    got = {r["EntityId"]: r["Embedding"] for r in search.embed(df, provider=p).collect()}
    assert got["2"] is None and got["3"] is None and len(got["1"]) == 64


def test_sql_texts(spark):
    spark.createDataFrame([(1, "x;y", 2.5)], "a int, setting string, ExecutiveId double").createOrReplaceTempView("things")
    ok = ["SELECT * FROM things", "SELECT setting, ExecutiveId FROM things WHERE setting = 'x;y'", "WITH t AS (SELECT 1 AS a) SELECT a FROM t", "SELECT a FROM things UNION SELECT 2", "SELECT count(*) FROM things HAVING count(*) > 0", "SELECT 'INSERT' AS a"]
    assert [sqltext.refuse(spark, q) for q in ok] == [None] * len(ok)
    for q in ("INSERT INTO things VALUES (1)", "DROP TABLE things", "SET a=b", "DELETE FROM things", "CREATE VIEW v AS SELECT 1", "SELECT reflect('java.lang.System', 'exit')", "SHOW TABLES", "CACHE TABLE things"):
        assert sqltext.refuse(spark, q) == sqltext.ONLY_SELECT, q
    assert sqltext.refuse(spark, "SELECT 1; SELECT 2") == sqltext.NO_MULTI
    assert sqltext.refuse(spark, "SELECT (1").startswith("Invalid SQL query")
    assert sqltext.refuse(spark, "SELECT setting FROM things WHERE ExecutiveId = 1", compat=True) == sqltext.NO_MULTI
    assert sqltext.query(spark, "SELECT a FROM things WHERE a = @p0 AND setting = @p1", [1, "x;y"]).first()[0] == 1
    with pytest.raises(TypeError, match="Unsupported parameter type"):
        sqltext.query(spark, "SELECT :x", {"x": object()})
    assert sqltext.bind("SELECT {a} + {b}", {"a": 1}) == ("SELECT :p0 + :p1", {"p0": 1, "p1": ""})
    tables, pairs = sqltext.tables_and_columns(spark, "SELECT avg(s.a) AS m FROM things s JOIN other o ON s.k = o.k WHERE o.b IN (SELECT z FROM third)")
    assert tables == {"things", "other", "third"} and ("things", "b") not in pairs
    assert {("things", "a"), ("things", "k"), ("other", "k"), ("other", "b"), ("third", "z")} <= set(pairs)
    assert sqltext.tables_and_aggregates("select avg(Temperature), count(*) from Sensors join Rooms on true") == [("Sensors", "Temperature"), ("Rooms", "Temperature")]


def test_interpreter(spark):
    none = lambda: None
    always = [Step(StepType.VARIABLE, "0", "n"), Step(StepType.SCRIPT, "{n} + 1", "n"), Step(StepType.CONDITION, "true", "2", 4)]
    context = {}
    assert run(spark, always, none, context) == "5" and context["n"] == 5  # the loop's jumps are used up: the last result stands
    assert run(spark, [Step(StepType.VARIABLE, "1", "x"), Step(StepType.CONDITION, "{x} > 1", "1")], none) == "False"
    with pytest.raises(ValueError, match="must return a boolean"):
        run(spark, [Step(StepType.VARIABLE, "1", "x"), Step(StepType.CONDITION, "1", "1")], none)
    with pytest.raises(ValueError, match="Only SELECT|Invalid|not allowed"):
        run(spark, [Step(StepType.SCRIPT, "1; DROP TABLE x", "y")], none)
    with pytest.raises(ValueError, match="Missing parameter"):
        run(spark, [Step(StepType.SERIES, "T,{who},p,2025-01-01,2025-01-02", "y")], none)
    assert run(spark, [Step(StepType.SQL, "SELECT 1 AS a, 2 AS b", "b")], none) == "2"
    assert run(spark, [Step(StepType.SQL, "SELECT 1 AS a, 2 AS b", "B")], none) == "1"
    assert run(spark, [Step(StepType.SQL, "SELECT 1 AS a WHERE false", "a")], none) == ""
    s = Scripts()
    s.register("put", lambda c: c.update(z=7))
    assert run(spark, [Step(StepType.SCRIPT, "py:put", ""), Step(StepType.SCRIPT, "{z} * 2", "y")], none, scripts=s) == "14"
    c = {"i": 2}
    bind_result(c, "xs[{i}]", "v")
    bind_result(c, "xs[0]", "u")
    assert c["xs"] == ["u", None, "v"]
    got = run(spark, [Step(StepType.SERIES, "T,a,p,2025-01-01,2025-01-02,00:10:00,Linear", "y")], lambda: samples(spark, [("a", 0, "1"), ("a", 30, "4")]))
    assert got == "4.00"


def test_texts_of_values():
    assert [stringify(v) for v in (None, True, 25.0, 2.5, 7, "x", 1e20, float("nan"), [1, None])] == ["", "True", "25", "2.5", "7", "x", "1E+20", "NaN", "[1, null]"]


def test_triggers(spark):
    p = Program("p", [Step(StepType.SQL, "SELECT COUNT(*) AS n FROM Sensors s WHERE s.Temperature > 1", "n"), Step(StepType.SERIES, "Rooms,x,Size,2025-01-01,2025-01-02", "y")], -1)
    found = triggers.triggers_of(spark, p)
    assert ("Sensors", "Temperature") in found and ("Rooms", "Size") in found
    assert triggers.triggers_of(spark, Program("p", p.steps[:1], -1), compat=True) == []
    events = spark.createDataFrame([("e1", "sensors", "1", "Update", {"Temperature": ("1", "2")}), ("e2", "Sensors", "1", "Update", {"temperature": ("1", "2")}), ("e3", "SENSORS", "1", "Delete", {}), ("e4", "Other", "1", "Insert", {})], "EventId string, TableName string, EntityId string, Operation string, Changed map<string, struct<old: string, new: string>>")
    t = spark.createDataFrame([("p", "Sensors", "Temperature"), ("any", "Sensors", None)], triggers.TRIGGERS)
    assert {tuple(r) for r in triggers.matches(events, t).collect()} == {("p", "e1"), ("p", "e3"), ("any", "e1"), ("any", "e2"), ("any", "e3")}
    at = spark.createDataFrame([("p", T0 + timedelta(seconds=s)) for s in (0, 4, 9, 10, 19, 25, 25)], "AnalyticsId string, Timestamp timestamp_ntz")
    assert sorted(int((r["Timestamp"] - T0).total_seconds()) for r in triggers.throttled(at).collect()) == [0, 10, 25]


def test_declarations(spark):
    for bad in ("", "1a", "a-b", "a b", None, "a;b"):
        with pytest.raises(ValueError):
            check_table_name(bad)
    schema = StructType([StructField("id", StringType()), StructField("x", StringType())])
    assert EntitySpec("T", schema).key == "id"
    for wrong in (dict(key="no"), dict(tracked=("no",)), dict(table="a b")):
        with pytest.raises(ValueError):
            EntitySpec(**{"table": "T", "schema": schema} | wrong)
    c = Catalog()
    first = EntitySpec("T", schema)
    assert c.register(first) is first and c.register(EntitySpec("t", schema, tracked=("x",))) is first
    assert c.tables() == ["T"] and c.spec("t") is first
    assert EngineOptions().with_all().integrity and not EngineOptions().integrity
    assert StepType.parse("timeseries") is StepType.SERIES and StepType.parse(0) is StepType.SQL and StepType.parse("x") is None


def test_streams(spark, tmp_path):
    from gridloom.schemas import EVENTS
    from gridloom.streaming import feed

    folder, seen = str(tmp_path / "feed"), []
    spark.createDataFrame([("e1", "T", "1", "Insert", {}, T0)], EVENTS).write.parquet(folder)
    stream = lambda: feed.feed_batches(feed.read_feed(spark, folder, 1), lambda b, n: seen.extend(r["EventId"] for r in b.collect()), str(tmp_path / "state")).awaitTermination()
    stream()
    spark.createDataFrame([("e2", "T", "1", "Delete", {}, T0)], EVENTS).write.mode("append").parquet(folder)
    stream()
    assert seen == ["e1", "e2"]  # what was read is not read again
    readings = spark.createDataFrame([("a", T0 + i * MIN, float(i)) for i in (0, 1, 7, 8, 30)], "k string, ts timestamp_ntz, v double")
    got = sorted((r["window_start"], r["n"], r["total"]) for r in feed.windowed(readings, "ts", "10 minutes", "1 hour", ["k"], "v").collect())
    assert got == [(T0, 4, 16.0), (T0 + 30 * MIN, 1, 30.0)]
    assert sorted(r["n"] for r in feed.sessions(readings, "ts", "5 minutes", "1 hour", ["k"]).collect()) == [1, 2, 2]
