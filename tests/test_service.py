"""Entities and programs from end to end, on a store of their own."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F
from gridloom.schemas import schema_of

from gridloom.operators.integrity import DataIntegrityError
from gridloom.options import EngineOptions, StepType
from gridloom.plans.program import Program, Step
from gridloom.plans.service import AnalyticsService, Engine
from gridloom.plans.sqltext import tables_and_columns
from gridloom.sources.store import ConcurrentCommit
from gridloom.spec import Embed, EntitySpec

SENSORS = EntitySpec(
    "Sensors",
    schema_of("Id string, Temperature int, Description string"),
    series=("Temperature",),
    tracked=("Description",),
    integrity=("Description",),
    embeds=(Embed("Sensor {Description}", 0, "Description"),),
)
START = dt.datetime(2025, 1, 1)


def row(i, t):
    return {"Id": f"sensor{i}", "Temperature": t, "Description": f"Temperature is {t}°C"}


class Clock:
    """A minute passes with each look."""

    def __init__(self):
        self.ticks = itertools.count()

    def __call__(self):
        return START + dt.timedelta(minutes=next(self.ticks))


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, EngineOptions(root=str(tmp_path)).with_all(), clock=Clock())


def test_rows_and_what_follows(engine):
    s = engine.entity(SENSORS)
    assert s.insert([row(1, 20), row(2, 22)]) == 2
    with pytest.raises(ValueError):
        s.insert([row(1, 20)])
    log = engine.system("sysChangeLog").orderBy("EntityId").collect()
    assert [(r["ChangeType"], r["OriginalValue"], r["NewValue"]) for r in log] == [("Insert", None, '"Temperature is 20°C"'), ("Insert", None, '"Temperature is 22°C"')]
    assert {r["Value"] for r in engine.system("sysTimeseriesBaseValues").collect()} == {"20", "22"}
    assert all(r["Hash"] and r["PreviousHash"] == "" for r in engine.system("sysIntegrityLog").collect())
    assert all(len(r["Embedding"]) == 384 for r in engine.system("sysEmbeddings").collect())

    assert s.update([row(1, 25)]) == 1
    assert s.update([row(999, 30)]) == 0
    assert s.upsert([row(1, 26), row(3, 30), row(3, 31)]) == 2
    assert s.find_by_id("sensor3")["Temperature"] == 31
    kinds = [r["ChangeType"] for r in engine.system("sysChangeLog").collect()]
    assert sorted(kinds) == ["Insert"] * 3 + ["Update"] * 2
    chain = engine.system("sysIntegrityLog").where("EntityId = 'sensor1'").orderBy("Timestamp").collect()
    assert [c["PreviousHash"] for c in chain[1:]] == [c["Hash"] for c in chain[:-1]]
    assert s.verify().isEmpty()

    wide = (START - dt.timedelta(days=1), START + dt.timedelta(days=1))
    assert [r["Value"] for r in s.series("sensor1", "Temperature", *wide).collect()] == ["20", "25", "26"]
    flat = s.interpolated("sensor2", "Temperature", *wide, dt.timedelta(minutes=30), "Linear").collect()
    assert {r["Value"] for r in flat} == {"22.00"} and len(flat) == 97

    assert s.find_by_id("sensor999") is None
    assert [r["Id"] for r in s.find("Temperature > 21", 1, 10).collect()] == ["sensor2", "sensor3"]
    assert (s.count(), s.count(F.col("Temperature") > 25)) == (3, 2)
    assert [r["Id"] for r in s.query("SELECT * FROM Sensors WHERE Id = @p0", ["sensor2"]).collect()] == ["sensor2"]
    with pytest.raises(ValueError):
        s.query("DELETE FROM Sensors")

    assert [r["Id"] for r in s.search("Sensor Temperature is 22°C", 1).collect()] == ["sensor2"]
    assert s.search("", 5).isEmpty() and s.search("x", 0).isEmpty()

    assert s.delete(["sensor2"]) == 1 and s.delete(["sensor999"]) == 0
    last = engine.system("sysChangeLog").where("ChangeType = 'Delete'").first()
    assert last["NewValue"] is None and last["OriginalValue"] == '"Temperature is 22°C"'
    assert s.delete_all() == 2
    assert s.count() == 0 and engine.system("sysEmbeddings").isEmpty() and engine.system("sysTimeseriesBaseValues").isEmpty()
    assert engine.system("sysChangeLog").where("ChangeType = 'Delete'").count() == 3


def test_tampering_is_noticed(engine):
    s = engine.entity(SENSORS)
    s.insert([row(1, 20)])
    engine.store.change("Sensors", lambda d: d.withColumn("Description", F.lit("forged")))
    with pytest.raises(DataIntegrityError) as e:
        s.find_by_id("sensor1")
    assert (e.value.table, e.value.entity, e.value.column) == ("Sensors", "sensor1", "Description")
    assert s.find_all(verify=False).count() == 1
    assert [r["Kind"] for r in s.verify().collect()] == ["value"]


def test_conflicting_commits(engine):
    engine.entity(SENSORS).insert([row(1, 20)])
    store = engine.store
    before, seen = store.version(), []

    def work(t):
        seen.append(t.rows("Sensors").count())
        if len(seen) == 1:  # another writer
            store.append("Sensors", engine.spark.createDataFrame([("other", 1, None)], SENSORS.schema))
        t.replace("Sensors", t.rows("Sensors"))

    store.transact(work)
    assert seen == [1, 2] and store.read("Sensors").count() == 2
    assert store.read("Sensors", before).count() == 1

    def blind(t):  # relies on nothing, so it follows the other's commit as it is
        seen.append(0)
        t.append("Sensors", store.read("Sensors").limit(1))
        store.append("Sensors", store.read("Sensors").limit(1))

    store.transact(blind)
    assert seen == [1, 2, 0] and store.read("Sensors").count() == 4
    with pytest.raises(ConcurrentCommit):
        store.transact(lambda t: (t.replace("Sensors", t.rows("Sensors")), store.append("Sensors", store.read("Sensors").limit(1))))
    assert store.vacuum(1) > 0 and store.read("Sensors").count() == 8


def test_two_upserts_of_one_new_key(engine):
    s = engine.entity(SENSORS)
    clock = engine.clock

    def other_writer():
        engine.clock = clock
        s.upsert([row(7, 1)])
        return clock()

    engine.clock = other_writer
    s.upsert([row(7, 2)])
    assert [r["Temperature"] for r in s.find_all().collect()] == [2]
    assert [r["ChangeType"] for r in engine.system("sysChangeLog").orderBy("ChangedAt").collect()] == ["Insert", "Update"]


def test_only_touched_files_are_written_anew(engine):
    s = engine.entity(SENSORS)
    s.insert([row(1, 20)])
    s.insert([row(2, 20)])
    first = engine.store._tables_at(engine.store.version())["Sensors"]["parts"]
    s.update([row(2, 21)])
    assert first[0] in engine.store._tables_at(engine.store.version())["Sensors"]["parts"]
    assert {r["Id"]: r["Temperature"] for r in s.find_all().collect()} == {"sensor1": 20, "sensor2": 21}


def test_queries_read_registered_tables_only(engine, tmp_path):
    s = engine.entity(SENSORS)
    s.insert([row(1, 20)])
    assert engine.query("WITH w AS (SELECT Id FROM sensors) SELECT count(*) AS n FROM w").first()[0] == 1
    engine.spark.range(3).write.parquet(str(tmp_path / "other.parquet"))
    for sql in (f"SELECT * FROM parquet.`{tmp_path}/other.parquet`", "SELECT * FROM sysChangeLog", f"SELECT Id FROM Sensors WHERE 1 IN (SELECT id FROM parquet.`{tmp_path}/other.parquet`)"):
        with pytest.raises(ValueError, match="Invalid table reference"):
            engine.query(sql)
    assert AnalyticsService(engine).verify(Program("p", [Step(StepType.SQL, "WITH w AS (SELECT Id FROM Sensors) SELECT count(*) AS n FROM w", "n")])) == (True, [])


def test_tables_and_columns_of_queries(spark):
    wide = "SELECT " + ", ".join(f"c{i}" for i in range(60)) + " FROM t"
    assert tables_and_columns(spark, wide)[1] == sorted(("t", f"c{i}") for i in range(60))
    sql = "WITH w AS (SELECT a.x, sum(b.y) AS s FROM one a JOIN two b ON a.k = b.k GROUP BY a.x) SELECT x, s FROM w WHERE s > (SELECT max(z) FROM three)"
    known = {"one": ["k", "x"], "two": ["k", "y"], "three": ["z"]}
    tables, pairs = tables_and_columns(spark, sql, known)
    assert tables == {"one", "two", "three"}
    assert set(pairs) >= {("one", "x"), ("one", "k"), ("two", "k"), ("two", "y"), ("three", "z")} and ("two", "x") not in pairs and ("one", "y") not in pairs
    assert tables_and_columns(spark, "SELECT count(*) AS n FROM t")[1] == [("t", None)]


def test_programs(engine):
    s = engine.entity(SENSORS)
    s.insert([row(1, 20), row(2, 30)])
    a = AnalyticsService(engine)
    avg = Program("avg", [Step(StepType.SQL, "SELECT AVG(Temperature) AS AvgTemp FROM Sensors", "avgTemp")])
    i = a.add(avg)
    assert a.execute(i) == "25"
    with pytest.raises(ValueError, match="exists"):
        a.add(Program("avg", avg.steps))
    assert a.execute(a.add(Program("six", [Step(StepType.SCRIPT, "42 * 2", "result")]))) == "84"
    loop = [Step(StepType.VARIABLE, "0", "n"), Step(StepType.SCRIPT, "{n} + 1", "n"), Step(StepType.CONDITION, "{n} < 3", "2", 5), Step(StepType.SCRIPT, "{n}", "out")]
    assert a.execute(a.add(Program("loop", loop))) == "3"
    series = [Step(StepType.SERIES, "Sensors,sensor1,Temperature,2024-12-31,2025-01-02", "x")]
    assert a.execute(a.add(Program("series", series))) == "20"
    listed = [Step(StepType.VARIABLE, "5", "xs[2]"), Step(StepType.SCRIPT, "{xs[2]} * 2", "twice")]
    assert a.execute(a.add(Program("list", listed))) == "10"
    rows = [Step(StepType.SQL, "SELECT Temperature AS t FROM Sensors WHERE Temperature > {least}", "hot"), Step(StepType.SQL, "SELECT count(*) AS n FROM hot", "n")]
    assert a.execute(a.add(Program("rows", [Step(StepType.VARIABLE, "25", "least"), *rows]))) == "1"

    back = Program.from_json(a.export_json(i))
    assert back.name == "avg" and back.steps[0].kind is StepType.SQL and back.steps[0].output == "avgTemp"
    a.delete(i)
    with pytest.raises(KeyError):
        a.execute(i)
    assert a.import_json(back.to_json()) != i


def test_errors_of_programs(engine):
    engine.entity(SENSORS)
    a = AnalyticsService(engine)

    def errors(*steps):
        return a.verify(Program("p", list(steps)))[1]

    assert errors() == ["Analytics must have at least one step."]
    bad = errors(Step(StepType.SQL, "INSERT INTO Sensors VALUES ('x', 1, 'y')", "r"))
    assert bad[0].startswith("Step 1 (SqlQuery): Only SELECT queries are allowed.")
    with pytest.raises(ValueError, match=r"^Validation Failed: Step 1 \(SqlQuery\): Only SELECT queries are allowed\."):
        a.add(Program("p", [Step(StepType.SQL, "INSERT INTO Sensors VALUES ('x', 1, 'y')", "r")]))
    assert "Invalid GoTo step number 2. Must be between 1 and 1, not current step" in errors(Step(StepType.CONDITION, "true", "2"))[0]
    assert "Invalid table reference Nowhere" in errors(Step(StepType.SQL, "SELECT 1 AS x FROM Nowhere", "r"))[0]
    assert "Property Humidity does not exist on table Sensors" in errors(Step(StepType.SQL, "SELECT AVG(Humidity) AS x FROM Sensors", "r"))[0]
    assert "5 to 7 components" in errors(Step(StepType.SERIES, "Sensors,a,b", "r"))[0]
    assert "Unknown variable y" in errors(Step(StepType.VARIABLE, "1", "x"), Step(StepType.SCRIPT, "{y} + 1", "z"))[0]
    assert "MaxLoop must be positive" in errors(Step(StepType.VARIABLE, "1", "x"), Step(StepType.CONDITION, "true", "1", 0))[0]
    assert "must return a boolean" in errors(Step(StepType.VARIABLE, "1", "x"), Step(StepType.CONDITION, "1 + 1", "1"))[0]
    assert "Last CSharp step must have a ResultVariable" in errors(Step(StepType.SCRIPT, "1", ""))[0]
    assert errors(Step("Nonsense", "x", "y"))[0].endswith("Invalid step type Nonsense.")


def test_runs_on_changes_and_intervals(engine):
    s = engine.entity(SENSORS)
    s.insert([row(1, 40)])
    a = AnalyticsService(engine)
    steps = [Step(StepType.SQL, "SELECT AVG(Temperature) AS t FROM Sensors", "t")]
    on_change = a.add(Program("on change", steps, interval=-1))
    every = a.add(Program("every", steps, interval=60))
    never = a.add(Program("never", steps, interval=0))
    s.update([row(1, 50)])
    assert a.value(on_change) == "50"
    logged = engine.system("sysChangeLog").where("TableName = 'sysAnalytics'").collect()
    assert [(r["OriginalValue"], r["NewValue"]) for r in logged] == [("0", "50")]
    assert a.tick() == [every] and a.value(every) == "50" and a.value(never) == "0"
    s.update([{"Id": "sensor1", "Temperature": 50, "Description": "only this"}])
    assert a.value(on_change) == "50"
    assert a.tables() == ["Sensors"]
