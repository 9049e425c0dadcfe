"""The store's operators as queries over the test tables.

Readings are the events of a user; two states of a table are the last event per user and kind of two successive weeks.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import codecs
from gridloom.functions.text import fold_guid
from gridloom.operators import diff, integrity, render, search, series
from gridloom.options import EngineOptions, Interpolation, StepType
from gridloom.plans import program as programs
from gridloom.plans import sqltext, triggers, validate
from gridloom.plans.program import Program, Scripts, Step
from gridloom.plans.service import AnalyticsService, Engine, EntityService
from gridloom.runtime import materialize, shared_folder, table
from gridloom.sources.catalog import Catalog
from gridloom.spec import Child, Embed, EntitySpec, Parent
from gridloom.streaming import feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

START, END, STEP = datetime(2024, 1, 1), datetime(2024, 1, 31), timedelta(hours=6)
AT = "2024-01-22 00:00:00"


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _views(spark: SparkSession, folder: str, *names: str) -> None:
    for n in names:
        table(spark, folder, n).createOrReplaceTempView(n)


def _scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/gridloom-{label}-{uuid.uuid4().hex}"


def _engine(spark: SparkSession, clock: Callable[[], datetime] | None = None) -> Engine:
    """An engine on a store of its own, with all features; by default a minute passes with each look at the clock."""
    ticks = itertools.count()
    return Engine(spark, EngineOptions(root=_scratch(spark, "store")).with_all(), clock=clock or (lambda: datetime(2024, 1, 22) + timedelta(minutes=next(ticks))))


def _service(spark: SparkSession, folder: str, name: str) -> EntityService:
    """The service of a test table, which stays where it is."""
    t = table(spark, folder, name)
    return _engine(spark).entity(EntitySpec(name, t.schema, t.columns[0]), lambda: table(spark, folder, name))


# entities: reading


@_query
def crud_find_predicate(spark: SparkSession, folder: str) -> DataFrame:
    return _service(spark, folder, "customer").find((F.col("c_acctbal") > 5000) & (F.col("c_mktsegment") == "BUILDING"))


@_query
def crud_find_page(spark: SparkSession, folder: str) -> DataFrame:
    return _service(spark, folder, "orders").find("o_totalprice > 1000", skip=100, limit=50)


@_query
def crud_find_by_id(spark: SparkSession, folder: str) -> DataFrame:
    s = _service(spark, folder, "customer")
    return spark.createDataFrame([r for r in [s.find_by_id(42)] if r], s.spec.schema)


@_query
def crud_find_all(spark: SparkSession, folder: str) -> DataFrame:
    return _service(spark, folder, "supplier").find_all()


@_query
def crud_count(spark: SparkSession, folder: str) -> DataFrame:
    s = _service(spark, folder, "orders")
    return spark.createDataFrame([(s.count(), s.count("o_totalprice > 100000"))], "n bigint, n_large bigint")


@_query
def crud_in_list(spark: SparkSession, folder: str) -> DataFrame:
    regions = [r[0] for r in _service(spark, folder, "region").find(F.col("r_name").isin("ASIA", "EUROPE")).select("r_regionkey").collect()]
    nations = [r[0] for r in _service(spark, folder, "nation").find(F.col("n_regionkey").isin(regions)).select("n_nationkey").collect()]
    return _service(spark, folder, "customer").find(F.col("c_nationkey").isin(nations)).select("c_custkey", "c_nationkey")


@_query
def crud_query_entities(spark: SparkSession, folder: str) -> DataFrame:
    return _service(spark, folder, "supplier").query("WITH rich AS (SELECT * FROM supplier WHERE s_acctbal > @p0) SELECT * FROM rich", [5000.0])


@_query
def crud_dynamic_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of unknown columns as JSON texts."""
    n = _service(spark, folder, "nation").find_all()
    return n.select("n_nationkey", F.to_json(F.struct("n_name", "n_regionkey")).alias("data"), F.lit(1.0).alias("score"))


@_query
def catalog_tables(spark: SparkSession, folder: str) -> DataFrame:
    c = Catalog()
    for name in ("customer", "orders", "nation", "sysanalytics"):
        c.register(EntitySpec(name, table(spark, folder, name).schema, table(spark, folder, name).columns[0]), lambda n=name: table(spark, folder, n))
    return spark.createDataFrame([(t,) for t in c.tables()], "table_name string")


@_query
def sql_params(spark: SparkSession, folder: str) -> DataFrame:
    _views(spark, folder, "customer")
    return sqltext.query(spark, "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > @p0 AND c_mktsegment = @p1", [9000.0, "MACHINERY"])


@_query
def sql_join_like(spark: SparkSession, folder: str) -> DataFrame:
    _views(spark, folder, "customer", "nation")
    text, args = sqltext.bind("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name LIKE {like}", {"like": "%1%"})
    return sqltext.query(spark, text, args)


@_query
def sql_agg5(spark: SparkSession, folder: str) -> DataFrame:
    _views(spark, folder, "orders")
    return sqltext.query(
        spark,
        """SELECT o_orderpriority, round(avg(o_totalprice), 4) AS avg_price, round(sum(o_totalprice), 2) AS sum_price,
            count(*) AS n, min(o_totalprice) AS min_price, max(o_totalprice) AS max_price FROM orders GROUP BY o_orderpriority""",
    )


@_query
def sql_surface(spark: SparkSession, folder: str) -> DataFrame:
    """What reaches the database as text: subquery, rollup, window, set operation, distinct aggregates."""
    _views(spark, folder, "orders", "lineitem", "customer")
    return sqltext.query(
        spark,
        """SELECT 'rollup' AS part, coalesce(o_orderstatus, '') AS k1, coalesce(o_orderpriority, '') AS k2, count(DISTINCT o_custkey) AS n
        FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
        UNION ALL
        SELECT 'window', o_orderstatus, cast(r AS string), count(*) FROM
            (SELECT o_orderstatus, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) x GROUP BY 1, 2, 3
        UNION ALL
        SELECT 'subquery', c_mktsegment, '', count(*) FROM customer
        WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)) GROUP BY c_mktsegment
        UNION ALL
        SELECT 'except', '', '', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) y""",
    )


# series


def _observations(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(F.lit("events").alias("TableName"), F.col("user_id").cast("string").alias("EntityId"), F.lit("value").alias("PropertyName"), F.col("ts").alias("Timestamp"), F.col("value").cast("string").alias("Value"), "event_id")


@_query
def ts_encode(spark: SparkSession, folder: str) -> DataFrame:
    rows = series.encode(_observations(spark, folder), series.KEYS, "Timestamp", "Value")
    sums = F.expr("aggregate(Deltas, struct(0L AS at, 0L AS total), (a, d) -> struct(a.at + d AS at, a.total + a.at + d AS total), a -> a.total)")
    whole = rows.groupBy("EntityId", F.col("Value").cast("double").alias("value"), "BaseTimestamp").agg(F.sum("Version").alias("n_obs"), F.sum(sums + F.col("StartMs") * F.col("Version")).alias("sum_offsets"), F.max("LastTimestamp").alias("last_offset"))
    return whole.select(F.col("EntityId").alias("entity_id"), "value", F.col("BaseTimestamp").alias("base_ts"), "n_obs", "sum_offsets", "last_offset")


@_query
def ts_range_read(spark: SparkSession, folder: str) -> DataFrame:
    rows = series.encode(_observations(spark, folder), series.KEYS, "Timestamp", "Value")
    got = series.decode(rows, series.KEYS, F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-12 12:00:00").cast("timestamp_ntz"))
    return got.select(F.col("EntityId").alias("entity_id"), F.col("Timestamp").alias("ts"), F.col("Value").cast("double").alias("value"))


def _interpolated(method: Interpolation) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        got = series.interpolate(_observations(spark, folder), series.KEYS, START, END, STEP, method, order="event_id")
        return got.select(F.col("EntityId").alias("entity_id"), F.col("Timestamp").alias("ts"), F.round("Number", 6).alias("value"))

    return run


for _m in (Interpolation.LINEAR, Interpolation.NEAREST, Interpolation.PREVIOUS, Interpolation.NEXT):
    QUERIES[f"ts_interp_{_m.value.lower()}"] = _interpolated(_m)


@_query
def ts_interp_none(spark: SparkSession, folder: str) -> DataFrame:
    """On a grid of one second, samples of which stand on it by whole seconds."""
    whole = _observations(spark, folder).withColumn("Timestamp", F.date_trunc("minute", "Timestamp"))
    got = series.interpolate(whole, series.KEYS, START, END, timedelta(minutes=15), Interpolation.NONE, order="event_id")
    return got.select(F.col("EntityId").alias("entity_id"), F.col("Timestamp").alias("ts"), F.col("Number").alias("value"))


@_query
def ts_dsl(spark: SparkSession, folder: str) -> DataFrame:
    got = series.read_expression(_observations(spark, folder), "events,13,value,2024-01-02,2024-01-25,01:00:00,Previous")
    return got.select(F.col("Timestamp").alias("ts"), F.col("Value").cast("double").alias("value"))


@_query
def ts_dsl_raw(spark: SparkSession, folder: str) -> DataFrame:
    got = series.read_expression(_observations(spark, folder), "events,13,value,2024-01-02,2024-01-25")
    return got.select(F.col("Timestamp").alias("ts"), F.col("Value").cast("double").alias("value"))


@_query
def ts_delta_codec(spark: SparkSession, folder: str) -> DataFrame:
    """The store's deltas packed and unpacked: bytes taken, and what came back."""
    d = table(spark, folder, "systimeseriesdeltas").select("id", "deltas", codecs.pack_deltas(F.col("deltas")).alias("packed"))
    back = d.select("id", "deltas", F.length("packed").cast("bigint").alias("n_bytes"), codecs.unpack_deltas(F.col("packed")).alias("back"))
    return back.groupBy(F.col("deltas").eqNullSafe(F.col("back")).alias("same")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("n_bytes"))


@_query
def ts_delta_read(spark: SparkSession, folder: str) -> DataFrame:
    """Observations of the store's own base values and deltas, per table and property."""
    base = table(spark, folder, "systimeseriesbasevalues").dropDuplicates(["id"])
    delta = table(spark, folder, "systimeseriesdeltas").dropDuplicates(["id"]).where("base_value_id IS NOT NULL")
    rows = base.join(delta.select(F.lower("base_value_id").alias("k"), F.lit(0).cast("bigint").alias("StartMs"), F.col("deltas").alias("Deltas")), F.lower("id") == F.col("k"))
    rows = rows.select("table_name", F.substring_index("property_name", ".", 1).alias("property_name"), F.col("reading_value").alias("Value"), F.col("reading_timestamp").alias("BaseTimestamp"), "StartMs", "Deltas")
    got = series.decode(rows, ["table_name", "property_name"])
    return got.groupBy("table_name", "property_name").agg(F.count(F.lit(1)).alias("n"), F.max("Timestamp").alias("last"))


# changes


def _state(spark: SparkSession, folder: str, since: str, until: str) -> DataFrame:
    e = table(spark, folder, "events").where((F.col("ts") >= F.lit(since).cast("timestamp_ntz")) & (F.col("ts") < F.lit(until).cast("timestamp_ntz")))
    last = e.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value", "props")).alias("x"))
    return last.select(F.concat_ws("/", "user_id", "event_type").alias("Id"), F.col("x.value").alias("value"), F.col("x.props").alias("props"))


def _states(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return _state(spark, folder, "2024-01-08", "2024-01-15"), _state(spark, folder, "2024-01-15", "2024-01-22")


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return diff.paired(*_states(spark, folder), "Id")


@_query
def cdc_log(spark: SparkSession, folder: str) -> DataFrame:
    at = F.lit(AT).cast("timestamp_ntz")
    log = diff.change_log(_pairs(spark, folder), "events", ["props"], at)
    return log.select("EntityId", "PropertyName", "ChangeType", "ChangedBy", "OriginalValue", "NewValue", "ChangedAt")


@_query
def cdc_counts(spark: SparkSession, folder: str) -> DataFrame:
    log = diff.change_log(_pairs(spark, folder), "events", ["value", "props"], F.lit(AT).cast("timestamp_ntz"))
    return log.groupBy("PropertyName", "ChangeType").agg(F.count(F.lit(1)).alias("n"))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return diff.change_events(_pairs(spark, folder), "events", ["Id", "value", "props"], F.lit(AT).cast("timestamp_ntz"))


@_query
def cdc_event_map(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder)
    return e.select("EntityId", "Operation", F.array_join(F.array_sort(F.map_keys("Changed")), ",").alias("changed"), F.col("Changed")["props"]["new"].alias("new_props"))


def _written(spark: SparkSession, folder: str, write: Callable[[EntityService, DataFrame], object], **features) -> EntityService:
    """A service whose table holds the older state, after a write of the newer one."""
    old, new = _states(spark, folder)
    service = _engine(spark).entity(EntitySpec("states", old.schema, **features))
    service.insert(old)
    write(service, new)
    return service


@_query
def upsert_merge(spark: SparkSession, folder: str) -> DataFrame:
    return _written(spark, folder, lambda s, new: s.upsert(new)).find_all()


@_query
def update_existing(spark: SparkSession, folder: str) -> DataFrame:
    return _written(spark, folder, lambda s, new: s.update(new)).find_all()


@_query
def delete_anti(spark: SparkSession, folder: str) -> DataFrame:
    return _written(spark, folder, lambda s, new: s.delete(new)).find_all()


@_query
def write_counts(spark: SparkSession, folder: str) -> DataFrame:
    """What each kind of write says it did, and what is left after all rows were removed."""
    old, new = _states(spark, folder)
    s = _engine(spark).entity(EntitySpec("states", old.schema))
    done = [("insert", s.insert(old)), ("update", s.update(new)), ("upsert", s.upsert(new)), ("delete", s.delete(old)), ("delete_all", s.delete_all()), ("left", s.count())]
    return spark.createDataFrame(done, "step string, n bigint")


@_query
def write_change_log(spark: SparkSession, folder: str) -> DataFrame:
    """The change log of an insert and an upsert."""
    s = _written(spark, folder, lambda s, new: s.upsert(new), tracked=("props",))
    return s.engine.system("sysChangeLog").groupBy("PropertyName", "ChangeType", "ChangedBy").agg(F.count(F.lit(1)).alias("n"))


@_query
def write_events(spark: SparkSession, folder: str) -> DataFrame:
    """What a handler was told, and one that unsubscribed before the second write."""
    told: list[tuple[str, str, int]] = []

    def handler(name: str) -> Callable[[DataFrame], None]:
        return lambda events: told.extend((name, r["Operation"], r["count"]) for r in events.groupBy("Operation").count().collect())

    old, new = _states(spark, folder)
    s = _engine(spark).entity(EntitySpec("states", old.schema))
    stays, leaves = handler("stays"), handler("leaves")
    s.engine.bus.subscribe(stays)
    s.engine.bus.subscribe(leaves)
    s.insert(old)
    s.engine.bus.unsubscribe(leaves)
    s.upsert(new)
    return spark.createDataFrame(told, "handler string, operation string, n bigint")


@_query
def write_series(spark: SparkSession, folder: str) -> DataFrame:
    """Observations that an insert and an upsert record, unchanged values too."""
    s = _written(spark, folder, lambda s, new: s.upsert(new), series=("value",))
    return s.engine.samples().groupBy(F.col("EntityId").alias("Id")).agg(F.count(F.lit(1)).alias("n"))


@_query
def write_chain(spark: SparkSession, folder: str) -> DataFrame:
    """The hash chain after an insert and an upsert; every read is verified against it."""
    s = _written(spark, folder, lambda s, new: s.upsert(new), integrity=("props",))
    log = s.engine.system("sysIntegrityLog").groupBy("EntityId").agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("PreviousHash") == "").alias("firsts"))
    return log.select(F.col("EntityId").alias("Id"), "links", "firsts", F.lit(s.verify().count()).alias("wrong"))


# integrity


@_query
def integrity_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", integrity.value_hash(F.col("c_name")).alias("name_hash"), integrity.value_hash(F.col("c_custkey")).alias("key_hash"))


def _chain(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(F.lit("events").alias("TableName"), F.col("user_id").cast("string").alias("EntityId"), F.lit("event_type").alias("PropertyName"), F.col("ts").alias("Timestamp"), F.col("event_id").alias("Id"), "event_type")
    return integrity.chain(e, integrity.CHAIN, "Timestamp", "event_type", ["Id"])


@_query
def integrity_chain(spark: SparkSession, folder: str) -> DataFrame:
    return _chain(spark, folder).select("EntityId", "Timestamp", "Id", "Hash", "PreviousHash")


@_query
def integrity_verify(spark: SparkSession, folder: str) -> DataFrame:
    """The newest order of each customer against the log of all: those whose status was another one before."""
    e = table(spark, folder, "events")
    now = e.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("Value"))
    values = now.select(F.lit("events").alias("TableName"), F.col("user_id").cast("string").alias("EntityId"), F.lit("event_type").alias("PropertyName"), "Value")
    return integrity.violations(values, _chain(spark, folder)).select("EntityId", "Expected", "Actual")


@_query
def integrity_chain_break(spark: SparkSession, folder: str) -> DataFrame:
    """Links that break when the log has lost its purchases."""
    log = _chain(spark, folder)
    gone = integrity.value_hash(F.lit("purchase"))
    return integrity.broken_links(log.where(F.col("Hash") != gone)).select("EntityId", "Timestamp", "Expected", "Actual")


# texts and vectors


def _customer(spark: SparkSession, folder: str) -> tuple[EntitySpec, dict[str, DataFrame]]:
    t = {n: table(spark, folder, n) for n in ("customer", "orders", "nation")}
    spec = EntitySpec(
        "customer",
        t["customer"].schema,
        "c_custkey",
        embeds=(
            Embed("Customer {C_NAME} of {c_mktsegment}", 1, "c_name"),
            Embed("with {Orders.COUNT(o_orderkey)} orders from {Orders.MIN(o_orderkey)} to {Orders.MAX(o_orderkey)}", 0),
            Embed("{nothing}in {Nation.n_name}", 0, "c_nationkey"),
        ),
        children=(Child("Orders", "orders", "o_custkey"),),
        parents=(Parent("Nation", "nation", "c_nationkey"),),
    )
    return spec, t


@_query
def emb_template_text(spark: SparkSession, folder: str) -> DataFrame:
    spec, t = _customer(spark, folder)
    return render.entity_texts(t["customer"], spec, t).select("EntityId", "Text")


@_query
def emb_template_agg(spark: SparkSession, folder: str) -> DataFrame:
    spec, t = _customer(spark, folder)
    r = render.Renderer(spec, t)
    col = r.expression("{$.Orders[o @.o_orderstatus]}"), r.expression("{$.c_name}"), r.expression("as it is")
    return r.joined(t["customer"]).select("c_custkey", col[0].alias("states"), col[1].alias("name"), col[2].alias("other"))


@_query
def emb_hash_vector(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of whole texts by the default provider."""
    d = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("EntityId"), F.col("text").alias("Text"))
    return search.embed(d).select("EntityId", F.size("Embedding").alias("dimension"), F.round(F.aggregate("Embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x), 4).alias("norm"))


def _query_vector(spark: SparkSession, folder: str) -> list[float]:
    return table(spark, folder, "embeddings").where("vec_id = 0").first()["embedding"]


@_query
def vec_l2_topk(spark: SparkSession, folder: str) -> DataFrame:
    hits = search.nearest_l2(table(spark, folder, "embeddings"), _query_vector(spark, folder), 5, "vec_id", "embedding")
    return hits.select("vec_id", F.round("distance", 6).alias("distance"))


@_query
def vec_search_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    vectors = rows.select(F.col("vec_id").cast("string").alias("EntityId"), F.col("embedding").alias("Embedding"))
    got = search.search(rows.select("vec_id", "label"), "vec_id", vectors, _query_vector(spark, folder), 10)
    return got.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@_query
def vec_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Sums per label of vectors brought to length one."""
    v = table(spark, folder, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    unit = v.select("label", F.transform("embedding", lambda x: x.cast("double") / norm).alias("u"))
    first = unit.select("label", F.posexplode("u").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("mean"))
    return first.select("label", F.col("i").cast("int").alias("i"), F.round("mean", 6).alias("mean"))


@_query
def vec_put_remove(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    index = rows.where("label <> 3").select(F.col("vec_id").alias("EntityId"), F.col("embedding").alias("Embedding"))
    new = rows.where("label IN (3, 4)").select(F.col("vec_id").alias("EntityId"), F.reverse("embedding").alias("Embedding"))
    gone = rows.where("label = 5").select(F.col("vec_id").alias("EntityId"))
    out = search.remove_vectors(search.put_vectors(index, new, dimension=64), gone)
    return out.select(F.col("EntityId").alias("vec_id"), F.round(F.col("Embedding")[0].cast("double"), 5).alias("first"))


@_query
def vec_codec(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings").select("vec_id", "embedding", codecs.pack_vector(F.col("embedding")).alias("b"))
    return v.select("vec_id", F.length("b").cast("bigint").alias("n_bytes"), (codecs.unpack_vector(F.col("b")) == F.col("embedding")).alias("same"))


# programs


def _program(spark: SparkSession, folder: str, name: str, steps: list[Step], views: tuple[str, ...] = ()) -> DataFrame:
    _views(spark, folder, *views)
    value = programs.run(spark, steps, lambda: _observations(spark, folder))
    return spark.createDataFrame([(name, value)], "name string, value string")


@_query
def prog_sql(spark: SparkSession, folder: str) -> DataFrame:
    steps = [Step(StepType.SQL, "SELECT cast(max(o_orderkey) AS string) AS least FROM orders", "least"), Step(StepType.SQL, "SELECT count(*) AS n FROM lineitem WHERE l_quantity > (SELECT avg(l_quantity) FROM lineitem)", "n")]
    return _program(spark, folder, "sql", steps, ("orders", "lineitem"))


@_query
def prog_timeseries(spark: SparkSession, folder: str) -> DataFrame:
    got = _program(spark, folder, "series", [Step(StepType.VARIABLE, "'13'", "who"), Step(StepType.SERIES, "events,{who},value,2024-01-01,2024-01-31", "x")])
    return got.select("name", F.round(F.col("value").cast("double"), 6).alias("value"))


@_query
def prog_expr(spark: SparkSession, folder: str) -> DataFrame:
    return _program(spark, folder, "expr", [Step(StepType.SCRIPT, "42 * 2", "result")])


@_query
def prog_loop(spark: SparkSession, folder: str) -> DataFrame:
    return _program(spark, folder, "loop", [Step(StepType.VARIABLE, "0", "n"), Step(StepType.SCRIPT, "{n} + 1", "n"), Step(StepType.CONDITION, "{n} < 3", "2", 5), Step(StepType.SCRIPT, "{n}", "out")])


@_query
def prog_array_var(spark: SparkSession, folder: str) -> DataFrame:
    steps = [Step(StepType.VARIABLE, "0", "i"), Step(StepType.SCRIPT, "{i} * {i}", "squares[{i}]"), Step(StepType.VARIABLE, "{i} + 1", "i"), Step(StepType.CONDITION, "{i} < 5", "2", 10), Step(StepType.SCRIPT, "{squares[4]} + {squares[3]}", "out")]
    return _program(spark, folder, "array", steps)


@_query
def prog_rowset(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of one step queried by the next one."""
    steps = [Step(StepType.VARIABLE, "5000", "least"), Step(StepType.SQL, "SELECT c_nationkey AS k, c_acctbal AS b FROM customer WHERE c_acctbal > {least}", "rich"), Step(StepType.SQL, "SELECT count(DISTINCT k) AS n FROM rich", "n")]
    return _program(spark, folder, "rowset", steps, ("customer",))


@_query
def prog_callable(spark: SparkSession, folder: str) -> DataFrame:
    s = Scripts()
    s.register("double", lambda context: context["x"] * 2)
    value = programs.run(spark, [Step(StepType.VARIABLE, "21", "x"), Step(StepType.SCRIPT, "py:double", "y")], lambda: _observations(spark, folder), scripts=s)
    return spark.createDataFrame([("callable", value)], "name string, value string")


@_query
def prog_export(spark: SparkSession, folder: str) -> DataFrame:
    p = Program.from_json(Program("count", [Step(StepType.SQL, "SELECT COUNT(*) AS n FROM customer", "n")], 60).to_json())
    return spark.createDataFrame([(p.name, p.interval, p.steps[0].name, p.steps[0].config, p.steps[0].output)], "name string, run_interval int, operation string, expression string, result_variable string")


@_query
def prog_step_join(spark: SparkSession, folder: str) -> DataFrame:
    """Programs of the store with their steps in order."""
    heads = table(spark, folder, "sysanalytics").groupBy(fold_guid(F.col("id")).alias("id")).agg(F.min("program_name").alias("program_name"))
    steps = table(spark, folder, "sysanalyticssteps").dropDuplicates(["id"]).select(fold_guid(F.col("analytics_id")).alias("id"), "step_order", "operation")
    return heads.join(steps, "id").groupBy("id", "program_name").agg(F.count(F.lit(1)).alias("n_steps"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_order", "operation"))), lambda x: x["operation"]), ",").alias("operations"))


_ORDERS = "SELECT count(*) AS n FROM orders"


@_query
def val_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The first error of programs that are wrong, each in its own way."""
    schemas = {n: table(spark, folder, n).schema for n in ("orders", "customer")}
    one = Step(StepType.VARIABLE, "1", "x")
    wrong = {
        "01 none": [],
        "02 type": [Step("Nonsense", "1", "x")],
        "03 empty": [Step(StepType.SQL, "", "x")],
        "04 variable": [one, Step(StepType.SCRIPT, "{y} + 1", "z")],
        "05 array": [one, Step(StepType.SCRIPT, "2", "xs[1]")],
        "06 command": [Step(StepType.SQL, "DROP TABLE orders", "x")],
        "07 table": [Step(StepType.SQL, "SELECT 1 AS n FROM nowhere", "n")],
        "08 column": [Step(StepType.SQL, "SELECT max(price) AS n FROM orders", "n")],
        "09 series": [Step(StepType.SERIES, "orders,1", "x")],
        "10 boolean": [one, Step(StepType.CONDITION, "1 + 1", "1")],
        "11 jump": [one, Step(StepType.CONDITION, "true", "7")],
        "12 loop": [one, Step(StepType.CONDITION, "true", "1", 0)],
        "13 last": [Step(StepType.SCRIPT, "1", "")],
        "14 fine": [Step(StepType.SQL, "WITH w AS (SELECT o.o_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey) SELECT count(*) AS n FROM w", "n")],
    }
    rows = [(name, (validate.check(spark, Program(name, steps), schemas) or ["none"])[0].split(" in expression")[0]) for name, steps in wrong.items()]
    orders = validate.check(spark, Program("order", [Step(StepType.SQL, _ORDERS, "n")]), schemas, orders=[3])
    return spark.createDataFrame([*rows, ("15 order", orders[0])], "name string, error string")


@_query
def prog_service(spark: SparkSession, folder: str) -> DataFrame:
    """Programs kept, checked, run on demand, by interval and on changes, throttled, after a restart, and deleted."""
    now = [datetime(2024, 1, 22)]
    e = _engine(spark, lambda: now[0])
    for name in ("orders", "customer"):
        e.entity(EntitySpec(name, table(spark, folder, name).schema, table(spark, folder, name).columns[0]), lambda n=name: table(spark, folder, n))
    state = _states(spark, folder)[0]
    states = e.entity(EntitySpec("states", state.schema))
    a = AnalyticsService(e)
    steps = [Step(StepType.SQL, _ORDERS, "n")]
    demand, every = a.add(Program("demand", steps)), a.add(Program("every", steps, 60))
    change = a.add(Program("change", [Step(StepType.SQL, "SELECT count(*) AS n FROM states", "n")], -1))
    out = [("execute", a.execute(demand)), ("verify", str(a.verify(demand)[0])), ("zero", str(a.value(demand)))]
    out += [("tick", str(len(a.tick()))), ("tick again", str(len(a.tick()))), ("every", a.value(every))]
    states.insert(state)
    out.append(("change", a.value(change)))
    states.delete(state)
    out.append(("throttled", a.value(change)))
    a.close()
    now[0] += timedelta(seconds=5)
    again = AnalyticsService(e)
    again.on_events(e.system("sysChangeEvents"))
    out.append(("restarted in between", again.value(change)))
    now[0] += timedelta(seconds=60)
    again.on_events(e.system("sysChangeEvents"))
    out += [("later", again.value(change)), ("tick later", str(len(again.tick())))]
    log = e.system("sysChangeLog").where("TableName = 'sysAnalytics'")
    out.append(("value log", ",".join(f"{r[0]}>{r[1]}" for r in log.where(F.col("EntityId") == change).orderBy("ChangedAt").select("OriginalValue", "NewValue").collect())))
    again.delete(every)
    out.append(("left", ",".join(r[0] for r in e.system("sysAnalytics").orderBy("Name").select("Name").collect())))
    return spark.createDataFrame(out, "step string, value string")


# triggers and streams


def _triggers(spark: SparkSession) -> DataFrame:
    listed = {
        "a": Program("a", [Step(StepType.SQL, "SELECT AVG(value) AS v FROM EVENTS", "v")], -1),
        "b": Program("b", [Step(StepType.SERIES, "events,1,props,2024-01-01,2024-01-31", "v")], -1),
        "c": Program("c", [Step(StepType.SQL, "SELECT MAX(props) AS p FROM orders JOIN other ON true", "p")], -1),
    }
    rows = [(i, t, c) for i, p in listed.items() for t, c in triggers.triggers_of(spark, p)]
    return spark.createDataFrame(rows, triggers.TRIGGERS)


@_query
def trigger_match(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder)
    hit = triggers.matches(events, _triggers(spark)).join(events.select("EventId", "EntityId", "Operation"), "EventId")
    return hit.select("AnalyticsId", "EntityId", "Operation")


@_query
def trigger_throttle(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of programs, one per kind of event, started by every event but at most once in six hours."""
    e = table(spark, folder, "events").select(F.col("event_type").alias("AnalyticsId"), F.date_trunc("minute", "ts").alias("Timestamp"))
    return triggers.throttled(e, 6 * 3600).groupBy("AnalyticsId").agg(F.count(F.lit(1)).alias("runs"), F.max("Timestamp").alias("last_run"))


@_query
def stream_trigger_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The same matches, of the events read back as a stream."""
    events = materialize(_events(spark, folder), "feed")
    path, out = events.inputFiles()[0].rsplit("/", 1)[0], _scratch(spark, "matched")
    wanted = _triggers(spark)

    def handle(batch: DataFrame, number: int) -> None:
        hit = triggers.matches(batch, wanted).join(batch.select("EventId", "EntityId", "Operation"), "EventId")
        hit.select("AnalyticsId", "EntityId", "Operation").write.mode("overwrite").parquet(f"{out}/batch={number}")

    feed.feed_batches(feed.read_feed(spark, path), handle, _scratch(spark, "stream")).awaitTermination()
    return spark.read.schema("AnalyticsId string, EntityId string, Operation string, batch int").parquet(out).drop("batch")


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(table(spark, folder, "events").schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def _last_batch(spark: SparkSession, streamed: DataFrame, label: str) -> DataFrame:
    """The complete result of a stream after its last batch, each batch written whole to the shared folder."""
    out = _scratch(spark, label)
    done: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        done.append(number)

    query = streamed.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", _scratch(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(streamed.schema).parquet(f"{out}/batch={max(done)}")


@_query
def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per day and kind of event, kept up to date as a stream and read at its end."""
    got = _last_batch(spark, feed.windowed(_event_stream(spark, folder), "ts", "1 day", "1 day", ["event_type"], "value"), "windows")
    return got.select("event_type", "window_start", "n", F.round("total", 4).alias("total"))


@_query
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of users with pauses of up to six hours, kept up to date as a stream and read at its end."""
    return _last_batch(spark, feed.sessions(_event_stream(spark, folder), "ts", "6 hours", "1 day", ["user_id"]), "sessions").select("user_id", "session_start", "n")
