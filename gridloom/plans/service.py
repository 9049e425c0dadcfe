"""Entities and programs as services: rows with what follows from their changes, results on demand or by schedule."""

from __future__ import annotations

import datetime as dt
import logging
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.functions.time import moment
from gridloom.operators import diff, integrity, render, search, series
from gridloom.options import EngineOptions, Interpolation
from gridloom.plans import program as programs
from gridloom.plans import sqltext, triggers, validate
from gridloom.plans.program import Program, Scripts, Step
from gridloom.runtime import materialize
from gridloom.schemas import EVENTS, SYSTEM
from gridloom.sources.catalog import Catalog
from gridloom.sources.store import Store, Transaction
from gridloom.spec import EntitySpec

log = logging.getLogger(__name__)
#: Seconds between two runs of one program; changes in between are dropped.
THROTTLE = 10


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


class EventBus:
    """Handlers called with the events of a commit, one after another; a handler that fails doesn't stop the others."""

    def __init__(self) -> None:
        self._handlers: list[Callable[[DataFrame], None]] = []

    def subscribe(self, handler: Callable[[DataFrame], None]) -> None:
        self._handlers.append(handler)

    def unsubscribe(self, handler: Callable[[DataFrame], None]) -> None:
        if handler in self._handlers:
            self._handlers.remove(handler)

    def publish(self, events: DataFrame) -> None:
        for h in list(self._handlers):
            try:
                h(events)
            except Exception:
                log.exception("a handler of change events failed")


class Engine:
    """Options, store, catalog and bus of one deployment."""

    def __init__(self, spark: SparkSession, options: EngineOptions, provider: search.EmbeddingProvider | None = None, clock: Callable[[], dt.datetime] = _now):
        if not options.root:
            raise ValueError("options need the root folder of the store")
        self.spark, self.options, self.clock = spark, options, clock
        self.store = Store(spark, options.root)
        self.catalog = Catalog(self.store)
        self.bus = EventBus()
        self.provider = provider or search.HashingProvider()
        self.store.ensure({"sysChangeEvents": EVENTS})
        self.catalog.ensure()

    def entity(self, spec: EntitySpec, rows: Callable[[], DataFrame] | None = None) -> "EntityService":
        """The service of an entity; `rows` gives its rows where they don't lie in the store, and can't be written."""
        self.catalog.register(spec, rows)
        self.catalog.ensure()
        return EntityService(self, self.catalog.spec(spec.table))

    def system(self, table: str) -> DataFrame:
        return self.store.read(table)

    def samples(self) -> DataFrame:
        """All observations: KEYS, Timestamp, Value."""
        base = self.system("sysTimeseriesBaseValues").select(F.col("Id").alias("BaseValueId"), *series.KEYS, "Value", F.col("Timestamp").alias("BaseTimestamp"))
        return series.decode(base.join(self.system("sysTimeseriesDeltas").drop("Id"), "BaseValueId"), series.KEYS)

    def query(self, sql: str, params: Mapping[str, object] | Sequence[object] = ()) -> DataFrame:
        """Rows of a query over the user tables. What isn't a query, or reads anything else, is refused."""
        text = sqltext._POSITION.sub(r":p\1", sql)
        why = sqltext.refuse(self.spark, text, self.options.compat)
        if why:
            raise ValueError(why)
        known = {t.lower() for t in self.catalog.tables()}
        for t in sorted(sqltext.relations(self.spark, text)):
            if t.lower() not in known:
                raise ValueError(f"Invalid table reference {t}")
        self.catalog.views()
        return sqltext.query(self.spark, sql, params)


class EntityService:
    """One entity's table. Rows come and go as DataFrames or lists of dicts; each call is one commit of the table."""

    def __init__(self, engine: Engine, spec: EntitySpec):
        self.engine, self.spec = engine, spec

    # reading

    def _rows(self) -> DataFrame:
        return self.engine.catalog.rows(self.spec.table)

    def _verified(self, rows: DataFrame, verify: bool | None) -> DataFrame:
        if verify is False or not (self.engine.options.integrity and self.spec.integrity):
            return rows
        chain = self.engine.system("sysIntegrityLog").where(F.col("TableName") == self.spec.table)
        integrity.raise_first(integrity.violations(integrity.unpivot(rows, self.spec.table, self.spec.key, list(self.spec.integrity)), chain))
        mine = chain.join(rows.select(F.col(self.spec.key).cast("string").alias("EntityId")), "EntityId", "left_semi")
        integrity.raise_first(integrity.broken_links(mine))
        return rows

    def find_all(self, verify: bool | None = None) -> DataFrame:
        return self._verified(self._rows(), verify)

    def find_by_id(self, ident: object, verify: bool | None = None) -> Row | None:
        found = self._verified(self._rows().where(F.col(self.spec.key) == F.lit(ident)).limit(1), verify).collect()
        return found[0] if found else None

    def find(self, predicate: Column | str, skip: int = 0, limit: int | None = None, verify: bool | None = None) -> DataFrame:
        """Matching rows in order of the key, from `skip` on, `limit` at most."""
        rows = self._rows().where(predicate)
        if skip or limit is not None:
            rows = rows.orderBy(self.spec.key).offset(skip)
            rows = rows if limit is None else rows.limit(limit)
        return self._verified(rows, verify)

    def count(self, predicate: Column | str | None = None) -> int:
        rows = self._rows()
        return (rows if predicate is None else rows.where(predicate)).count()

    def query(self, sql: str, params: Mapping[str, object] | Sequence[object] = (), verify: bool | None = None) -> DataFrame:
        """The entities a query returns; it must give all columns of the table."""
        return self._verified(self.engine.query(sql, params).select(*self.spec.schema.names), verify)

    def search(self, text: str, k: int = 1) -> DataFrame:
        """The k entities whose texts are nearest, nearest first. Nothing for an empty text, k below 1 or without embeddings."""
        rows = self._rows()
        vectors = self.engine.system("sysEmbeddings").where(F.col("TableName") == self.spec.table)
        if not text or k < 1 or not self.engine.options.embeddings:
            return rows.withColumn("distance", F.lit(0.0)).limit(0)
        query = search.embed_text(text, self.engine.provider)
        return search.search(rows, self.spec.key, vectors.select("EntityId", "Embedding"), query.tolist(), k, self.engine.options.compat)

    def series(self, ident: object, column: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
        """Observations of a column with start <= Timestamp <= end, in order of time."""
        out = self._samples(ident, column).where((F.col("Timestamp") >= moment(start)) & (F.col("Timestamp") <= moment(end)))
        return out.select("Timestamp", "Value").orderBy("Timestamp", "Value")

    def interpolated(self, ident: object, column: str, start: dt.datetime, end: dt.datetime, step: dt.timedelta, method: Interpolation | str) -> DataFrame:
        out = series.interpolate(self._samples(ident, column), series.KEYS, start, end, step, method, compat=self.engine.options.compat)
        return out.select("Timestamp", "Value").orderBy("Timestamp")

    def _samples(self, ident: object, column: str) -> DataFrame:
        s = self.engine.samples()
        if not self.engine.options.timeseries:
            return s.limit(0)
        return s.where((F.col("TableName") == self.spec.table) & (F.col("EntityId") == str(ident)) & (F.col("PropertyName") == column))

    # writing

    def _incoming(self, rows: DataFrame | Iterable[Mapping]) -> DataFrame:
        if isinstance(rows, DataFrame):
            return rows.select(*self.spec.schema.names)
        return self.engine.spark.createDataFrame([tuple(r.get(c) for c in self.spec.schema.names) for r in rows], self.spec.schema)

    def insert(self, rows: DataFrame | Iterable[Mapping]) -> int:
        """Add new rows; returns how many. A key that is there already, or twice, raises."""
        new = materialize(self._incoming(rows), "incoming")
        key = self.spec.key

        def states(t: Transaction) -> tuple[DataFrame, DataFrame]:
            twice = new.groupBy(key).count().where("count > 1").select(key)
            there = new.join(t.rows(self.spec.table).select(key), key, "left_semi").select(key)
            for r in twice.unionByName(there).limit(1).collect():
                raise ValueError(f"{self.spec.table} has {key} {r[0]} already")
            return new.limit(0), new

        return self._write(states)

    def update(self, rows: DataFrame | Iterable[Mapping]) -> int:
        """Set rows that are there; returns how many of the given ones are. Others change nothing."""
        given = materialize(self._last(self._incoming(rows)), "incoming")

        def states(t: Transaction) -> tuple[DataFrame, DataFrame]:
            old = self._old(t, given)
            return old, given.join(old.select(self.spec.key), self.spec.key, "left_semi").select(*self.spec.schema.names)

        return self._write(states)

    def upsert(self, rows: DataFrame | Iterable[Mapping]) -> int:
        """Update rows that are there, insert others, all or none; of several of one key the last given counts."""
        new = materialize(self._last(self._incoming(rows)), "incoming")
        return self._write(lambda t: (self._old(t, new), new))

    def delete(self, idents: DataFrame | Iterable[object]) -> int:
        """Remove rows by key; returns how many were there. Their series and vectors stay."""
        key = self.spec.key
        named = idents.select(key) if isinstance(idents, DataFrame) else self.engine.spark.createDataFrame([(i,) for i in idents], StructType([self.spec.schema[key]]))
        named = materialize(named, "leaving")
        return self._write(lambda t: (self._old(t, named), t.rows(self.spec.table).limit(0)))

    def delete_all(self) -> int:
        """Remove all rows, and their vectors and series, at once; the logs stay."""
        mine = F.col("TableName") == self.spec.table

        def and_more(t: Transaction) -> None:
            base = t.rows("sysTimeseriesBaseValues")
            gone = base.where(mine).select(F.col("Id").alias("BaseValueId"))
            t.replace("sysTimeseriesDeltas", t.rows("sysTimeseriesDeltas").join(gone, "BaseValueId", "left_anti"))
            t.replace("sysTimeseriesBaseValues", base.where(~mine))
            t.replace("sysEmbeddings", t.rows("sysEmbeddings").where(~mine))

        return self._write(lambda t: (t.rows(self.spec.table), t.rows(self.spec.table).limit(0)), and_more)

    def _last(self, rows: DataFrame) -> DataFrame:
        numbered = rows.withColumn("given", F.monotonically_increasing_id())
        best = numbered.groupBy(self.spec.key).agg(F.max_by(F.struct(*self.spec.schema.names), "given").alias("r"))
        return best.select("r.*")

    def _old(self, t: Transaction, new: DataFrame) -> DataFrame:
        return materialize(t.rows(self.spec.table).join(new.select(self.spec.key), self.spec.key, "left_semi").select(*self.spec.schema.names), "before")

    def _write(self, states: Callable[[Transaction], tuple[DataFrame, DataFrame]], and_more: Callable[[Transaction], None] | None = None) -> int:
        """One commit of the change from the old to the new rows that `states` gives and of all that follows from it; then publish.

        If another writer commits to a table that was read, all of it is made anew from the newer rows.
        """
        n, events = self.engine.store.transact(lambda t: self._changed(t, *states(t), and_more))
        if events is not None:
            self.engine.bus.publish(events)
        return n

    def _changed(self, t: Transaction, old: DataFrame, new: DataFrame, and_more: Callable[[Transaction], None] | None) -> tuple[int, DataFrame | None]:
        e, spec, opt = self.engine, self.spec, self.engine.options
        at = moment(e.clock())
        pairs = materialize(diff.paired(old, new, spec.key), "changes")
        n = pairs.count()
        if n:
            gone = pairs.where("o IS NOT NULL").select(F.col(f"o.{spec.key}").alias(spec.key))
            added = pairs.where("n IS NOT NULL").select("n.*")
            t.replace_keys(spec.table, gone, added)
            if opt.change_tracking and spec.tracked:
                t.append("sysChangeLog", diff.change_log(pairs, spec.table, list(spec.tracked), at, opt.changed_by))
            if opt.integrity and spec.integrity:
                both = pairs.select(F.explode(F.array(F.coalesce("n", "o"))).alias("r")).select("r.*")
                values = materialize(integrity.unpivot(both, spec.table, spec.key, list(spec.integrity)), "values")
                log = t.rows("sysIntegrityLog").where(F.col("TableName") == spec.table).join(values.select("EntityId").distinct(), "EntityId", "left_semi")
                t.append("sysIntegrityLog", integrity.append(log, values, at))
            if opt.embeddings and spec.embeds:
                self._embed(t, added)
            if opt.timeseries and spec.series:
                self._observe(t, added, at)
        if and_more:
            and_more(t)
        if not n:
            return 0, None
        events = materialize(diff.change_events(pairs, spec.table, spec.schema.names, at), "events")
        t.append("sysChangeEvents", events)
        return n, events

    def _embed(self, t: Transaction, rows: DataFrame) -> None:
        e, spec = self.engine, self.spec
        related = {t: e.catalog.rows(t) for t in {*(c.table for c in spec.children), *(p.table for p in spec.parents)}}
        texts = render.entity_texts(rows, spec, related).where("Text IS NOT NULL")
        new = search.embed(texts, "Text", e.provider).select(F.sha2(F.concat_ws("|", F.lit(spec.table), "EntityId"), 256).alias("Id"), F.lit(spec.table).alias("TableName"), "EntityId", "Embedding")
        new = materialize(new, "vectors")
        t.replace_keys("sysEmbeddings", new.select("TableName", "EntityId"), new)

    def _observe(self, t: Transaction, rows: DataFrame, at: Column) -> None:
        """Record the series columns' values, unchanged ones too."""
        spec = self.spec
        seen = integrity.unpivot(rows, spec.table, spec.key, list(spec.series)).withColumn("Value", F.coalesce("Value", F.lit("")))
        keys = [*series.KEYS, "Value"]
        ident = F.sha2(F.concat_ws("|", *keys), 256)
        known = t.rows("sysTimeseriesBaseValues").where(F.col("TableName") == spec.table).select("Id", "Timestamp")
        seen = materialize(seen.withColumn("Id", ident).join(known, "Id", "left").withColumn("at", at), "observed")
        t.append("sysTimeseriesBaseValues", seen.where("Timestamp IS NULL").select("Id", *keys, F.col("at").alias("Timestamp")))
        offset = F.expr("timestampdiff(MILLISECOND, coalesce(Timestamp, at), at)")
        t.append("sysTimeseriesDeltas", seen.select(F.sha2(F.concat_ws("|", "Id", at.cast("string")), 256).alias("Id"), F.col("Id").alias("BaseValueId"), offset.alias("StartMs"), F.array(F.lit(0).cast("bigint")).alias("Deltas"), offset.alias("LastTimestamp"), F.lit(1).alias("Version")))

    def verify(self) -> DataFrame:
        """A report in place of an error: values that differ from the log, and broken links."""
        chain = self.engine.system("sysIntegrityLog").where(F.col("TableName") == self.spec.table)
        wrong = integrity.violations(integrity.unpivot(self._rows(), self.spec.table, self.spec.key, list(self.spec.integrity)), chain)
        return wrong.withColumn("Kind", F.lit("value")).unionByName(integrity.broken_links(chain).drop("Timestamp").withColumn("Kind", F.lit("link")))


class AnalyticsService:
    """Programs: kept, checked, run on demand, at intervals and on changes."""

    def __init__(self, engine: Engine, scripts: Scripts | None = None):
        self.engine, self.scripts = engine, scripts or Scripts()
        # A restart keeps when programs last ran; their triggers follow from their steps.
        self._last_run: dict[str, dt.datetime] = {r["Id"]: r["LastRun"] for r in engine.system("sysAnalytics").where("LastRun IS NOT NULL").select("Id", "LastRun").collect()}
        self._triggers: dict[str, list[tuple[str, str | None]]] = {}
        for p in self._load():
            self._watch(p)
        engine.bus.subscribe(self.on_events)

    def close(self) -> None:
        self.engine.bus.unsubscribe(self.on_events)

    # keeping

    def _load(self, ident: str | None = None) -> list[Program]:
        heads = self.engine.system("sysAnalytics")
        steps = self.engine.system("sysAnalyticsSteps")
        if ident is not None:
            heads, steps = heads.where(F.col("Id") == ident), steps.where(F.col("AnalyticsId") == ident)
        by: dict[str, list[Row]] = {}
        for r in steps.collect():  # programs are configuration: a few steps each
            by.setdefault(r["AnalyticsId"], []).append(r)
        out = []
        for h in heads.collect():
            own = sorted(by.get(h["Id"], []), key=lambda r: r["Order"])
            out.append(Program(h["Name"], [Step(r["Operation"], r["Expression"] or "", r["ResultVariable"] or "", r["MaxLoop"]) for r in own], h["Interval"], h["Embeddable"], h["Id"]))
        return out

    def _get(self, ident: str) -> Program:
        found = self._load(ident)
        if not found:
            raise KeyError(f"Analytics {ident} does not exist.")
        return found[0]

    def _schemas(self) -> dict:
        return {t: self.engine.catalog.rows(t).schema for t in self.engine.catalog.tables() if t != "sysChangeEvents"}

    def add(self, p: Program) -> str:
        """Keep a program; returns its id. A name that is taken, and any error found, raise."""
        e = self.engine
        if not e.system("sysAnalytics").where(F.col("Name") == p.name).isEmpty():
            raise ValueError(f"Analytics {p.name} exists.")
        errors = validate.check(e.spark, p, self._schemas(), self.scripts, compat=e.options.compat)
        if errors:
            raise ValueError("Validation Failed: " + "; ".join(errors))
        p.id = p.id or str(uuid.uuid4())
        steps = [(str(uuid.uuid4()), p.id, i + 1, s.kind.value, s.config, s.output or "", s.max_loop if s.kind.value == "Condition" else programs.MAX_LOOP) for i, s in enumerate(p.steps)]
        head = e.spark.createDataFrame([(p.id, p.name, "0", p.interval, None, p.embeddable, "OK")], SYSTEM["sysAnalytics"])

        def keep(t: Transaction) -> None:
            if not t.rows("sysAnalytics").where(F.col("Name") == p.name).isEmpty():
                raise ValueError(f"Analytics {p.name} exists.")
            t.append("sysAnalyticsSteps", e.spark.createDataFrame(steps, SYSTEM["sysAnalyticsSteps"]))
            t.append("sysAnalytics", head)

        e.store.transact(keep)
        self._watch(p)
        return p.id

    def delete(self, ident: str) -> None:
        self._get(ident)
        of = lambda c: self.engine.spark.createDataFrame([(ident,)], f"{c} string")

        def leave(t: Transaction) -> None:
            t.replace_keys("sysAnalyticsSteps", of("AnalyticsId"))
            t.replace_keys("sysAnalytics", of("Id"))

        self.engine.store.transact(leave)
        self._triggers.pop(ident, None)
        self._last_run.pop(ident, None)

    def verify(self, p: Program | str) -> tuple[bool, list[str]]:
        """Whether a program can run, and its errors; those of a kept one become its status."""
        ident = p if isinstance(p, str) else None
        if ident is not None:
            found = self._load(ident)
            if not found:
                return False, [f"Analytics {ident} does not exist."]
            p = found[0]
        errors = validate.check(self.engine.spark, p, self._schemas(), self.scripts, compat=self.engine.options.compat)
        if ident is not None:
            self._set(ident, Status="; ".join(errors)[:4000] if errors else "OK")
        return not errors, errors

    def export_json(self, ident: str) -> str:
        return self._get(ident).to_json()

    def import_json(self, text: str) -> str:
        p = Program.from_json(text)
        p.id = ""
        return self.add(p)

    def value(self, ident: str) -> str | None:
        r = self.engine.system("sysAnalytics").where(F.col("Id") == ident).select("Value").first()
        return r[0] if r else None

    def tables(self) -> list[str]:
        return [t for t in self.engine.catalog.tables() if t != "sysChangeEvents"]

    def _set(self, ident: str, **values: object) -> None:
        def change(d: DataFrame) -> DataFrame:
            mine = F.col("Id") == ident
            new = {k: moment(v) if isinstance(v, dt.datetime) else F.lit(v).cast(d.schema[k].dataType) for k, v in values.items()}
            return d.withColumns({k: F.when(mine, v).otherwise(F.col(k)) for k, v in new.items()})

        self.engine.store.change("sysAnalytics", change)

    # running

    def execute(self, ident: str) -> str:
        """Run now and return the result's text; within THROTTLE seconds of the last run, the kept one."""
        p = self._get(ident)
        if not self._due(ident, self.engine.clock()):
            return self.value(ident) or ""
        return self._run(p, keep=False)

    def _due(self, ident: str, now: dt.datetime) -> bool:
        last = self._last_run.get(ident)
        return last is None or (now - last).total_seconds() >= THROTTLE

    def _run(self, p: Program, keep: bool) -> str:
        """keep: the result becomes the program's value, with a change log row if it differs."""
        e, now = self.engine, self.engine.clock()
        self._last_run[p.id] = now
        try:
            e.catalog.views()
            result = programs.run(e.spark, p.steps, e.samples, {}, self.scripts, e.options.compat)
        except Exception as x:
            self._set(p.id, LastRun=now, Status=f"Runtime Error: {str(x).splitlines()[0]}"[:4000])
            raise
        before = self.value(p.id)
        self._set(p.id, LastRun=now, Status="OK", Value=result)
        if keep and e.options.change_tracking and before != result:
            row = (str(uuid.uuid4()), "sysAnalytics", p.id, e.options.changed_by, "Value", now, before, result, "Update")
            e.store.append("sysChangeLog", e.spark.createDataFrame([row], SYSTEM["sysChangeLog"]))
        if keep and p.embeddable and e.options.embeddings:
            vector = search.embed_text(f"{p.name} {result}", e.provider).tolist()
            new = e.spark.createDataFrame([(p.id, "sysAnalytics", p.id, vector)], SYSTEM["sysEmbeddings"])
            e.store.change("sysEmbeddings", lambda d: d.where((F.col("TableName") != "sysAnalytics") | (F.col("EntityId") != p.id)).unionByName(new))
        return result

    def tick(self, now: dt.datetime | None = None) -> list[str]:
        """Run the programs whose interval (seconds, above 0) is over; one that fails doesn't stop the others. Returns their ids."""
        now = now or self.engine.clock()
        last = {r["Id"]: r["LastRun"] for r in self.engine.system("sysAnalytics").select("Id", "LastRun").collect()}
        ran = []
        for p in self._load():
            before = last.get(p.id)
            if p.interval > 0 and (before is None or (now - before).total_seconds() >= p.interval) and self._due(p.id, now):
                self._try(p, ran)
        return ran

    def _try(self, p: Program, ran: list[str]) -> None:
        try:
            self._run(p, keep=True)
            ran.append(p.id)
        except Exception:
            log.exception("program %s failed", p.name)

    def _watch(self, p: Program) -> None:
        if p.interval < 0:
            self._triggers[p.id] = triggers.triggers_of(self.engine.spark, p, self.engine.options.compat, self._schemas())

    def on_events(self, events: DataFrame) -> list[str]:
        """Run the programs (interval below 0) that the events start, each at most once; throttled ones are left out."""
        rows = [(i, t, c) for i, found in self._triggers.items() for t, c in found]
        if not rows:
            return []
        hits = triggers.matches(events, self.engine.spark.createDataFrame(rows, triggers.TRIGGERS)).select("AnalyticsId").distinct()
        ran: list[str] = []
        for r in hits.collect():  # programs, not events
            if self._due(r[0], self.engine.clock()):
                for p in self._load(r[0]):
                    self._try(p, ran)
        return ran
