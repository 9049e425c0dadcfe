"""The registered entities and where their rows come from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from gridloom.schemas import SYSTEM
from gridloom.sources.store import Store
from gridloom.spec import EntitySpec


class Catalog:
    """Specs by table name, regardless of case. The first registration of a name stays."""

    def __init__(self, store: Store | None = None):
        self.store = store
        self._specs: dict[str, EntitySpec] = {}
        self._others: dict[str, Callable[[], DataFrame]] = {}

    def register(self, spec: EntitySpec, rows: Callable[[], DataFrame] | None = None) -> EntitySpec:
        """Register an entity; `rows` gives its rows where they don't lie in the store."""
        kept = self._specs.setdefault(spec.table.lower(), spec)
        if kept is spec and rows is not None:
            self._others[spec.table.lower()] = rows
        return kept

    def ensure(self) -> None:
        """Make all tables that aren't there, the system's too."""
        own = {s.table: s.schema for k, s in self._specs.items() if k not in self._others}
        self.store.ensure(SYSTEM | own)

    def spec(self, table: str) -> EntitySpec | None:
        return self._specs.get(table.lower())

    def tables(self) -> list[str]:
        """User tables: all but the system's."""
        system = {s.lower() for s in SYSTEM}
        stored = self.store.tables() if self.store else []
        names = {s.table.lower(): s.table for s in self._specs.values()} | {t.lower(): t for t in stored}
        return sorted(n for k, n in names.items() if k not in system)

    def rows(self, table: str) -> DataFrame:
        other = self._others.get(table.lower())
        if other:
            return other()
        spec = self.spec(table)
        return self.store.read(spec.table if spec else table)

    def views(self) -> None:
        """Make every user table a view of its name, as of now."""
        for t in self.tables():
            self.rows(t).createOrReplaceTempView(t)
