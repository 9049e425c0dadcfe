"""Declared entities: a table, its key, and what is done with which column."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import StructType

from gridloom.options import check_table_name


@dataclass(frozen=True)
class Embed:
    """A text template of a column, or of the whole entity if `column` is None; lower priority comes first."""

    template: str
    priority: int = 0
    column: str | None = None

    def __post_init__(self) -> None:
        if self.template is None:
            raise ValueError("an embedding template may be empty, but not null")


@dataclass(frozen=True)
class Child:
    """A collection of the entity's children in another table, by foreign key."""

    name: str
    table: str
    foreign_key: str


@dataclass(frozen=True)
class Parent:
    """A single related row that this entity's `foreign_key` points to."""

    name: str
    table: str
    foreign_key: str


@dataclass(frozen=True)
class EntitySpec:
    table: str
    schema: StructType
    key: str = "Id"
    tracked: tuple[str, ...] = ()
    series: tuple[str, ...] = ()
    integrity: tuple[str, ...] = ()
    embeds: tuple[Embed, ...] = ()
    children: tuple[Child, ...] = ()
    parents: tuple[Parent, ...] = ()
    _names: dict[str, str] = field(init=False, repr=False, compare=False, hash=False, default_factory=dict)

    def __post_init__(self) -> None:
        check_table_name(self.table)
        self._names.update({n.lower(): n for n in self.schema.names})
        if self.key.lower() not in self._names:
            raise ValueError(f"{self.table} has no key column {self.key}")
        object.__setattr__(self, "key", self._names[self.key.lower()])
        for c in (*self.tracked, *self.series, *self.integrity, *(e.column for e in self.embeds if e.column)):
            if c.lower() not in self._names:
                raise ValueError(f"{self.table} has no column {c}")

    def column(self, name: str) -> str | None:
        """The column of that name regardless of case."""
        return self._names.get(name.lower())
