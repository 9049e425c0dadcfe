"""Entities rendered to text by templates, compiled once into columns.

A template holds text and places: `{Column}`, `{Children.MAX(Column)}` (MIN, COUNT), `{Parent.Column}`. The other form of
expressions, `{$.Column}` and `{$.Children[x @.Column]}`, gives a value, or the children's texts with blanks between.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.spec import EntitySpec

_PLACE = re.compile(r"\{([^{}]*)\}")
_AGGREGATE = re.compile(r"(\w+)\.(MAX|MIN|COUNT)\((\w*)\)", re.IGNORECASE)
_PATH = re.compile(r"(\w+)\.(\w+)")
_EXPRESSION = re.compile(r"\{\$\.(\w+)(?:\[(\w+)\s+@\.(\w+)\])?\}")


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


class Renderer:
    """Collects what a template needs from other tables, so that each is joined once."""

    def __init__(self, spec: EntitySpec, tables: Mapping[str, DataFrame]):
        self.spec, self.tables = spec, tables
        self.children: dict[tuple[str, str], dict[str, Column]] = {}
        self.parents: dict[str, set[str]] = {}

    def place(self, inner: str) -> Column:
        """The column of what stands between braces; the empty text for what there isn't."""
        m = _AGGREGATE.fullmatch(inner)
        if m:
            return self._child(m[1], m[2].upper(), m[3])
        m = _PATH.fullmatch(inner)
        if m:
            p = next((p for p in self.spec.parents if p.name.lower() == m[1].lower()), None)
            name = p and next((c for c in self.tables[p.table].columns if c.lower() == m[2].lower()), None)
            if not name:
                return F.lit("")
            self.parents.setdefault(p.name, set()).add(name)
            return _text(F.col(f"`parent {p.name} {name}`"))
        column = self.spec.column(inner)
        return _text(F.col(f"`{column}`")) if column else F.lit("")

    def _child(self, collection: str, how: str, column: str) -> Column:
        c = next((c for c in self.spec.children if c.name.lower() == collection.lower()), None)
        if c is None:
            return F.lit("")
        name = next((x for x in self.tables[c.table].columns if x.lower() == column.lower()), None)
        alias = f"child {c.name} {how} {name}"
        if how == "COUNT":
            agg = F.count(F.lit(1))
        elif name is None:
            return F.lit("")
        elif how == "JOIN":
            agg = F.array_join(F.filter(F.array_sort(F.collect_list(F.col(name).cast("string"))), lambda x: x != ""), " ")
        else:
            agg = {"MAX": F.max, "MIN": F.min}[how](name)
        self.children.setdefault((c.table, c.foreign_key), {})[alias] = agg.alias(alias)
        got = F.col(f"`{alias}`")
        return F.coalesce(got, F.lit(0)).cast("string") if how == "COUNT" else _text(got)

    def template(self, template: str) -> Column:
        parts, at = [], 0
        for m in _PLACE.finditer(template):
            parts += [F.lit(template[at : m.start()]), self.place(m[1])]
            at = m.end()
        return F.concat(*parts, F.lit(template[at:])) if parts else F.lit(template)

    def expression(self, text: str) -> Column:
        """`{$.Column}` or `{$.Children[x @.Column]}`; an unknown column raises, any other text stands for itself."""
        m = _EXPRESSION.fullmatch(text.strip())
        if not m:
            return F.lit(text)
        if m[3]:
            return self._child(m[1], "JOIN", m[3])
        column = self.spec.column(m[1])
        if column is None:
            raise ValueError(f"{self.spec.table} has no column {m[1]}")
        return _text(F.col(f"`{column}`"))

    def joined(self, rows: DataFrame) -> DataFrame:
        """The entity's rows with all that the compiled templates need; children are aggregated before the join."""
        key = self.spec.key
        for i, ((name, fk), aggs) in enumerate(self.children.items()):
            found = self.tables[name].groupBy(F.col(fk).alias(f"fk {i}")).agg(*aggs.values())
            rows = rows.join(found, F.col(f"`{key}`") == F.col(f"`fk {i}`"), "left").drop(f"fk {i}")
        for name, columns in self.parents.items():
            p = next(p for p in self.spec.parents if p.name == name)
            other = self.tables[p.table]
            other = other.select(F.col(other.columns[0]).alias(f"pk {name}"), *[F.col(c).alias(f"parent {name} {c}") for c in sorted(columns)])
            rows = rows.join(other, F.col(f"`{p.foreign_key}`") == F.col(f"`pk {name}`"), "left").drop(f"pk {name}")
        return rows


def entity_texts(rows: DataFrame, spec: EntitySpec, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """EntityId, Text: the columns' templates by priority, then those of the entity, blanks between, trimmed; empty is null."""
    r = Renderer(spec, tables or {})
    ordered = sorted((e for e in spec.embeds if e.column), key=lambda e: e.priority) + sorted((e for e in spec.embeds if not e.column), key=lambda e: e.priority)
    texts = [r.template(e.template) for e in ordered]
    text = F.trim(F.concat_ws(" ", *texts)) if texts else F.lit("")
    out = r.joined(rows)
    return out.select(F.col(f"`{spec.key}`").cast("string").alias("EntityId"), F.when(text != "", text).alias("Text"))
