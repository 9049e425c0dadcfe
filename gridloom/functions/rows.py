"""Rows whose columns are known only when they come: a value by name, JSON, objects."""

from __future__ import annotations

import json
from typing import TypeVar

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

T = TypeVar("T")


def value(row: Row, name: str, kind: type[T]) -> T | None:
    """The value of that name if there is one of that kind, else None."""
    found = row.asDict().get(name)
    return found if isinstance(found, kind) else None


def row_json(row: Row) -> str:
    return json.dumps(row.asDict(recursive=True), indent=2, default=str, ensure_ascii=False)


def json_rows(df: DataFrame, indented: bool = False) -> DataFrame:
    """One column `data`: each row as a JSON text, nulls included."""
    return df.select(F.to_json(F.struct(*[df[c] for c in df.columns]), {"pretty": str(indented).lower(), "ignoreNullFields": "false"}).alias("data"))


def map_to(row: Row, kind: type[T]) -> T:
    """An object of a class without arguments, its attributes set from columns of the same name."""
    made = kind()
    for name, v in row.asDict().items():
        if hasattr(made, name):
            setattr(made, name, v)
    return made
