"""Options and enumerations of the engine."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from enum import Enum


class Interpolation(str, Enum):
    NONE = "None"
    LINEAR = "Linear"
    NEAREST = "Nearest"
    PREVIOUS = "Previous"
    NEXT = "Next"

    @classmethod
    def parse(cls, text: str) -> "Interpolation":
        for m in cls:
            if m.value.lower() == text.strip().lower():
                return m
        raise ValueError(f"Invalid interpolation method: {text}")


class StepType(str, Enum):
    SQL = "SqlQuery"
    SCRIPT = "CSharp"
    CONDITION = "Condition"
    VARIABLE = "Variable"
    SERIES = "Timeseries"

    @classmethod
    def parse(cls, text: str | int) -> "StepType | None":
        """By name regardless of case, or by number in the order above; None if it is no step type."""
        order = [cls.SQL, cls.SCRIPT, cls.CONDITION, cls.VARIABLE, cls.SERIES]
        if isinstance(text, int) or str(text).isdigit():
            return order[int(text)] if int(text) < len(order) else None
        return next((m for m in cls if m.value.lower() == str(text).strip().lower()), None)

    @property
    def number(self) -> int:
        return [StepType.SQL, StepType.SCRIPT, StepType.CONDITION, StepType.VARIABLE, StepType.SERIES].index(self)


@dataclass(frozen=True)
class EngineOptions:
    """Global feature flags, off by default, and where the store lies."""

    root: str | None = None
    embeddings: bool = False
    timeseries: bool = False
    change_tracking: bool = False
    integrity: bool = False
    calculations: bool = False
    changed_by: str = "System"
    #: Where results follow the store this engine succeeds to the letter rather than its intent (see README).
    compat: bool = False

    def with_all(self) -> "EngineOptions":
        return replace(self, embeddings=True, timeseries=True, change_tracking=True, integrity=True, calculations=True)


_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")


def check_table_name(name: str) -> str:
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise ValueError(f"Invalid table name: {name!r}")
    return name
