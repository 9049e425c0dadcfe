"""Analytics programs: ordered steps, run one after another over a context of variables.

The interpreter runs on the driver; rows stay DataFrames until a scalar is needed. Script, variable and condition steps hold
a Spark SQL expression over `{variables}` (earlier row results are views of their name), or `py:name`, a registered
Python function of the context.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.stringify import stringify
from gridloom.operators.series import read_expression
from gridloom.options import StepType
from gridloom.plans import sqltext

MAX_LOOP = 10
_INDEX = re.compile(r"(\w+)\[(\d+|\{\w+\})\]")
_POSITIONAL = re.compile(r"\{([^{}]+)\}")


@dataclass
class Step:
    type: StepType | str
    config: str
    output: str = ""
    max_loop: int = MAX_LOOP

    @property
    def kind(self) -> StepType | None:
        return self.type if isinstance(self.type, StepType) else StepType.parse(self.type)

    @property
    def name(self) -> str:
        return self.type.value if isinstance(self.type, StepType) else str(self.type)


@dataclass
class Program:
    name: str
    steps: list[Step] = field(default_factory=list)
    interval: int = 0
    embeddable: bool = False
    id: str = ""

    def to_json(self) -> str:
        steps = [{"Type": s.kind.number if s.kind else s.name, "Config": s.config, "OutputVariable": s.output, "MaxLoop": s.max_loop} for s in self.steps]
        return json.dumps({"Id": self.id, "Name": self.name, "Interval": self.interval, "Embeddable": self.embeddable, "Steps": steps}, indent=2, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> "Program":
        """A program of a JSON text; step types by number or name."""
        try:
            d = json.loads(text)
        except ValueError:
            d = None
        if not isinstance(d, dict) or not d.get("Name"):
            raise ValueError("Invalid JSON format for analytics import.")
        steps = [Step(StepType.parse(s.get("Type", 0)) or str(s.get("Type")), s.get("Config") or "", s.get("OutputVariable") or "", s.get("MaxLoop", MAX_LOOP)) for s in d.get("Steps") or []]
        return cls(d["Name"], steps, int(d.get("Interval") or 0), bool(d.get("Embeddable")), str(d.get("Id") or ""))


class Scripts:
    """Python functions that programs may name."""

    def __init__(self) -> None:
        self._by_name: dict[str, Callable[[dict], object]] = {}

    def register(self, name: str, f: Callable[[dict], object]) -> None:
        self._by_name[name] = f

    def get(self, expression: str) -> Callable[[dict], object] | None:
        if not expression.startswith("py:"):
            return None
        name = expression[3:].strip()
        if name not in self._by_name:
            raise KeyError(f"no registered function {name}")
        return self._by_name[name]


def evaluate(spark: SparkSession, expression: str, context: dict, scripts: Scripts) -> object:
    """The value of a script over the context."""
    f = scripts.get(expression)
    if f:
        return f(context)
    text, args = sqltext.bind(_elements(expression, context), context)
    why = sqltext.refuse(spark, f"SELECT {text} AS v")
    if why:
        raise ValueError(f"script: {why}")
    return sqltext.query(spark, f"SELECT {text} AS v", args).first()[0]


def _elements(expression: str, context: Mapping) -> str:
    """`{name[i]}` of list variables as variables of their own."""

    def put(m: re.Match) -> str:
        i = _INDEX.fullmatch(m[1])
        if not i or i[1] not in context:
            return m[0]
        n = int(i[2]) if i[2].isdigit() else int(context[i[2].strip("{}")])
        values = context[i[1]]
        context[m[1]] = values[n] if isinstance(values, list) and n < len(values) else None
        return m[0]

    return _POSITIONAL.sub(put, expression)


def bind_result(context: dict, name: str, value: object) -> None:
    """Set a variable, or the element of a list one (`name[3]`, `name[{i}]`), which grows with nulls."""
    m = _INDEX.fullmatch(name)
    if not m:
        context[name] = value
        return
    at = int(m[2]) if m[2].isdigit() else int(context[m[2].strip("{}")])
    values = context.get(m[1])
    if not isinstance(values, list):
        values = context[m[1]] = []
    values += [None] * (at + 1 - len(values))
    values[at] = value


def run(spark: SparkSession, steps: list[Step], samples: Callable[[], DataFrame], context: dict | None = None, scripts: Scripts | None = None, compat: bool = False) -> str:
    """The text of the last step's value.

    A condition that holds jumps to the step its output names (1 to n, not itself), at most max_loop times; then, or
    if it doesn't hold, the next step follows. Rows: the column named as the output if there is one, else the first, of
    the first row. Series: the last value. Otherwise the bound variable, or the last result.
    """
    context, scripts = {} if context is None else context, scripts or Scripts()
    jumps: dict[int, int] = {}
    at, result, last = 0, None, None
    while at < len(steps):
        step = steps[at]
        kind = step.kind
        if kind is StepType.CONDITION:
            last = None
            if jumps.get(at, 0) < step.max_loop:
                holds = evaluate(spark, step.config, context, scripts)
                if not isinstance(holds, bool):
                    raise ValueError(f"Condition step {at + 1} must return a boolean value.")
                result = holds
                if holds and step.output.strip().isdigit() and 1 <= int(step.output) <= len(steps) and int(step.output) != at + 1:
                    jumps[at] = jumps.get(at, 0) + 1
                    at = int(step.output) - 1
                    continue
            at += 1
            continue
        if kind is StepType.SQL:
            text, args = sqltext.bind(_elements(step.config, context), context)
            result = sqltext.query(spark, text, args)
        elif kind is StepType.SERIES:
            parts = [str(context[m[1].strip()]) if (m := _POSITIONAL.fullmatch(p.strip())) and m[1].strip() in context else p for p in step.config.split(",")]
            for p in parts:
                if _POSITIONAL.fullmatch(p.strip()):
                    raise ValueError(f"Missing parameter for {p.strip()}")
            result = read_expression(samples(), ",".join(parts), compat=compat)
        elif kind in (StepType.SCRIPT, StepType.VARIABLE):
            result = evaluate(spark, step.config, context, scripts)
        else:
            raise ValueError(f"Unsupported step type: {step.name}")
        if step.output:
            bind_result(context, step.output, result)
            if isinstance(result, DataFrame) and re.fullmatch(r"\w+", step.output):
                result.createOrReplaceTempView(step.output)
        last = step
        at += 1
    return _final(result, last, context)


def _final(result: object, step: Step | None, context: dict) -> str:
    if isinstance(result, DataFrame):
        if step is not None and step.kind is StepType.SERIES:
            row = result.agg(F.max_by("Value", "Timestamp")).first()
            return stringify(row[0])
        row = result.limit(1).first()
        if row is None:
            return ""
        name = step.output if step is not None and step.output in row.__fields__ else None
        return stringify(row[name] if name else row[0])
    if step is not None and step.output and step.output in context:
        return stringify(context[step.output])
    return stringify(result)
