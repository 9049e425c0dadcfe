"""What is wrong with a program, without running its queries."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from gridloom.operators.series import parse_expression
from gridloom.options import Interpolation, StepType
from gridloom.plans import sqltext
from gridloom.plans.program import _INDEX, Program, Scripts, Step, evaluate

NO_STEPS = "Analytics must have at least one step."


def _series_problem(text: str) -> str | None:
    parts = text.split(",")
    if not 5 <= len(parts) <= 7:
        return "Timeseries expression must have 5 to 7 components: tableName,entityId,propertyName,start,end[,interval,method]"
    if len(parts) > 6:
        try:
            Interpolation.parse(parts[6])
        except ValueError:
            return "Invalid interpolation method in timeseries expression."
    try:
        parse_expression(re.sub(r"\{[^{}]*\}", "2000-01-01", text))
    except ValueError as e:
        return "Invalid interval format in timeseries expression." if "interval" in str(e) else str(e)
    return None


def check(spark: SparkSession, program: Program, schemas: dict[str, StructType], scripts: Scripts | None = None, orders: list[int] | None = None, compat: bool = False) -> list[str]:
    """All errors of a program, in order of steps; none if it can run.

    `schemas`: the user tables. Queries are analyzed by Spark, not run; scripts run over simulated variables.
    """
    scripts = scripts or Scripts()
    if not program.steps:
        return [NO_STEPS]
    known = {t.lower(): s for t, s in schemas.items()}
    errors: list[str] = []
    defined: set[str] = set()
    context: dict = {}
    n = len(program.steps)
    for i, s in enumerate(program.steps):
        order = orders[i] if orders else i + 1
        say = lambda text: errors.append(f"Step {order} ({s.name}): {text}")  # noqa: B023, E731
        where = f" in expression '{s.config}'"
        if order != i + 1:
            say(f"Incorrect order {order}. Expected {i + 1}.")
        if s.kind is None:
            say(f"Invalid step type {s.name}.")
        if not s.config:
            say("Expression cannot be null or empty.")
            continue
        if s.kind in (StepType.SCRIPT, StepType.CONDITION) and i > 0:
            for v in sqltext.variables(s.config):
                if v.split("[")[0] not in defined:
                    say(f"Unknown variable {v}{where}. Ensure it is defined in a previous step or provided at runtime.")
        indexed = _INDEX.fullmatch(s.output or "")
        if indexed and s.kind is not StepType.CONDITION and i > 0 and indexed[1] not in defined:
            say(f"Array {indexed[1]} must be defined before index access{where}.")
        if s.kind is StepType.SQL:
            for text in _sql_problems(spark, s, known, defined, compat):
                say(f"{text}{where}")
        elif s.kind is StepType.SERIES:
            why = _series_problem(s.config)
            if why:
                say(f"{why}{where}")
            if s.config.split(",")[0].strip().lower() not in known:
                say(f"Invalid table reference {s.config.split(',')[0].strip()}{where}.")
        elif s.kind in (StepType.SCRIPT, StepType.VARIABLE, StepType.CONDITION):
            label = "Condition" if s.kind is StepType.CONDITION else s.name
            try:
                value = evaluate(spark, s.config, dict(context), scripts)
                if s.kind is StepType.CONDITION and not isinstance(value, bool) and not _open(s, context):
                    say(f"Condition script must return a boolean value{where}")
                elif s.kind is not StepType.CONDITION and value is not None and s.output and not indexed:
                    context[s.output] = value
            except Exception as e:
                if not _open(s, context):
                    say(f"{label} script validation failed: {str(e).splitlines()[0]}{where}")
        if s.kind is StepType.CONDITION:
            if not (s.output or "").strip().isdigit() or not 1 <= int(s.output) <= n or int(s.output) == i + 1:
                say(f"Invalid GoTo step number {s.output}. Must be between 1 and {n}, not current step{where}.")
            if s.max_loop <= 0:
                say(f"MaxLoop must be positive{where}.")
        elif i == n - 1 and not s.output and s.kind in (StepType.SERIES, StepType.SCRIPT, StepType.VARIABLE):
            say(f"Last {s.name} step must have a ResultVariable{where}.")
        if s.kind is not StepType.CONDITION and s.output:
            name = indexed[1] if indexed else s.output
            defined.add(name)
            context.setdefault(name, [] if indexed else 0 if s.kind is StepType.VARIABLE else None)
    return errors


def _open(s: Step, context: dict) -> bool:
    """Whether a script depends on values that are known only when the program runs."""
    names = [v.split("[")[0] for v in sqltext.variables(s.config)]
    return s.config.startswith("py:") or any(context.get(v) is None or isinstance(context.get(v), list) for v in names) or bool(re.search(r"\bFROM\b", s.config, re.IGNORECASE))


def _sql_problems(spark: SparkSession, s: Step, known: dict[str, StructType], defined: set[str], compat: bool) -> list[str]:
    text, args = sqltext.bind(s.config, {})
    why = sqltext.refuse(spark, text, compat)
    if why:
        return [why]
    if compat:
        out = []
        for t, c in sqltext.tables_and_aggregates(s.config):
            if t.lower() not in known:
                out.append(f"Invalid table reference {t}")
            elif c.lower() not in {x.lower() for x in known[t.lower()].names}:
                out.append(f"Property {c} does not exist on table {t}")
        return out
    tables = sqltext.relations(spark, text)
    unknown = [t for t in sorted(tables) if t.lower() not in known and t not in defined]
    if unknown:
        return [f"Invalid table reference {t}" for t in unknown]
    if tables & defined:
        return []  # results of earlier steps have columns only when they run
    try:
        probe = spark.newSession()  # views of its own, so none of the caller's is hidden
        for t in tables:
            probe.createDataFrame([], known[t.lower()]).createOrReplaceTempView(t)
        probe.sql(text, args={k: None for k in args})
    except Exception as e:
        lost = re.search(r"column, variable, or function parameter with name `([^`]+)`|with name (`[^ ]+`)", str(e))
        name = (lost[1] or lost[2]).strip("`").split("`.`")[-1] if lost else None
        return [f"Property {name} does not exist on table {', '.join(sorted(tables))}" if name else f"Invalid SQL query: {str(e).splitlines()[0]}"]
    return []
