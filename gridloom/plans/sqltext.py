"""SQL texts from users: parameters, what they read, and whether they only read."""

from __future__ import annotations

import datetime as dt
import decimal
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

#: Types a parameter may have.
PARAMETERS = (bool, int, float, decimal.Decimal, str, dt.datetime, dt.date, type(None))
#: Words that turn a text into more than a query.
COMMANDS = re.compile(r"\b(INSERT|UPDATE|DELETE|CREATE|DROP|ALTER|SET|WITH)\b", re.IGNORECASE)
#: Functions that reach beyond the data.
_REACHING = re.compile(r"\b(reflect|try_reflect|java_method|input_file_name)\s*\(", re.IGNORECASE)
_VARIABLE = re.compile(r"\{([^{}]+)\}")
_POSITION = re.compile(r"@p(\d+)\b")
#: Plans that read and nothing else.
_READING = {"Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Distinct", "Union", "Intersect", "Except", "Join", "SubqueryAlias", "UnresolvedWith", "UnresolvedHaving", "WithWindowDefinition", "Offset", "Limit", "UnresolvedSubqueryColumnAliases", "Pivot", "Unpivot", "UnresolvedInlineTable", "UnresolvedRelation", "OneRowRelation"}

ONLY_SELECT = "Only SELECT queries are allowed."
NO_MULTI = "Multi-statement queries or stored procedures are not allowed."


def plan_of(spark: SparkSession, sql: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def refuse(spark: SparkSession, sql: str, compat: bool = False) -> str | None:
    """Why a text isn't a query that only reads, or None. With `compat` words are refused wherever they stand."""
    if compat:
        if COMMANDS.search(sql):
            return ONLY_SELECT
        if ";" in sql or "exec" in sql.lower():
            return NO_MULTI
    if _REACHING.search(sql):
        return ONLY_SELECT
    try:
        top = plan_of(spark, sql).getClass().getSimpleName().rstrip("$")
    except Exception as e:
        bare = re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", sql)
        if ";" in bare.rstrip().rstrip(";"):
            return NO_MULTI
        if COMMANDS.match(sql.strip()):
            return ONLY_SELECT
        return f"Invalid SQL query: {str(e).splitlines()[0]}"
    return None if top in _READING else ONLY_SELECT


def bind(text: str, context: Mapping[str, object]) -> tuple[str, dict[str, object]]:
    """The text with `{name}` as named parameters, and their values; an unknown name is the empty text."""
    args: dict[str, object] = {}

    def put(m: re.Match) -> str:
        name = f"p{len(args)}"
        args[name] = context.get(m[1].strip(), "")
        return f":{name}"

    return _VARIABLE.sub(put, text), args


def query(spark: SparkSession, sql: str, params: Mapping[str, object] | Sequence[object] = ()) -> DataFrame:
    """Rows of a text with parameters by name (`:name`) or position (`@p0`, `:p0`). Nothing runs yet."""
    args = dict(params) if isinstance(params, Mapping) else {f"p{i}": v for i, v in enumerate(params)}
    for k, v in args.items():
        if not isinstance(v, PARAMETERS):
            raise TypeError(f"Unsupported parameter type {type(v).__name__} for SQL query.")
    return spark.sql(_POSITION.sub(r":p\1", sql), args=args)


def variables(text: str) -> list[str]:
    return [m.strip() for m in _VARIABLE.findall(text)]


def _each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _nodes(plan) -> list:
    """All nodes of a parsed plan, those of subqueries and of WITH, too."""
    found, left = [], [plan]
    while left:
        node = left.pop()
        found.append(node)
        left += _each(node.children()) + _each(node.subqueries())
        if _kind(node) == "UnresolvedWith":
            left += [c._2() for c in _each(node.cteRelations())]
    return found


def relations(spark: SparkSession, sql: str) -> set[str]:
    """Names of all relations a query reads, but those it defines itself; a name of several parts is given whole."""
    return _relations(_nodes(plan_of(spark, sql)))


def _relations(nodes: list) -> set[str]:
    own = {c._1().lower() for n in nodes if _kind(n) == "UnresolvedWith" for c in _each(n.cteRelations())}
    names = {".".join(_each(n.multipartIdentifier())) for n in nodes if _kind(n) == "UnresolvedRelation"}
    return {n for n in names if n.lower() not in own}


def tables_and_columns(spark: SparkSession, sql: str, schemas: Mapping[str, Sequence[str]] | None = None) -> tuple[set[str], list[tuple[str, str | None]]]:
    """The relations a query reads, and each with the columns it mentions of it (None: any, as of a star or a mere count).

    A column with a qualifier belongs to the relation of that name or alias; one without to the relations whose `schemas` (by
    name in lower case) have it, or, where one's schema isn't known, to that one as well.
    """
    nodes = _nodes(plan_of(spark, _POSITION.sub(r":p\1", bind(sql, {})[0])))
    tables = _relations(nodes)
    schemas = {k: {c.lower() for c in v} for k, v in (schemas or {}).items()}
    alias: dict[str, set[str]] = {}
    for t in tables:
        alias.setdefault(t.lower(), set()).add(t)
    others: set[str] = set()
    for n in nodes:
        if _kind(n) == "SubqueryAlias":
            name, child = n.alias().lower(), n.child()
            inner = ".".join(_each(child.multipartIdentifier())) if _kind(child) == "UnresolvedRelation" else None
            if inner in tables:
                alias.setdefault(name, set()).add(inner)
            else:
                others.add(name)
    pairs: set[tuple[str, str | None]] = set()
    left = [x for n in nodes for x in _each(n.expressions())]
    while left:
        x = left.pop()
        kind = _kind(x)
        if kind == "UnresolvedStar":
            pairs |= {(t, None) for t in tables}
        elif kind == "UnresolvedAttribute":
            parts = _each(x.nameParts())
            c = parts[-1]
            if len(parts) > 1 and parts[-2].lower() in alias:
                pairs |= {(t, c) for t in alias[parts[-2].lower()]}
            elif len(parts) == 1 or parts[-2].lower() not in others:
                pairs |= {(t, c) for t in tables if c.lower() in schemas.get(t.lower(), (c.lower(),))}
        left += _each(x.children())
    pairs |= {(t, None) for t in tables if not any(p[0] == t for p in pairs)}
    return tables, sorted(pairs, key=lambda p: (p[0], p[1] or ""))


def tables_and_aggregates(sql: str) -> list[tuple[str, str]]:
    """Fixed behaviour of `compat`, which must find what the succeeded store finds: words after FROM and JOIN, each with every word in AVG, SUM, COUNT, MIN or MAX of one word."""
    tables = list(dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+\[?(\w+)\]?", sql, re.IGNORECASE)))
    columns = list(dict.fromkeys(re.findall(r"\b(?:AVG|SUM|COUNT|MIN|MAX)\s*\(\s*\[?(\w+)\]?\s*\)", sql, re.IGNORECASE)))
    return [(t, c) for t in tables for c in columns]
