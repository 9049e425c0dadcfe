"""Columns for the spellings the store uses: guids, JSON texts, decimal numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 8-4-4-4-12 form of a guid.
GUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
#: A plain or exponent decimal number with either decimal sign.
NUMBER = r"^[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?$"
#: White space that may stand around a number.
BLANKS = " \t\r\n\f\x0b\xa0"


def fold_guid(c: Column) -> Column:
    """A guid in lower case; any other text as it is."""
    return F.when(c.rlike(GUID), F.lower(c)).otherwise(c)


def json_value(c: Column) -> Column:
    """The value of a JSON text as text: strings unescaped, JSON null as null.

    Objects and arrays come out as their JSON text. A text that is no JSON stands for itself.
    """
    wrapped = F.concat(F.lit("["), c, F.lit("]"))
    decoded = F.get_json_object(wrapped, "$[0]")
    # Most texts are strings without an escape: those need no parser.
    plain = F.regexp_extract(c, r'^\s*"([^"\\]*)"\s*$', 1)
    return (
        F.when(c.rlike(r'^\s*"[^"\\]*"\s*$'), plain)
        .when(F.trim(c) == "null", F.lit(None).cast("string"))
        .when(decoded.isNotNull(), decoded)
        .otherwise(c)
    )


def number(c: Column) -> Column:
    """The number a text stands for, or null: trimmed, `.` or `,` as decimal sign, optional sign and exponent.

    A number beyond the range of a double is none.
    """
    t = F.trim(F.translate(c, BLANKS[1:], " " * (len(BLANKS) - 1)))
    v = F.translate(t, ",", ".").try_cast("double")
    return F.when(t.rlike(NUMBER) & (F.abs(v) < float("inf")), v)
