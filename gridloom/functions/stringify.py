"""Values as the texts a program's result is stored as."""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math


def stringify(v: object) -> str:
    """Null as the empty text, truth as True / False, whole doubles without a fraction, instants as ISO texts."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "True" if v else "False"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if math.isinf(v):
            return "∞" if v > 0 else "-∞"
        if v == int(v) and abs(v) < 1e15:
            return str(int(v))
        return repr(v).replace("e", "E")
    if isinstance(v, decimal.Decimal):
        return format(v, "f")
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, (list, tuple, dict)):
        return json.dumps(v, default=str, ensure_ascii=False)
    return str(v)
