"""KQL: the AND-only metadata filter language, compiled to one Catalyst predicate."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field names with their column and class.
FIELDS = {
    "embodiment": ("embodiment", "text"), "task": ("language_instruction", "text"), "num_frames": ("num_frames", "number"), "action_dim": ("action_dim", "number"),
    "fps": ("fps", "number"), "total_reward": ("total_reward", "reward"), "success": ("success", "flag"),
}
_SCAN = re.compile(r"""(?P<str>'[^']*'?|"[^"]*"?)|(?P<op>[!<>]=|[=<>])|(?P<num>-?[0-9][0-9.]*)|(?P<word>[^\W\d][\w]*)|(?P<skip>.)""", re.S)
EPS = 1e-6
#: Fields of integers.
WHOLE = {"num_frames", "action_dim"}


class KqlParseError(ValueError):
    """A query that doesn't parse: ``kind``, and the character ``position`` where it is noticed."""

    def __init__(self, kind: str, position: int, detail: str = ""):
        self.kind, self.position, self.detail = kind, position, detail
        super().__init__(f"{kind} at position {position}" + (f": {detail}" if detail else ""))


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: str | int | float | bool | None


def _value(kind: str, raw: str, at: int):
    if kind == "str":
        return raw[1:-1]
    if kind == "num":
        try:
            n = float(raw) if "." in raw else int(raw)
        except ValueError:
            raise KqlParseError("InvalidNumber", at, raw) from None
        if isinstance(n, int) and not -(1 << 63) <= n < 1 << 63:
            raise KqlParseError("InvalidNumber", at, raw)
        return n + 0.0 if isinstance(n, float) else n  # one zero only
    return {"true": True, "false": False, "null": None, "none": None}.get(raw.lower(), raw)


def parse(query: str) -> list[Condition]:
    """The conditions of a query. Characters that begin no token are ignored."""
    query = query.strip()
    if not query:
        raise KqlParseError("EmptyQuery", 0)
    tokens = []
    for m in _SCAN.finditer(query):
        if m.lastgroup == "str" and (len(m[0]) < 2 or m[0][-1] != m[0][0]):
            raise KqlParseError("UnterminatedString", m.start())
        if m.lastgroup != "skip":
            tokens.append((m.lastgroup, m[0], m.start()))
    end, out, k = len(query.encode()), [], 0
    take = lambda: tokens[k] if k < len(tokens) else ("end", "", end)
    while True:
        kind, raw, at = take()
        if kind == "end":
            raise KqlParseError("UnexpectedEnd", at)
        if kind != "word":
            raise KqlParseError("ExpectedField", at, raw)
        if raw.lower() not in FIELDS:
            raise KqlParseError("UnknownField", at, raw)
        field, k = raw.lower(), k + 1
        kind, raw, at = take()
        if kind == "end":
            raise KqlParseError("UnexpectedEnd", at)
        if kind != "op" and raw.upper() != "CONTAINS":
            raise KqlParseError("ExpectedOperator", at, raw)
        op, k = raw.upper(), k + 1
        kind, raw, at = take()
        if kind == "end":
            raise KqlParseError("UnexpectedEnd", at)
        if kind == "op":
            raise KqlParseError("ExpectedValue", at, raw)
        out.append(Condition(field, op, _value(kind, raw, at)))
        k += 1
        kind, raw, at = take()
        if kind == "end":
            return out
        if raw.upper() != "AND":
            raise KqlParseError("ExpectedAnd", at, raw)
        k += 1


def _number(c: Column, op: str, v: float) -> Column:
    d, x = c.cast("double"), F.lit(float(v) + 0.0)
    test = {"=": F.abs(d - x) < EPS, "!=": F.abs(d - x) >= EPS, ">": d > x, "<": d < x, ">=": d >= x, "<=": d <= x}.get(op)
    # engines rank NaN above all numbers; in the language it satisfies nothing
    return F.lit(False) if test is None else F.coalesce(~F.isnan(d) & test, F.lit(False))


def _whole(c: Column, op: str, v: float) -> Column:
    """The same on an integer column, as comparisons that a scan can use."""
    if abs(v) >= 2.0**62:  # beyond all counts; a bound would overflow
        return _number(c, op, v)
    known, low, near = c.isNotNull(), math.floor(v), round(v)
    one = F.lit(near).cast("long") if abs(near - float(v)) < EPS else None
    bound = {">": lambda: c > F.lit(low).cast("long"), "<=": lambda: c <= F.lit(low).cast("long"), ">=": lambda: c >= F.lit(math.ceil(v)).cast("long"), "<": lambda: c < F.lit(math.ceil(v)).cast("long")}
    if op in bound:
        return known & bound[op]()
    if op == "=":
        return F.lit(False) if one is None else known & (c == one)
    return known if op == "!=" and one is None else known & (c != one) if op == "!=" else F.lit(False)


def predicate(c: Condition, strict_nulls: bool = True) -> Column:
    """A never-null boolean column for one condition; mismatched types are constant false."""
    name, kind = FIELDS[c.field]
    col, v, no = F.col(name), c.value, F.lit(False)
    numeric = isinstance(v, (int, float)) and not isinstance(v, bool)
    if kind == "text":
        if not isinstance(v, str):
            return no
        tests = {"=": col == v, "!=": col != v, "CONTAINS": F.contains(F.lower(col), F.lit(v.lower()))}
        return col.isNotNull() & tests[c.op] if c.op in tests else no
    if kind == "flag":
        if v is None:
            return {"=": col.isNull(), "!=": col.isNotNull()}.get(c.op, no)
        if not isinstance(v, bool):
            return no
        return {"=": col.isNotNull() & (col == v), "!=": ~col.eqNullSafe(F.lit(v))}.get(c.op, no)
    if kind == "reward" and v is None:
        return col.isNull() if c.op == "=" else col.isNotNull() if c.op == "!=" and not strict_nulls else no
    if not numeric:
        return no
    return _whole(col, c.op, v) if c.field in WHOLE else _number(col, c.op, v)


def compiled(query: str, strict_nulls: bool = True) -> Column:
    return reduce(lambda a, b: a & b, (predicate(c, strict_nulls) for c in parse(query)))
