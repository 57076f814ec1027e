"""WHERE predicates as Columns, so that Catalyst pushes them into the scan.

A logical column is a mapping of kinds to physical columns: ``i`` (long), ``d``
(decimal(38,6)), ``t`` (string), ``b`` (binary); at most one is set in a row.
Predicates are two-valued.  There is no general NOT in the dialect, so a null of Spark
accepts the same rows as false and comparisons are left bare: a coalesce around them
would keep them from being pushed down.
"""

from __future__ import annotations

from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.plans import ast
from tidemark.plans.lexer import I64

RANK = {"i": 1, "d": 2, "t": 3, "b": 4}
Kinds = dict[str, Column]


def kind_of(value: ast.Value) -> str | None:
    if value is None:
        return None
    return "i" if isinstance(value, int) else "d" if isinstance(value, Decimal) else "t" if isinstance(value, str) else "b"


def literal(value: ast.Value) -> Column:
    if isinstance(value, Decimal):
        return F.lit(str(value)).cast("decimal(38,6)")
    if isinstance(value, int):
        return F.lit(value).cast("long")
    return F.lit(value)


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def present(c: Kinds) -> Column:
    return any_of([x.isNotNull() for x in c.values()])


def _equal_parts(c: Kinds, value: ast.Value) -> list[tuple[Column, ast.Value]]:
    """Physical columns and the literals of their own type that equal the value by magnitude."""
    kind = kind_of(value)
    if kind in ("i", "d"):
        out = []
        if "i" in c and value == int(value) and I64[0] <= value <= I64[1]:
            out.append((c["i"], int(value)))
        if "d" in c and abs(value) < Decimal(10) ** 32:
            out.append((c["d"], Decimal(value)))
        return out
    return [(c[kind], value)] if kind in c else []


def equals(c: Kinds, value: ast.Value) -> Column:
    if value is None:
        return ~present(c)
    return any_of([x == literal(v) for x, v in _equal_parts(c, value)])


def differs(c: Kinds, value: ast.Value) -> Column:
    if value is None:
        return present(c)
    parts = _equal_parts(c, value)
    return reduce(lambda a, b: a & b, [~x.eqNullSafe(literal(v)) for x, v in parts]) if parts else F.lit(True)


def _whole(value: int | Decimal, op: str) -> tuple[str, int] | bool:
    """An ordering of longs against a number as one against a long, or a constant."""
    if value == int(value):
        bound = int(value)
    elif op in ("<", "<="):
        op, bound = "<=", int(Decimal(value).to_integral_value(ROUND_FLOOR))
    else:
        op, bound = ">=", int(Decimal(value).to_integral_value(ROUND_CEILING))
    if bound > I64[1]:
        return op in ("<", "<=")
    if bound < I64[0]:
        return op in (">", ">=")
    return op, bound


def _apply(x: Column, op: str, y: Column) -> Column:
    return x < y if op == "<" else x <= y if op == "<=" else x > y if op == ">" else x >= y


def ordered(c: Kinds, op: str, value: ast.Value) -> Column:
    """Numbers by magnitude, other kinds by rank; false if either side is null."""
    kind = kind_of(value)
    if kind is None:
        return F.lit(False)
    parts = []
    for k, x in c.items():
        if k == "i" and kind in ("i", "d"):
            found = _whole(value, op)
            parts.append(found if isinstance(found, bool) else _apply(x, found[0], literal(found[1])))
        elif k == "d" and kind in ("i", "d"):
            parts.append(_apply(x, op, literal(Decimal(value))))
        elif k == kind:
            parts.append(_apply(x, op, literal(value)))
        else:
            parts.append((RANK[k] < RANK[kind]) == (op in ("<", "<=")))
        if parts[-1] is True:
            parts[-1] = x.isNotNull()
    return any_of([p for p in parts if p is not False])


def like(c: Kinds, pattern: ast.Value, negated: bool) -> Column:
    """Only texts match or don't; the dialect has no escape, so one is chosen that the pattern doesn't hold."""
    if "t" not in c or not isinstance(pattern, str):
        return F.lit(False)
    escape = next(e for e in "|~^!@#\x01\x02\x03\x04\x05\x06\x07" + "".join(map(chr, range(0x2500, 0x2500 + len(pattern) + 1))) if e not in pattern)
    found = F.like(c["t"], F.lit(pattern), F.lit(escape))
    return ~found if negated else found


def within(c: Kinds, values: tuple[ast.Value, ...], negated: bool) -> Column:
    if negated and None in values:
        return F.lit(False)
    by: dict[str, tuple[Column, list[Column]]] = {}
    for v in values:
        for x, own in _equal_parts(c, v) if v is not None else []:
            k = next(k for k in c if c[k] is x)
            by.setdefault(k, (x, []))[1].append(literal(own))
    parts = [x.isin(found) for x, found in by.values()]
    if not negated:
        return any_of(parts)
    if not parts:
        return present(c)
    return ~parts[0] if len(c) == 1 else present(c) & ~F.coalesce(any_of(parts), F.lit(False))


def between(c: Kinds, low: ast.Value, high: ast.Value, negated: bool) -> Column:
    """A null bound is the least value of all: nothing is below it, everything at or above."""
    if high is None:
        return present(c) if negated else F.lit(False)
    upper = ordered(c, "<=", high)
    inside = upper if low is None else ordered(c, ">=", low) & upper
    return inside if not negated else present(c) & ~F.coalesce(inside, F.lit(False))


def compare(c: Kinds, op: str, value: ast.Value) -> Column:
    if op == "=":
        return equals(c, value)
    if op == "!=":
        return differs(c, value)
    if op in ("like", "not_like"):
        return like(c, value, op == "not_like")
    return ordered(c, op, value)


def compile_predicate(p: object, resolve) -> Column:
    """``resolve`` gives the kinds of a name (or of a HAVING term), or raises."""
    match p:
        case ast.And(left, right):
            return compile_predicate(left, resolve) & compile_predicate(right, resolve)
        case ast.Or(left, right):
            return compile_predicate(left, resolve) | compile_predicate(right, resolve)
        case ast.Compare(column, op, value):
            return compare(resolve(column), op, value)
        case ast.HavingCompare(term, op, value):
            return compare(resolve(term), op, value)
        case ast.InList(column, values, negated):
            return within(resolve(column), values, negated)
        case ast.Between(column, low, high, negated):
            return between(resolve(column), low, high, negated)
        case ast.IsNull(column, negated):
            return present(resolve(column)) if negated else ~present(resolve(column))
    raise TypeError(p)
