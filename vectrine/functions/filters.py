"""Metadata filters: a tree of eleven operators compiled to one Column.

Logic is two-valued: a missing field is unequal to everything and in no range. Outside of any
negation a leaf may stay null (a filter drops it as it drops false), which lets the scan use
predicates on promoted columns; under a negation it is made false first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from vectrine.schema import DomainError, check, kind_of, literal, scalar_key, scalar_num

COMPARE = {"greaterThan": "gt", "greaterThanOrEqual": "ge", "lessThan": "lt", "lessThanOrEqual": "le"}
MAXIMUM_DEPTH = 32


@dataclass(frozen=True)
class Filter:
    operator: str
    field: str | None = None
    value: object = None
    values: Sequence[object] | None = None
    operands: Sequence["Filter"] = ()
    has_value: bool = True


def equal(name: str, value: object) -> Filter:
    return Filter("equal", name, value)


def not_equal(name: str, value: object) -> Filter:
    return Filter("notEqual", name, value)


def gt(name: str, value: object) -> Filter:
    return Filter("greaterThan", name, value)


def gte(name: str, value: object) -> Filter:
    return Filter("greaterThanOrEqual", name, value)


def lt(name: str, value: object) -> Filter:
    return Filter("lessThan", name, value)


def lte(name: str, value: object) -> Filter:
    return Filter("lessThanOrEqual", name, value)


def is_in(name: str, values: Sequence[object]) -> Filter:
    return Filter("in", name, values=tuple(values))


def exists(name: str) -> Filter:
    return Filter("exists", name)


def both(*operands: Filter) -> Filter:
    return Filter("and", operands=operands)


def either(*operands: Filter) -> Filter:
    return Filter("or", operands=operands)


def negate(operand: Filter) -> Filter:
    return Filter("not", operands=(operand,))


def validate(root: Filter, depth: int = MAXIMUM_DEPTH) -> None:
    stack = [(root, 1)]
    while stack:
        f, d = stack.pop()
        check(d <= depth, "invalid_filter", f"deeper than {depth}")
        if f.operator in ("and", "or"):
            check(len(f.operands) >= 2, "invalid_filter", f"{f.operator} needs two operands")
        elif f.operator == "not":
            check(len(f.operands) == 1, "invalid_filter", "not needs one operand")
        elif f.operator in ("equal", "notEqual", "in", "exists", *COMPARE):
            check(bool(f.field and f.field.strip()), "invalid_filter", "a field is required")
            check(f.operator != "in" or bool(f.values), "invalid_filter", "in needs values")
            check(f.has_value, "invalid_filter", "a value is required")
        else:
            raise DomainError("invalid_filter", f.operator)
        stack += [(x, d + 1) for x in f.operands]


def compile_filter(root: Filter | None, metadata: str = "metadata", promoted: Mapping[str, tuple[str, str]] | None = None, depth: int = MAXIMUM_DEPTH) -> Column:
    """Column of a filter. ``promoted`` maps a field to (kind, column) where it is a column of its own
    (null where absent): such a leaf compiles to a predicate that the scan can push down."""
    if root is None:
        return F.lit(True)
    validate(root, depth)
    return _compile(root, metadata, promoted or {}, False)


def _compile(f: Filter, m: str, promoted: Mapping[str, tuple[str, str]], negated: bool) -> Column:
    op = f.operator
    if op in ("and", "or"):
        parts = [_compile(x, m, promoted, negated) for x in f.operands]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if op == "and" else out | p
        return out
    if op == "not":
        return ~_compile(f.operands[0], m, promoted, True)
    if op == "notEqual":
        return ~_compile(Filter("equal", f.field, f.value), m, promoted, True)
    leaf = _promoted(f, *promoted[f.field]) if f.field in promoted else _leaf(f, F.col(m)[f.field], m)
    return F.coalesce(leaf, F.lit(False)) if negated else leaf


def _leaf(f: Filter, value: Column, m: str) -> Column:
    if f.operator == "exists":
        return F.map_contains_key(F.col(m), F.lit(f.field))
    if f.operator == "equal":
        return F.array_contains(value["keys"], scalar_key(f.value))
    if f.operator == "in":
        return F.arrays_overlap(value["keys"], F.array(*[scalar_key(v) for v in f.values]))
    target = scalar_num(f.value)
    return F.lit(False) if target is None else F.exists(value["nums"], lambda x: _compare(f.operator, x, target))


def _compare(op: str, x: Column, y: Column) -> Column:
    return {"gt": x > y, "ge": x >= y, "lt": x < y, "le": x <= y}[COMPARE[op]]


def _promoted(f: Filter, kind: str, column: str) -> Column:
    c = F.col(column)
    if f.operator == "exists":
        return c.isNotNull()
    if f.operator == "equal":
        return c == literal(f.value) if kind_of(f.value) == kind else F.lit(False) & c.isNotNull()
    if f.operator == "in":
        same = [v for v in f.values if kind_of(v) == kind]
        return c.isin([v for v in same]) if same else F.lit(False) & c.isNotNull()
    target = scalar_num(f.value)
    if target is None or kind not in ("integral", "number", "datetime"):
        return F.lit(False)
    if kind == kind_of(f.value) == "datetime":
        return _compare(f.operator, c, literal(f.value))
    if kind == "datetime" or kind_of(f.value) == "datetime":
        from vectrine.schema import ticks

        return _compare(f.operator, (ticks(c) if kind == "datetime" else c).cast("double"), target)
    return _compare(f.operator, c, F.lit(f.value)) if abs(f.value) < 1 << 53 else _compare(f.operator, c.cast("double"), target)
