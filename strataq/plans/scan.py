"""Scan plans: ordered projection, AND-ed tests, a sort-key range, a limit.

A plan names fields by id.  ``resolve`` checks it against a schema and a layout and
turns it into columns; nothing is read before every rule holds.
"""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataq import schema as S
from strataq.errors import Invalid
from strataq.functions.compare import OPS, compare, is_nan, lexicographic
from strataq.layout import Layout


@dataclass(frozen=True)
class Test:
    """``field op value``; ``is_null`` and ``is_not_null`` take no value."""

    __test__ = False  # not a test case

    field: int
    op: str
    value: object = None


@dataclass(frozen=True)
class KeyRange:
    """Bounds over the whole sort key in lexicographic order; ``[lower, upper)`` by
    default, either side open if None."""

    lower: tuple | None = None
    upper: tuple | None = None
    lower_inclusive: bool = True
    upper_inclusive: bool = False


@dataclass(frozen=True)
class Scan:
    project: tuple[int, ...]
    tests: tuple[Test, ...] = ()
    key_range: KeyRange | None = None
    limit: int | None = None
    batch_rows: int = 65_536


_INTS = {"int8": 7, "int16": 15, "int32": 31, "int64": 63}


def fits(kind: str, value: object) -> bool:
    """Whether a Python value is of a kind exactly; nothing is cast for the caller."""
    if kind == "bool":
        return isinstance(value, bool)
    if isinstance(value, bool):
        return False
    if kind in _INTS:
        return isinstance(value, int) and -(2 ** _INTS[kind]) <= value < 2 ** _INTS[kind]
    if kind in S.INTEGERS:
        low, high = S.limits(kind)
        return isinstance(value, int) and low <= value <= high
    if kind in S.FLOATS:
        return isinstance(value, float)
    if kind == "string":
        return isinstance(value, str)
    if kind == "binary":
        return isinstance(value, (bytes, bytearray))
    if kind.startswith("timestamp[ns"):
        return isinstance(value, int) and -(2**63) <= value < 2**63
    zoned = "," in kind
    return isinstance(value, datetime.datetime) and (value.tzinfo is not None) == zoned


def literal(kind: str, value: object) -> Column:
    if kind == "uint64":
        value = decimal.Decimal(value)
    if kind == "binary":
        value = bytearray(value)
    return F.lit(value).cast(S.spark_type(kind))


def _rank(schema: S.Schema, t: Test) -> tuple[int, int]:
    """Selective and narrow tests first: equality and null, then order, then the rest."""
    by_op = {"eq": 0, "is_null": 0, "ne": 2, "is_not_null": 3}.get(t.op, 1)
    return by_op, int(schema.by_id(t.field).kind in S.VARIABLE)


@dataclass(frozen=True)
class Resolved:
    """A checked plan.  ``filter_ids`` are the fields that tests and range read."""

    schema: S.Schema
    layout: Layout
    plan: Scan
    tests: tuple[Test, ...]
    filter_ids: tuple[int, ...]

    def test_column(self, t: Test, c: Column | None = None) -> Column:
        kind = self.schema.by_id(t.field).kind
        c = F.col(S.column(t.field)) if c is None else c
        if t.op in ("is_null", "is_not_null"):
            return compare(c, t.op)
        return compare(c, t.op, literal(kind, t.value), kind in S.FLOATS, is_nan(t.value))

    def bounds(self, side: str) -> tuple[list[Column], bool] | None:
        r = self.plan.key_range
        values = getattr(r, side) if r else None
        if values is None:
            return None
        return [literal(self.schema.by_id(i).kind, v) for i, v in zip(self.layout.sort_key, values)], getattr(r, f"{side}_inclusive")

    def range_column(self, columns: list[Column] | None = None) -> Column | None:
        columns = columns or [F.col(S.column(i)) for i in self.layout.sort_key]
        parts = [
            lexicographic(columns, values, side == "lower", inclusive)
            for side in ("lower", "upper")
            if (b := self.bounds(side)) is not None
            for values, inclusive in [b]
        ]
        return reduce(Column.__and__, parts) if parts else None

    def condition(self) -> Column | None:
        """The whole filter, tests in the order of their rank."""
        parts = [self.test_column(t) for t in self.tests]
        if (r := self.range_column()) is not None:
            parts.append(r)
        return reduce(Column.__and__, parts) if parts else None

    def output(self) -> list[Column]:
        out = []
        for i in self.plan.project:
            f = self.schema.by_id(i)
            out.append(F.col(S.column(i)).alias(f.name, metadata={"parquet.field.id": f.id, "kind": f.kind, "schema_version": self.schema.version}))
        return out


def _check_value(schema: S.Schema, t: Test) -> None:
    kind = schema.by_id(t.field).kind
    if t.op in ("is_null", "is_not_null"):
        if t.value is not None:
            raise Invalid("plan.predicate", f"{t.op} takes no value")
        return
    if t.value is None:
        raise Invalid("plan.predicate", f"{t.op} needs a value that isn't null")
    if not fits(kind, t.value):
        raise Invalid("plan.type", f"{t.value!r} is not of type {kind}")


def _check_range(schema: S.Schema, layout: Layout, r: KeyRange, order: Callable) -> None:
    if not layout.sort_key:
        raise Invalid("plan.range", "the dataset has no sort key")
    for values in (r.lower, r.upper):
        if values is None:
            continue
        if len(values) != len(layout.sort_key):
            raise Invalid("plan.range", f"{len(values)} values for a key of {len(layout.sort_key)}")
        for i, v in zip(layout.sort_key, values):
            kind = schema.by_id(i).kind
            if v is None or not fits(kind, v):
                raise Invalid("plan.range", f"{v!r} is not of type {kind}")
            if is_nan(v):
                raise Invalid("plan.range", "a bound is NaN")
    if r.lower is not None and r.upper is not None and order(r.lower) > order(r.upper):
        raise Invalid("plan.range", "the lower bound is above the upper bound")


def _order(values: tuple) -> tuple:
    # strings compare by their bytes, as stored
    return tuple(v.encode() if isinstance(v, str) else bytes(v) if isinstance(v, bytearray) else v for v in values)


def resolve(plan: Scan, schema: S.Schema, layout: Layout) -> Resolved:
    if plan.batch_rows <= 0:
        raise Invalid("plan.batch", "batches need a row at least")
    if plan.limit is not None and plan.limit < 0:
        raise Invalid("plan.limit", "the limit is negative")
    if len(set(plan.project)) != len(plan.project):
        raise Invalid("plan.field", "a field is projected twice")
    for i in plan.project:
        schema.by_id(i, "plan.field")
    for t in plan.tests:
        schema.by_id(t.field, "plan.field")
        if t.op not in OPS:
            raise Invalid("plan.predicate", f"unknown comparison {t.op!r}")
        _check_value(schema, t)
    if plan.key_range is not None:
        _check_range(schema, layout, plan.key_range, _order)
    tests = tuple(sorted(plan.tests, key=lambda t: _rank(schema, t)))
    ids = [t.field for t in tests]
    if plan.key_range is not None and (plan.key_range.lower is not None or plan.key_range.upper is not None):
        ids += layout.sort_key
    return Resolved(schema, layout, plan, tests, tuple(dict.fromkeys(ids)))
