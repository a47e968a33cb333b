"""Comparisons with IEEE semantics for NaN, and ranges over composite keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = ("eq", "ne", "lt", "le", "gt", "ge", "is_null", "is_not_null")
_APPLY = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
}


def compare(c: Column, op: str, value: Column | None = None, is_float: bool = False, value_is_nan: bool = False) -> Column:
    """``c op value`` that is null or false for a null ``c``.

    Spark takes NaN as equal to itself and above all numbers; here only ``ne`` holds
    for a NaN on either side.  The guard is needed where Spark's order would let a
    NaN through, so that all other forms are pushed to the scan as they are.
    """
    if op == "is_null":
        return c.isNull()
    if op == "is_not_null":
        return c.isNotNull()
    if is_float and value_is_nan:
        return c.isNotNull() if op == "ne" else F.lit(False)
    plain = _APPLY[op](c, value)
    return plain & ~F.isnan(c) if is_float and op in ("gt", "ge") else plain


def is_nan(value) -> bool:
    return isinstance(value, float) and math.isnan(value)


def lexicographic(columns: Sequence[Column], bound: Sequence[Column], lower: bool, inclusive: bool) -> Column:
    """``columns`` on the inner side of ``bound`` in lexicographic order, spelled as
    ``k1 > a OR (k1 = a AND (k2 > b OR ...))`` because comparisons of single columns
    reach the scan's statistics and comparisons of structs don't."""
    beyond = (lambda c, v: c > v) if lower else (lambda c, v: c < v)
    at = (lambda c, v: c >= v) if lower else (lambda c, v: c <= v)
    c, v = columns[-1], bound[-1]
    out = at(c, v) if inclusive else beyond(c, v)
    for c, v in zip(reversed(columns[:-1]), reversed(bound[:-1])):
        out = beyond(c, v) | ((c == v) & out)
    return out
