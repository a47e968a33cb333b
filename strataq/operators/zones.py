"""Zone maps, sort bounds and the classification of row groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq import schema as S
from strataq.functions.compare import is_nan, lexicographic
from strataq.layout import Layout
from strataq.operators.groups import GROUP, POSITION
from strataq.plans.scan import Resolved, Test, literal

NONE, ALL, PARTIAL = "none", "all", "partial"


def guarded(agg: Column, c: Column, is_float: bool) -> Column:
    """An extreme that is absent when the group holds a NaN."""
    return F.when(F.max(F.isnan(c).cast("int")) == 1, F.lit(None)).otherwise(agg) if is_float else agg


def zone_map(df: DataFrame, schema: S.Schema, layout: Layout, group: str = GROUP) -> DataFrame:
    """One row per group: rows, and min, max, null count of the statistics fields,
    NaN marks of float fields, first and last sort key.  One aggregation."""
    out = [F.count("*").alias("row_count")]
    for i in layout.statistics:
        c, is_float = F.col(S.column(i)), schema.by_id(i).kind in S.FLOATS
        out += [
            guarded(F.min(c), c, is_float).alias(f"min_{i}"),
            guarded(F.max(c), c, is_float).alias(f"max_{i}"),
            (F.count("*") - F.count(c)).alias(f"nulls_{i}"),
        ]
        if is_float:
            out.append(F.coalesce(F.max(F.isnan(c).cast("int")), F.lit(0)).alias(f"nan_{i}"))
    if layout.sort_key:
        # column by column: a struct in the aggregation's buffer would have all rows sorted
        keys = [S.column(i) for i in layout.sort_key]
        out += [F.struct(*[by(c, POSITION).alias(c) for c in keys]).alias(name) for by, name in ((F.min_by, "first_key"), (F.max_by, "last_key"))]
    return df.groupBy(group).agg(*out)


def _nothing(r: Resolved, t: Test) -> Column:
    """Whether statistics show that no row of the group passes a test."""
    kind = r.schema.by_id(t.field).kind
    low, high = F.col(f"min_{t.field}"), F.col(f"max_{t.field}")
    nulls, rows = F.col(f"nulls_{t.field}"), F.col("row_count")
    if t.op == "is_null":
        return nulls == 0
    if t.op == "is_not_null":
        return nulls == rows
    only_nulls = nulls == rows
    if is_nan(t.value):
        return F.lit(True) if t.op != "ne" else only_nulls
    v = literal(kind, t.value)
    outside = {
        "eq": (v < low) | (v > high),
        "ne": (low == v) & (high == v),
        "lt": low >= v,
        "le": low > v,
        "gt": high <= v,
        "ge": high < v,
    }[t.op]
    return only_nulls | F.coalesce(outside, F.lit(False))


def _everything(r: Resolved, t: Test) -> Column:
    """Whether statistics show that every row of the group passes a test."""
    kind = r.schema.by_id(t.field).kind
    low, high = F.col(f"min_{t.field}"), F.col(f"max_{t.field}")
    nulls, rows = F.col(f"nulls_{t.field}"), F.col("row_count")
    if t.op == "is_null":
        return nulls == rows
    if t.op == "is_not_null":
        return nulls == 0
    if is_nan(t.value):
        return (nulls == 0) if t.op == "ne" else F.lit(False)
    v = literal(kind, t.value)
    inside = {
        "eq": (low == v) & (high == v),
        "ne": (v < low) | (v > high),
        "lt": high < v,
        "le": high <= v,
        "gt": low > v,
        "ge": low >= v,
    }[t.op]
    return (nulls == 0) & F.coalesce(inside, F.lit(False))


def _range_class(r: Resolved) -> tuple[Column, Column]:
    """(no row in the key range, every row in it), from first and last keys."""
    first = [F.col("first_key")[S.column(i)] for i in r.layout.sort_key]
    last = [F.col("last_key")[S.column(i)] for i in r.layout.sort_key]
    nothing, everything = F.lit(False), F.lit(True)
    if (b := r.bounds("lower")) is not None:
        nothing = nothing | ~lexicographic(last, b[0], True, b[1])
        everything = everything & lexicographic(first, b[0], True, b[1])
    if (b := r.bounds("upper")) is not None:
        nothing = nothing | ~lexicographic(first, b[0], False, b[1])
        everything = everything & lexicographic(last, b[0], False, b[1])
    return nothing, everything


def classify(index: DataFrame, r: Resolved, blooms: dict[int, DataFrame] | None = None) -> DataFrame:
    """``index`` with ``cls``: none, all or partial.

    Fields without statistics leave a group partial; results never depend on the
    index.  ``blooms`` maps the place of an equality test to (group, may) rows.
    """
    columns = set(index.columns)
    nothing, everything = [], []
    for n, t in enumerate(r.tests):
        if f"nulls_{t.field}" in columns:
            nothing.append(_nothing(r, t))
            everything.append(_everything(r, t))
        else:
            everything.append(F.lit(False))
        if blooms and n in blooms:
            index = index.join(blooms[n].withColumnRenamed("may", f"__may_{n}"), GROUP, "left")
            nothing.append(~F.coalesce(F.col(f"__may_{n}"), F.lit(True)))
    if r.range_column() is not None:
        if "first_key" in columns:
            a, b = _range_class(r)
            nothing.append(a)
            everything.append(b)
        else:
            everything.append(F.lit(False))
    any_none = reduce(Column.__or__, nothing) if nothing else F.lit(False)
    all_all = reduce(Column.__and__, everything) if everything else F.lit(True)
    out = index.withColumn("cls", F.when(any_none, NONE).when(all_all, ALL).otherwise(PARTIAL))
    return out.drop(*[c for c in out.columns if c.startswith("__may_")])
