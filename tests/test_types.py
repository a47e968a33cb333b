import datetime as dt
from decimal import Decimal

import pytest

from strataq.layout import Layout
from strataq.plans.scan import KeyRange, Scan, Test
from strataq.schema import Field, Schema, spark_type
from strataq.sources.segment import SegmentWriter

UTC = dt.timezone.utc
#: kind -> five ascending values as Spark holds them, extremes at the ends
VALUES = {
    "int8": [-128, -1, 0, 1, 127],
    "int16": [-(2**15), -1, 0, 1, 2**15 - 1],
    "int32": [-(2**31), -1, 0, 1, 2**31 - 1],
    "int64": [-(2**63), -1, 0, 1, 2**63 - 1],
    "uint8": [0, 1, 2, 128, 255],
    "uint16": [0, 1, 2, 2**15, 2**16 - 1],
    "uint32": [0, 1, 2, 2**31, 2**32 - 1],
    "uint64": [Decimal(x) for x in (0, 1, 2, 2**63, 2**64 - 1)],
    "float32": [-1.5, -0.5, 0.0, 0.5, 1.5],
    "float64": [-1.7976931348623157e308, -1.0, 0.0, 2.5, 1.7976931348623157e308],
    "timestamp[us, UTC]": [dt.datetime(1, 1, 2, tzinfo=UTC), dt.datetime(1970, 1, 1, tzinfo=UTC), dt.datetime(2000, 1, 1, tzinfo=UTC), dt.datetime(2024, 2, 29, 1, 2, 3, 4, tzinfo=UTC), dt.datetime(9999, 12, 30, tzinfo=UTC)],
    "timestamp[ms]": [dt.datetime(1900, 1, 1), dt.datetime(1970, 1, 1), dt.datetime(2000, 1, 1), dt.datetime(2024, 2, 29, 1, 2, 3), dt.datetime(9999, 12, 30)],
    "timestamp[ns]": [-(2**63), -1, 0, 1, 2**63 - 1],
    "string": ["", "a", "a\x00b", "z", "世界"],
    "binary": [bytearray(b""), bytearray(b"\x00"), bytearray(b"\x00\x01"), bytearray(b"a"), bytearray(b"\xff\xfe")],
}


def literal(kind, v):
    return int(v) if isinstance(v, Decimal) else bytes(v) if isinstance(v, bytearray) else v


@pytest.fixture(scope="module")
def typed(spark, tmp_path_factory):
    """Every type with a null in the third row, sorted by a row number."""
    fields = [Field(1, "row", "int64", False)] + [Field(10 * (i + 1), f"c{i}", k) for i, k in enumerate([*VALUES, "bool"])]
    schema = Schema(7, tuple(fields))
    columns = [[*range(6)], *[[*v[:2], None, *v[2:]] for v in VALUES.values()], [True, False, None, True, False, True]]
    rows = list(zip(*columns))
    w = SegmentWriter(spark, str(tmp_path_factory.mktemp("typed") / "t"), schema, Layout(2, 1024, (1,), tuple(f.id for f in fields), (10, 90, 140)))
    frame = spark.createDataFrame(rows, schema.struct()).coalesce(1)
    w.append(frame)
    return w.finish(), schema, rows


def test_round_trip(typed):
    segment, schema, rows = typed
    assert segment.num_row_groups == 3
    got = [tuple(r) for r in segment.read_all().collect()]
    zone = schema.fields[11]
    for a, b in zip(got, rows):
        for f, x, y in zip(schema.fields, a, b):
            if f.id == zone.id and y is not None:
                y = y.astimezone().replace(tzinfo=None) if x.tzinfo is None else y
            assert x == y, f.kind


@pytest.mark.parametrize("kind", [*VALUES, "bool"])
def test_equality_and_null_of_each_type(typed, kind):
    segment, schema, rows = typed
    at = next(i for i, f in enumerate(schema.fields) if f.kind == kind and f.name != "row")
    f = schema.fields[at]
    value = rows[1][at]
    hits = [r[0] for r in segment.scan(Scan((1,), (Test(f.id, "eq", literal(kind, value)),))).frame().collect()]
    assert hits == [r[0] for r in rows if r[at] is not None and r[at] == value]
    assert [r[0] for r in segment.scan(Scan((1,), (Test(f.id, "is_null"),))).frame().collect()] == [2]
    assert segment.scan(Scan((1,), (Test(f.id, "ne", literal(kind, value)),))).count() == 5 - len(hits)


@pytest.mark.parametrize("kind", list(VALUES))
def test_sort_range_of_each_type(spark, tmp_path, kind):
    schema = Schema(1, (Field(1, "key", kind, False),))
    w = SegmentWriter(spark, str(tmp_path / "s"), schema, Layout(2, sort_key=(1,), forced={}))
    values = VALUES[kind]
    w.append(spark.createDataFrame([(v,) for v in values], schema.struct()).coalesce(1))
    segment = w.finish()
    scan = segment.scan(Scan((1,), key_range=KeyRange((literal(kind, values[1]),), (literal(kind, values[4]),))))
    assert scan.count() == 3
    assert scan.metrics().row_groups_pruned == 1  # the last group holds the upper bound alone


def test_spark_types_cover_the_kinds():
    assert len({spark_type(k).simpleString() for k in VALUES}) >= 10
