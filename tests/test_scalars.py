import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataq.errors import Corrupt, Invalid
from strataq.functions.scalars import parse, serialise

UTC = dt.timezone.utc


@pytest.mark.parametrize(
    "kind,value,data",
    [
        ("bool", True, b"\1"), ("int8", -1, b"\xff"), ("int16", 258, b"\2\1"), ("int32", -2, b"\xfe\xff\xff\xff"), ("int64", 1, b"\1" + b"\0" * 7),
        ("uint8", 255, b"\xff"), ("uint16", 65_535, b"\xff\xff"), ("uint32", 1, b"\1\0\0\0"), ("uint64", 2**64 - 1, b"\xff" * 8),
        ("float32", 1.0, b"\0\0\x80?"), ("float64", 1.0, b"\0" * 6 + b"\xf0?"), ("string", "é", b"\xc3\xa9"), ("binary", b"\0a", b"\0a"),
        ("timestamp[s]", dt.datetime(1970, 1, 1, 0, 0, 2), b"\2" + b"\0" * 7), ("timestamp[us, UTC]", dt.datetime(1970, 1, 1, tzinfo=UTC), b"\0" * 8),
        ("timestamp[ns]", -1, b"\xff" * 8),
    ],
)
def test_known_bytes(kind, value, data):
    assert serialise(kind, value) == data and parse(kind, data) == value


def test_one_zero():
    assert serialise("float64", -0.0) == serialise("float64", 0.0) == b"\0" * 8


@settings(max_examples=100, deadline=None)
@given(st.integers(-(2**63), 2**63 - 1), st.floats(allow_nan=False), st.text(), st.datetimes())
def test_round_trips(i, f, s, t):
    s = s.encode("utf-8", "ignore").decode()
    for kind, v in (("int64", i), ("float64", f), ("string", s), ("binary", s.encode()), ("timestamp[us]", t), ("timestamp[us, UTC]", t.replace(tzinfo=UTC))):
        assert parse(kind, serialise(kind, v)) == v


@pytest.mark.parametrize("kind,value", [("int8", 128), ("uint8", -1), ("int64", 1.0), ("int64", True), ("string", b"x"), ("float64", 1), ("int64", None), ("timestamp[s]", dt.datetime(2000, 1, 1, 0, 0, 0, 5))])
def test_wrong_values(kind, value):
    with pytest.raises(Invalid):
        serialise(kind, value)


@pytest.mark.parametrize("kind,data", [("int64", b"\0" * 7), ("bool", b"\2"), ("string", b"\xff"), ("float32", b""), ("timestamp[s]", b"\xff" * 7 + b"\x7f")])
def test_wrong_bytes(kind, data):
    with pytest.raises(Corrupt):
        parse(kind, data)
