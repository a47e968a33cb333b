"""Canonical bytes of single values: fixed-width kinds little-endian, strings as UTF-8,
binaries as they are; a zero float has one form, whatever its sign."""

from __future__ import annotations

import datetime
import struct
from decimal import Decimal

from strataq import schema as S
from strataq.errors import Corrupt, Invalid
from strataq.plans.scan import fits

# Struct codes of the fixed-width kinds.
_CODES = {
    "bool": "<?", "int8": "<b", "int16": "<h", "int32": "<i", "int64": "<q", "uint8": "<B", "uint16": "<H", "uint32": "<I", "uint64": "<Q",
    "float32": "<f", "float64": "<d",
}
_PER_SECOND = {"s": 1, "ms": 10**3, "us": 10**6}
_EPOCH = datetime.datetime(1970, 1, 1)


def _unit(kind: str) -> str:
    return kind[len("timestamp[") :].split(",")[0].rstrip("]")


def serialise(kind: str, value: object) -> bytes:
    """Bytes of a value that is of a kind exactly; null has none and is refused."""
    if isinstance(value, Decimal) and kind == "uint64" and value == int(value):
        value = int(value)
    S.spark_type(kind)
    if value is None or not fits(kind, value):
        raise Invalid("scalar.type", f"{value!r} is not of type {kind}")
    if kind in S.FLOATS and value == 0:
        value = 0.0
    if kind in _CODES:
        return struct.pack(_CODES[kind], value)
    if kind == "string":
        return value.encode()
    if kind == "binary":
        return bytes(value)
    if _unit(kind) == "ns":
        return struct.pack("<q", value)
    if value.tzinfo is not None:
        value = value.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    micros = (value - _EPOCH) // datetime.timedelta(microseconds=1)
    units, rest = divmod(micros * _PER_SECOND[_unit(kind)], 10**6)
    if rest:
        raise Invalid("scalar.type", f"{value} has parts smaller than the unit of {kind}")
    return struct.pack("<q", units)


def parse(kind: str, data: bytes) -> object:
    """The value of some bytes; their number must be that of the kind."""
    S.spark_type(kind)
    if kind == "binary":
        return bytes(data)
    try:
        if kind == "string":
            return data.decode()
        value = struct.unpack(_CODES.get(kind, "<q"), data)[0]
    except (struct.error, UnicodeDecodeError) as e:
        raise Corrupt("format.scalar", f"{len(data)} bytes are no {kind}: {e}") from e
    if kind == "bool" and data not in (b"\0", b"\1"):
        raise Corrupt("format.scalar", "a truth value is 0 or 1")
    if not S.is_timestamp(kind) or _unit(kind) == "ns":
        return value
    try:
        at = _EPOCH + datetime.timedelta(microseconds=value * (10**6 // _PER_SECOND[_unit(kind)]))
    except OverflowError as e:
        raise Corrupt("format.scalar", f"{value} is beyond the years of {kind}") from e
    return at.replace(tzinfo=datetime.timezone.utc) if "," in kind else at
