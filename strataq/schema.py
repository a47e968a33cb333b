"""Declared flat schemas with stable field ids."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataq.errors import Invalid, Unsupported

#: kind -> (Spark type, bytes of a plain value, smallest and largest value to check)
_KINDS: dict[str, tuple[T.DataType, int, tuple[int, int] | None]] = {
    "bool": (T.BooleanType(), 1, None),
    "int8": (T.ByteType(), 1, None),
    "int16": (T.ShortType(), 2, None),
    "int32": (T.IntegerType(), 4, None),
    "int64": (T.LongType(), 8, None),
    "uint8": (T.ShortType(), 1, (0, 2**8 - 1)),
    "uint16": (T.IntegerType(), 2, (0, 2**16 - 1)),
    "uint32": (T.LongType(), 4, (0, 2**32 - 1)),
    "uint64": (T.DecimalType(20, 0), 8, (0, 2**64 - 1)),
    "float32": (T.FloatType(), 4, None),
    "float64": (T.DoubleType(), 8, None),
    "string": (T.StringType(), 0, None),
    "binary": (T.BinaryType(), 0, None),
}
_TIMESTAMP = re.compile(r"timestamp\[(s|ms|us|ns)(?:, ?([^\]]+))?\]")
INTEGERS = frozenset("int8 int16 int32 int64 uint8 uint16 uint32 uint64".split())
FLOATS = frozenset(("float32", "float64"))
VARIABLE = frozenset(("string", "binary"))


def spark_type(kind: str) -> T.DataType:
    """Spark type of a kind.  Nanosecond timestamps are kept as long integers, since
    Spark's own timestamps hold microseconds."""
    if kind in _KINDS:
        return _KINDS[kind][0]
    m = _TIMESTAMP.fullmatch(kind)
    if not m:
        raise Unsupported("schema.type", f"{kind!r} is not one of the 14 flat types")
    if m[1] == "ns":
        return T.LongType()
    return T.TimestampType() if m[2] else T.TimestampNTZType()


def is_timestamp(kind: str) -> bool:
    return kind.startswith("timestamp[")


def width(kind: str) -> int:
    """Bytes of one plain value; 0 for strings and binaries."""
    spark_type(kind)
    return 8 if is_timestamp(kind) else _KINDS[kind][1]


def limits(kind: str) -> tuple[int, int] | None:
    return _KINDS[kind][2] if kind in _KINDS else None


def kind_of(dtype: T.DataType) -> str:
    """Kind of a Spark column; unsigned and nanosecond kinds can't be told apart
    from their carriers and have to be declared."""
    for kind, (t, _, _) in _KINDS.items():
        if t == dtype and not kind.startswith("uint"):
            return kind
    if isinstance(dtype, T.TimestampType):
        return "timestamp[us, UTC]"
    if isinstance(dtype, T.TimestampNTZType):
        return "timestamp[us]"
    raise Unsupported("schema.type", f"{dtype.simpleString()} is not one of the 14 flat types")


@dataclass(frozen=True)
class Field:
    id: int
    name: str
    kind: str
    nullable: bool = True
    default: object = None


@dataclass(frozen=True)
class Schema:
    version: int
    fields: tuple[Field, ...]

    def __post_init__(self):
        object.__setattr__(self, "fields", tuple(self.fields))

    def validate(self) -> "Schema":
        """Unique ids, known types, no defaults.  Equal names and no fields are fine."""
        seen = set()
        for f in self.fields:
            if f.id in seen:
                raise Invalid("schema.field", f"field id {f.id} is declared twice")
            seen.add(f.id)
            if not f.kind:
                raise Invalid("schema.type", f"field {f.id} has no type")
            spark_type(f.kind)
            if f.default is not None:
                raise Unsupported("schema.default", f"field {f.id} has a default value")
        return self

    def by_id(self, field_id: int, area: str = "schema.field") -> Field:
        for f in self.fields:
            if f.id == field_id:
                return f
        raise Invalid(area, f"unknown field id {field_id}")

    def struct(self) -> T.StructType:
        """Spark schema; ids go along as Parquet field ids."""
        return T.StructType(
            [
                T.StructField(f.name, spark_type(f.kind), f.nullable, {"parquet.field.id": f.id, "kind": f.kind, "schema_version": self.version})
                for f in self.fields
            ]
        )

    def stored(self) -> T.StructType:
        """Schema of the stored columns.  They are named by field id, so renaming a
        field never touches stored data."""
        return T.StructType([T.StructField(column(f.id), spark_type(f.kind), True) for f in self.fields])

    def check_frame(self, df: DataFrame) -> DataFrame:
        """Columns of ``df`` by position as stored columns; names and types must agree."""
        if len(df.columns) != len(self.fields):
            raise Invalid("schema.batch", f"{len(df.columns)} columns for {len(self.fields)} fields")
        for f, got in zip(self.fields, df.schema.fields):
            if got.name != f.name:
                raise Invalid("schema.batch", f"column {got.name!r} where field {f.name!r} stands")
            if got.dataType != spark_type(f.kind):
                raise Invalid("schema.batch", f"column {got.name!r} is {got.dataType.simpleString()}, not {f.kind}")
        return df.toDF(*[column(f.id) for f in self.fields])

    def to_json(self) -> dict:
        return {"version": self.version, "fields": [{"id": f.id, "name": f.name, "kind": f.kind, "nullable": f.nullable} for f in self.fields]}

    @staticmethod
    def from_json(x: dict) -> "Schema":
        return Schema(x["version"], tuple(Field(f["id"], f["name"], f["kind"], f["nullable"]) for f in x["fields"])).validate()

    @staticmethod
    def of(df: DataFrame, version: int = 1, required: Iterable[str] = ()) -> "Schema":
        """Schema of a frame, ids from 1 by position."""
        need = set(required)
        return Schema(version, tuple(Field(i + 1, f.name, kind_of(f.dataType), f.name not in need) for i, f in enumerate(df.schema.fields))).validate()


def column(field_id: int) -> str:
    """Stored name of a field."""
    return f"f{field_id}"


def bad_value(f: Field) -> Column:
    """Whether a stored value breaks the declaration: null where none may be, or
    outside the range of an unsigned type."""
    c = F.col(column(f.id))
    bad = F.lit(False) if f.nullable else c.isNull()
    if (r := limits(f.kind)) is not None:
        wide = c.cast("decimal(38,0)")
        bad = bad | F.coalesce((wide < F.lit(Decimal(r[0]))) | (wide > F.lit(Decimal(r[1]))), F.lit(False))
    return bad
