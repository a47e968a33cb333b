"""Which encoding holds which kind, and how many bytes it takes.

All sizes are expressions over per-group aggregates, so a report on every column of
every group is one aggregation.  ``n`` rows, ``nulls`` nulls, ``distinct`` values,
``runs`` runs of equal neighbours (null equals null), ``spread`` = max - min.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataq import schema as S

# Encoding ids.
ENCODINGS = {"plain": 0, "dictionary": 1, "rle": 2, "for": 3, "compact": 4}
# Header bytes of each encoded chunk.
PLAIN_HEADER, DICTIONARY_HEADER, RLE_HEADER, RLE_RUN_HEADER, FOR_HEADER = 24, 48, 16, 16, 32


def supports(encoding: str, kind: str) -> bool:
    if encoding == "plain":
        return True
    if encoding == "compact":
        return kind in S.VARIABLE
    if encoding == "dictionary":
        return kind in S.INTEGERS or kind in S.VARIABLE
    if encoding == "rle":
        return kind in S.INTEGERS or kind == "bool"
    return kind in S.INTEGERS or S.is_timestamp(kind)


def _long(x: Column) -> Column:
    return F.floor(x).cast("long")


def validity(n: Column, nulls: Column) -> Column:
    """Bytes of the validity bitmap; none without a null."""
    return F.when(nulls > 0, _long((n + 7) / 8)).otherwise(F.lit(0).cast("long"))


def plain(kind: str, n: Column, nulls: Column, value_bytes: Column | None = None) -> Column:
    """Plain size; ``value_bytes`` is the sum of lengths of a variable-width column."""
    base = F.lit(PLAIN_HEADER) + validity(n, nulls)
    if kind in S.VARIABLE:
        return (base + 8 * (n + 1) + value_bytes).cast("long")
    return (base + S.width(kind) * n).cast("long")


def compact(n: Column, plain_size: Column) -> Column:
    """Offsets of four bytes instead of eight."""
    return (plain_size - 4 * (n + 1)).cast("long")


def index_width(distinct: Column) -> Column:
    return F.when(distinct <= 2**8, 1).when(distinct <= 2**16, 2).when(distinct <= 2**32, 4).otherwise(8)


def dictionary(kind: str, n: Column, nulls: Column, distinct: Column, distinct_bytes: Column | None = None) -> Column:
    entries = (8 * (distinct + 1) + distinct_bytes) if kind in S.VARIABLE else S.width(kind) * distinct
    return (F.lit(DICTIONARY_HEADER) + validity(n, nulls) + entries + n * index_width(distinct)).cast("long")


def rle(kind: str, runs: Column) -> Column:
    return (F.lit(RLE_HEADER) + runs * (RLE_RUN_HEADER + S.width(kind))).cast("long")


def bits(spread: Column) -> Column:
    """Bits that hold 0..spread, up to 64; 0 for no or one value.  ``spread`` is a
    decimal(38, 0), since the extremes of 64-bit types lie up to 2**64 - 1 apart."""
    wide = spread >= F.lit(Decimal(2**63)).cast("decimal(38,0)")
    narrow = F.when(wide, F.lit(0)).otherwise(spread).cast("long")
    return (
        F.when(spread.isNull() | (spread == 0), 0).when(wide, 64).otherwise(F.length(F.bin(narrow))).cast("int")
    )


def frame_of_reference(kind: str, n: Column, nulls: Column, width_bits: Column) -> Column:
    return (F.lit(FOR_HEADER + S.width(kind)) + validity(n, nulls) + _long((n * width_bits + 7) / 8)).cast("long")


def choose(kind: str | None, sizes: dict[str, Column]) -> Column:
    """Id of the smallest encoding that saves a tenth of the plain size at least;
    equal sizes go to the lower id; plain if none does.  Without a kind, encodings that
    can't hold a chunk have a null size."""
    plain_size = sizes["plain"]
    most = plain_size - _long(plain_size / 10)
    able = [(number, sizes[name]) for name, number in ENCODINGS.items() if name != "plain" and name in sizes and (kind is None or supports(name, kind))]
    if not able:
        return F.lit(0)
    # structs compare by size, then by id; array_min passes over those that save too little
    best = F.array_min(F.array(*[F.when(size <= most, F.struct(size.cast("long").alias("size"), F.lit(number).alias("id"))) for number, size in able]))
    return F.coalesce(best["id"], F.lit(0)).cast("int")


def size_of(chosen: Column, sizes: dict[str, Column]) -> Column:
    out = sizes["plain"]
    for name, size in sizes.items():
        out = F.when(chosen == ENCODINGS[name], size).otherwise(out)
    return out


def fallback(chosen: Column, encoded: Column, plain_size: Column, forced: bool) -> Column:
    """Plain where an unforced dictionary, RLE or FOR chunk turned out no smaller."""
    if forced:
        return chosen.cast("int")
    return F.when(chosen.isin(1, 2, 3) & (encoded >= plain_size), 0).otherwise(chosen).cast("int")
