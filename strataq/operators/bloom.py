"""Bloom filters of row groups as bitmaps, built and probed with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.operators.groups import GROUP

PROBES, BITS_PER_ROW, LEAST_BITS = 7, 10, 256
BLOCK = 32_768  # bits of one bitmap of bitmap_construct_agg


def bits_for(rows: int) -> int:
    """Power of two with ten bits for each row at least."""
    return 1 << (max(LEAST_BITS, BITS_PER_ROW * rows) - 1).bit_length()


def _clean(c: Column, is_float: bool) -> Column:
    # adding zero turns -0.0 into 0.0
    return c + F.lit(0.0).cast("double") if is_float else c


def _positions(value: Column, bits: int) -> Column:
    """Bit positions of a value by double hashing.  Both hashes are reduced modulo
    ``bits`` first, which changes no position and can't overflow."""
    first = F.pmod(F.xxhash64(F.lit(0), value), F.lit(bits))
    second = F.pmod(F.xxhash64(F.lit(1), value).bitwiseOR(1), F.lit(bits))
    return F.array(*[F.pmod(first + F.lit(i) * second, F.lit(bits)) for i in range(PROBES)])


def build(df: DataFrame, column: str, bits: int, is_float: bool = False, group: str = GROUP) -> DataFrame:
    """(group, block, bitmap): the bits of each block of BLOCK that some value set.
    Nulls and NaN are left out."""
    c = F.col(column)
    keep = c.isNotNull() & ~F.isnan(c) if is_float else c.isNotNull()
    # a group's rows come together once; neither its values nor its bitmaps move again
    values = df.filter(keep).select(group, _clean(c, is_float).alias("v")).repartition(group).distinct()
    at = values.select(group, _positions(F.col("v"), bits).alias("at"))
    if bits > BLOCK:
        one = at.select(group, F.explode("at").alias("at"))
        return one.groupBy(group, F.floor(F.col("at") / BLOCK).cast("int").alias("block")).agg(F.bitmap_construct_agg(F.col("at") % BLOCK).alias("bitmap"))
    # one block holds all: a bitmap for each probe, so that a value is sorted once, not once for each probe
    each = at.groupBy(group).agg(*[F.bitmap_construct_agg(F.col("at")[i]).alias(f"b{i}") for i in range(PROBES)])
    each = each.select(group, F.explode(F.array(*[f"b{i}" for i in range(PROBES)])).alias("b"))
    return each.groupBy(group).agg(F.bitmap_or_agg("b").alias("bitmap")).select(group, F.lit(0).cast("int").alias("block"), "bitmap")


def probe(blooms: DataFrame, groups: DataFrame, value: Column, bits: int, is_float: bool = False, group: str = GROUP) -> DataFrame:
    """(group, may) for every group: whether it may hold a value."""
    one = groups.sparkSession.range(1).select(F.explode(F.array_distinct(_positions(_clean(value, is_float), bits))).alias("at"))
    wanted = one.select(F.floor(F.col("at") / BLOCK).cast("int").alias("block"), (F.col("at") % BLOCK).cast("int").alias("bit"))
    need = one.count()
    byte = F.conv(F.hex(F.substring("bitmap", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, F.pmod(F.col("bit"), F.lit(8)))
    found = blooms.join(F.broadcast(wanted), "block").filter(hit == 1).groupBy(group).agg(F.count("*").alias("n"))
    return groups.select(group).join(found, group, "left").select(group, (F.coalesce("n", F.lit(0)) >= need).alias("may"))
