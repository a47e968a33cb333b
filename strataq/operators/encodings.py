"""Encodings of column chunks as DataFrame operators, and the choice among them.

A chunk is one column of one row group.  Operators give the logical encoded form
(runs, codes, deltas) and exact sizes; Parquet does the physical encoding.  Work
inside a group is bounded by the rows of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataq import schema as S
from strataq.functions import sizes as Z
from strataq.operators.groups import GROUP, POSITION


def with_runs(df: DataFrame, column: str, group: str = GROUP, position: str = POSITION, partition: str | None = None) -> DataFrame:
    """Adds ``__brk``: 1 where a value differs from the one in front of it in the
    group (null equals null)."""
    w = Window.partitionBy(partition or group).orderBy(position)
    first = F.row_number().over(w) == 1
    same = F.col(column).eqNullSafe(F.lag(column).over(w))
    return df.withColumn("__brk", F.when(first | ~same, 1).otherwise(0))


def rle_encode(df: DataFrame, column: str, group: str = GROUP, position: str = POSITION) -> DataFrame:
    """(group, run_id from 1, run_len, run_value) in the order of the group."""
    w = Window.partitionBy(group).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    marked = with_runs(df.select(group, position, column), column, group, position)
    numbered = marked.withColumn("run_id", F.sum("__brk").over(w).cast("long"))
    return numbered.groupBy(group, "run_id").agg(F.count("*").alias("run_len"), F.min(column).alias("run_value"))


def rle_decode(runs: DataFrame, group: str = GROUP) -> DataFrame:
    """(group, at, value): the value at each place of the group, from 0."""
    w = Window.partitionBy(group).orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("run_len").over(w), F.lit(0))
    placed = runs.withColumn("__start", start)
    return placed.select(group, F.explode(F.sequence(F.col("__start"), F.col("__start") + F.col("run_len") - 1)).alias("at"), F.col("run_value").alias("value"))


def dictionary_entries(df: DataFrame, column: str, group: str = GROUP, position: str = POSITION) -> DataFrame:
    """(group, value, code): distinct values coded by first occurrence."""
    first = df.filter(F.col(column).isNotNull()).groupBy(group, F.col(column).alias("value")).agg(F.min(position).alias("__first"))
    w = Window.partitionBy(group).orderBy("__first")
    return first.select(group, "value", (F.row_number().over(w) - 1).cast("long").alias("code"))


def dictionary_encode(df: DataFrame, column: str, group: str = GROUP, position: str = POSITION) -> DataFrame:
    """(group, position, code): the code of every row, null for a null."""
    entries = dictionary_entries(df, column, group, position).withColumnRenamed("value", "__value")
    rows = df.select(group, position, column)
    return rows.join(entries, (rows[group] == entries[group]) & (rows[column] == entries["__value"]), "left").select(rows[group], position, "code")


def dictionary_decode(codes: DataFrame, entries: DataFrame, group: str = GROUP, position: str = POSITION) -> DataFrame:
    return codes.join(entries, [group, "code"], "left").select(group, position, "value")


def for_parameters(df: DataFrame, column: str, group: str = GROUP) -> DataFrame:
    """(group, base, bit_width) of frame-of-reference packing."""
    spread = F.max(column).cast("decimal(38,0)") - F.min(column).cast("decimal(38,0)")
    return df.groupBy(group).agg(F.min(column).alias("base"), Z.bits(spread).alias("bit_width"))


def for_encode(df: DataFrame, column: str, group: str = GROUP, position: str = POSITION) -> DataFrame:
    """(group, position, delta): distance from the group's smallest value."""
    base = df.groupBy(group).agg(F.min(column).alias("__base"))
    rows = df.select(group, position, column).join(base, group)
    return rows.select(group, position, (F.col(column).cast("decimal(38,0)") - F.col("__base").cast("decimal(38,0)")).cast("decimal(20,0)").alias("delta"))


def for_decode(deltas: DataFrame, parameters: DataFrame, kind: str = "int64", group: str = GROUP, position: str = POSITION) -> DataFrame:
    joined = deltas.join(parameters.select(group, "base"), group)
    value = F.col("base").cast("decimal(38,0)") + F.col("delta")
    return joined.select(group, position, value.cast(S.spark_type(kind)).alias("value"))


def _measured(df: DataFrame, column: str, kind: str, suffix: str) -> list:
    """Aggregates of one column that the sizes need; ``__brk_<suffix>`` must be there."""
    c = F.col(column)
    out = [
        F.count("*").alias(f"n_{suffix}"),
        (F.count("*") - F.count(c)).alias(f"nulls_{suffix}"),
    ]
    if kind in S.VARIABLE:
        out.append(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias(f"bytes_{suffix}"))
    if Z.supports("dictionary", kind):
        out.append(F.count_distinct(c).alias(f"distinct_{suffix}"))
    if Z.supports("rle", kind):
        out.append(F.sum("__brk").alias(f"runs_{suffix}"))
    if Z.supports("for", kind):
        x = F.unix_micros(c) if kind.startswith("timestamp") and "ns" not in kind and "," in kind else c
        if kind.startswith("timestamp") and "ns" not in kind and "," not in kind:
            x = F.unix_micros(c.cast("timestamp"))
        x = x.cast("decimal(38,0)")
        out.append((F.max(x) - F.min(x)).alias(f"spread_{suffix}"))
    return out


def _sizes(kind: str, suffix: str, distinct_bytes=None) -> dict:
    n, nulls = F.col(f"n_{suffix}"), F.col(f"nulls_{suffix}")
    out = {"plain": Z.plain(kind, n, nulls, F.col(f"bytes_{suffix}") if kind in S.VARIABLE else None)}
    if Z.supports("dictionary", kind):
        out["dictionary"] = Z.dictionary(kind, n, nulls, F.col(f"distinct_{suffix}"), distinct_bytes)
    if Z.supports("rle", kind):
        out["rle"] = Z.rle(kind, F.col(f"runs_{suffix}"))
    if Z.supports("for", kind):
        out["for"] = Z.frame_of_reference(kind, n, nulls, Z.bits(F.col(f"spread_{suffix}")))
    if Z.supports("compact", kind):
        out["compact"] = Z.compact(n, out["plain"])
    return out


def measure(df: DataFrame, column: str, kind: str, group: str = GROUP, position: str = POSITION) -> DataFrame:
    """Sizes of a column's chunks in every encoding that can hold it."""
    rows = with_runs(df.select(group, position, column), column, group, position)
    agg = rows.groupBy(group).agg(*_measured(df, column, kind, "x"))
    distinct_bytes = None
    if kind in S.VARIABLE:
        lengths = df.filter(F.col(column).isNotNull()).select(group, column).distinct().groupBy(group).agg(F.sum(F.octet_length(column)).alias("dbytes"))
        agg = agg.join(lengths, group, "left")
        distinct_bytes = F.coalesce("dbytes", F.lit(0))
    return agg.select(group, F.col("n_x").alias("row_count"), *[v.alias(f"{k}_size") for k, v in _sizes(kind, "x", distinct_bytes).items()])


def select_encoding(df: DataFrame, column: str, kind: str, sample_rows: int, group: str = GROUP, position: str = POSITION) -> DataFrame:
    """Sizes estimated on the first rows of each group and the encoding chosen."""
    w = Window.partitionBy(group).orderBy(position)
    sample = df.select(group, position, column).withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= sample_rows)
    sized = measure(sample, column, kind, group, position)
    columns = {n: F.col(f"{n}_size") for n in Z.ENCODINGS if f"{n}_size" in sized.columns}
    return sized.withColumn("encoding_id", Z.choose(kind, columns))


def report(df: DataFrame, column: str, kind: str, sample_rows: int, forced: str | None = None, group: str = GROUP, position: str = POSITION) -> DataFrame:
    """(group, row_count, chosen_id, encoding_id, encoded_size, plain_size): the
    choice on the sample and, after the size fallback on the whole chunk, the one kept."""
    whole = measure(df, column, kind, group, position)
    columns = {n: F.col(f"{n}_size") for n in Z.ENCODINGS if f"{n}_size" in whole.columns}
    if forced is not None:
        chosen = whole.withColumn("chosen_id", F.lit(Z.ENCODINGS[forced]))
    else:
        picked = select_encoding(df, column, kind, sample_rows, group, position).select(group, F.col("encoding_id").alias("chosen_id"))
        chosen = whole.join(picked, group)
    kept = chosen.withColumn("encoding_id", Z.fallback(F.col("chosen_id"), Z.size_of(F.col("chosen_id"), columns), F.col("plain_size"), forced is not None))
    return kept.select(group, "row_count", "chosen_id", "encoding_id", Z.size_of(F.col("encoding_id"), columns).alias("encoded_size"), "plain_size")


def _of_chunk(column: str, kind: str, suffix: str, on=None) -> list:
    """Aggregates of one column that the sizes need, over the rows that ``on`` holds for;
    ``__brk_<column>`` must be there.  Distinct values are gathered, at most those of a
    row group."""
    c = F.col(column) if on is None else F.when(on, F.col(column))
    n = F.count("*") if on is None else F.count_if(on)
    out = [n.alias(f"n_{suffix}"), (n - F.count(c)).alias(f"nulls_{suffix}")]
    if kind in S.VARIABLE:
        out.append(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias(f"bytes_{suffix}"))
    if Z.supports("dictionary", kind):
        out.append(F.collect_set(c).alias(f"values_{suffix}"))
    if Z.supports("rle", kind):
        brk = F.col(f"__brk_{column}")
        out.append(F.sum(brk if on is None else F.when(on, brk)).alias(f"runs_{suffix}"))
    if Z.supports("for", kind):
        x = c
        if S.is_timestamp(kind) and "ns" not in kind:
            x = F.unix_micros(c if "," in kind else c.cast("timestamp"))
        out += [F.min(x).alias(f"low_{suffix}"), F.max(x).alias(f"high_{suffix}")]
    return out


def _derived(kind: str, suffix: str) -> list:
    """What the sizes need of a group's aggregates."""
    out = [F.col(f"{c}_{suffix}") for c in ("n", "nulls")]
    if kind in S.VARIABLE:
        out.append(F.col(f"bytes_{suffix}"))
    if Z.supports("dictionary", kind):
        values = F.col(f"values_{suffix}")
        out.append(F.size(values).cast("long").alias(f"distinct_{suffix}"))
        if kind in S.VARIABLE:
            out.append(F.aggregate(values, F.lit(0).cast("long"), lambda total, v: total + F.octet_length(v)).alias(f"dbytes_{suffix}"))
    if Z.supports("rle", kind):
        out.append(F.col(f"runs_{suffix}"))
    if Z.supports("for", kind):
        low, high = (F.col(f"{c}_{suffix}").cast("decimal(38,0)") for c in ("low", "high"))
        out.append((high - low).alias(f"spread_{suffix}"))
    return out


def _sized(kind: str, suffix: str) -> list:
    """The chunk's size in every encoding, null where it can't hold the kind."""
    sizes = _sizes(kind, suffix, F.col(f"dbytes_{suffix}") if kind in S.VARIABLE else None)
    return [(sizes[n] if n in sizes else F.lit(None)).cast("long").alias(f"{n}_{suffix[-1]}") for n in Z.ENCODINGS]


def report_all(
    df: DataFrame, fields: list[tuple[int, str, str, str | None]], sample_rows: int, group: str = GROUP, position: str = POSITION, most_rows: int | None = None
) -> DataFrame:
    """``report`` of several columns, given as (field, column, kind, forced encoding),
    with a column ``field``: one reading, one window and one aggregation for all, and
    one choice for the chunks of all.  No group has more than ``most_rows`` rows; where
    the sample holds as many, it is the whole group and isn't measured again."""
    w = Window.partitionBy(group).orderBy(position)
    suffixes = "x" if most_rows is not None and most_rows <= sample_rows else "xs"
    marks = [F.row_number().over(w).alias("__k")]
    for _, column, kind, _ in fields:
        if Z.supports("rle", kind):
            same = F.col(column).eqNullSafe(F.lag(column).over(w)) & (F.row_number().over(w) > 1)
            marks.append(F.when(same, 0).otherwise(1).alias(f"__brk_{column}"))
    rows = df.select(group, *[c for _, c, _, _ in fields], *marks)
    sampled = {"x": None, "s": F.col("__k") <= sample_rows}
    parts = [(column, kind, f"{field}_{t}", sampled[t]) for field, column, kind, _ in fields for t in suffixes]
    chunks = rows.groupBy(group).agg(*[m for part in parts for m in _of_chunk(*part)])
    chunks = chunks.select(group, *[d for _, kind, suffix, _ in parts for d in _derived(kind, suffix)])
    each = []
    for field, _, kind, forced in fields:
        given = F.lit(None if forced is None else Z.ENCODINGS[forced]).cast("int").alias("forced")
        each.append(F.struct(F.lit(field).alias("field"), F.col(f"n_{field}_x").alias("row_count"), given, *[z for t in suffixes for z in _sized(kind, f"{field}_{t}")]))
    # a row for each chunk before the choice, which is then one expression for all fields
    e = chunks.select(group, F.explode(F.array(*each)).alias("e")).select(group, "e.*")
    whole, sample = ({n: F.col(f"{n}_{t}") for n in Z.ENCODINGS} for t in ("x", suffixes[-1]))
    e = e.withColumn("chosen_id", F.coalesce("forced", Z.choose(None, sample)))
    unforced = Z.fallback(F.col("chosen_id"), Z.size_of(F.col("chosen_id"), whole), whole["plain"], False)
    e = e.withColumn("encoding_id", F.coalesce("forced", unforced))
    return e.select(group, "field", "row_count", "chosen_id", "encoding_id", Z.size_of(F.col("encoding_id"), whole).alias("encoded_size"), F.col("plain_x").alias("plain_size"))
