import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataq.functions import sizes as Z
from strataq.layout import Layout
from strataq.operators import bloom, zones
from strataq.operators import encodings as E
from strataq.operators import groups as G
from strataq.operators.bloom import bits_for, build, probe
from strataq.operators.groups import GROUP, POSITION
from strataq.plans.scan import literal
from strataq.schema import Field, Schema
from strataq.sources.integrity import crc32c


def chunk(spark, values, kind, rows=1 << 20):
    data = [(i, i // rows, v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, f"{POSITION} long, {GROUP} long, x {kind}")


def pick(spark, values, kind, spark_kind, sample=1024):
    return E.select_encoding(chunk(spark, values, spark_kind), "x", kind, sample).first()["encoding_id"]


def test_selector(spark):
    assert pick(spark, [7] * 100, "int64", "long") == Z.ENCODINGS["rle"]
    assert pick(spark, list(range(100)), "int64", "long") == Z.ENCODINGS["for"]
    assert pick(spark, ["alpha", "beta"] * 50, "string", "string") == Z.ENCODINGS["dictionary"]
    assert pick(spark, [f"unique-long-value-{i}" for i in range(100)], "string", "string") == Z.ENCODINGS["compact"]
    assert pick(spark, [1.5] * 100, "float64", "double") == Z.ENCODINGS["plain"]


@pytest.mark.parametrize("distinct,want", [(255, 1), (257, 1), (800, 1), (900, 4)])
def test_selector_bound(spark, distinct, want):
    values = [None if i % 17 == 0 else f"{i % distinct:024d}" for i in range(1024)]
    assert pick(spark, values, "string", "string") == want


def test_size_fallback(spark):
    values = [0 if i < 1024 else i * 2**50 for i in range(4096)]
    r = E.report(chunk(spark, values, "long"), "x", "int64", 1024).first()
    assert r["chosen_id"] != 0 and r["encoding_id"] == 0 and r["encoded_size"] == r["plain_size"]
    forced = E.report(chunk(spark, values, "long"), "x", "int64", 1024, "rle").first()
    assert forced["encoding_id"] == 2


def test_width_of_extremes(spark):
    values = [-(2**63), 2**63 - 1, 0]
    assert E.for_parameters(chunk(spark, values, "long"), "x").first()["bit_width"] == 64
    for bits in range(1, 64, 7):
        assert E.for_parameters(chunk(spark, [0, 2**bits - 1], "long"), "x").first()["bit_width"] == bits
    frame = chunk(spark, values, "long")
    back = E.for_decode(E.for_encode(frame, "x"), E.for_parameters(frame, "x")).orderBy(POSITION)
    assert [r["value"] for r in back.collect()] == values


def test_round_trips(spark):
    rng = random.Random(0xC0DE)
    values = [None if i % 13 == 0 else 7 if i % 5 == 0 else rng.randrange(-50, 50) for i in range(513)]
    frame = chunk(spark, values, "long", 73)
    runs = E.rle_decode(E.rle_encode(frame, "x")).select((F.col(GROUP) * 73 + F.col("at")).alias("p"), "value").orderBy("p")
    assert [r["value"] for r in runs.collect()] == values
    entries, codes = E.dictionary_entries(frame, "x"), E.dictionary_encode(frame, "x")
    assert [r["value"] for r in E.dictionary_decode(codes, entries).orderBy(POSITION).collect()] == values
    back = E.for_decode(E.for_encode(frame, "x"), E.for_parameters(frame, "x")).orderBy(POSITION)
    assert [r["value"] for r in back.collect()] == values
    first = entries.filter(F.col(GROUP) == 0).orderBy("code").collect()
    seen = list(dict.fromkeys(v for v in values[:73] if v is not None))
    assert [r["value"] for r in first] == seen


def test_bloom_never_loses(spark):
    rng = random.Random(3)
    values = [rng.randrange(10**9) for _ in range(400)]
    frame = chunk(spark, values, "long", 100)
    bits = bits_for(100)
    built, seen = build(frame, "x", bits), frame.select(GROUP).distinct()
    for i in (0, 150, 399):
        may = {r[GROUP]: r["may"] for r in probe(built, seen, literal("int64", values[i]), bits).collect()}
        assert may[i // 100]
    false = sum(r["may"] for k in range(25) for r in probe(built, seen, literal("int64", 10**10 + k), bits).collect())
    assert false <= 5


def test_positions_are_dense(spark):
    df = spark.range(1000).repartition(7)
    placed = G.with_position(df, 50)
    assert sorted(r[POSITION] for r in placed.collect()) == list(range(50, 1050))
    assert G.with_position(df.limit(0)).count() == 0


def test_order_check_spans_groups(spark):
    frame = chunk(spark, [1, 5, 2, 3, 3, 1], "long", 2)
    assert G.count_violations(frame, ["x"]).first()["violations"] == 2


def _bitwise(data):
    state = 0xFFFFFFFF
    for b in data:
        state ^= b
        for _ in range(8):
            state = (state >> 1) ^ (0x82F63B78 if state & 1 else 0)
    return state ^ 0xFFFFFFFF


def test_crc32c():
    assert crc32c(b"123456789") == 0xE3069283
    big = random.Random(1).randbytes(200_000)
    assert crc32c(big) == _bitwise(big) == crc32c(big[777:], crc32c(big[:777]))


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=300))
def test_crc32c_random(data):
    assert crc32c(data) == _bitwise(data)


def test_the_report_on_all_columns_is_that_on_each(spark):
    kinds = {"f1": "int64", "f2": "string", "f3": "bool", "f4": "float64", "f5": "timestamp[us]", "f6": "binary", "f7": "uint8", "f8": "timestamp[ms, UTC]"}
    df = spark.range(1000).selectExpr(
        "id AS __pos", "id div 130 AS __rg", "IF(id % 7 = 0, NULL, id div 40 * 1000003) AS f1", "IF(id % 11 = 0, NULL, concat('v', id % 9)) AS f2", "id % 100 < 60 AS f3",
        "CAST(id AS DOUBLE) AS f4", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS f5", "CAST(repeat('x', CAST(id % 5 AS INT)) AS BINARY) AS f6",
        "CAST(id % 200 AS SHORT) AS f7", "CAST(NULL AS TIMESTAMP) AS f8",
    )
    fields = [(int(c[1:]), c, k, "rle" if c == "f7" else None) for c, k in kinds.items()]
    got = {(r["field"], r["__rg"]): r for r in E.report_all(df, fields, 50).collect()}
    assert len(got) == 8 * 8
    for field, column, kind, forced in fields:
        for r in E.report(df, column, kind, 50, forced).collect():
            mine = got[field, r["__rg"]]
            assert [mine[c] for c in ("row_count", "chosen_id", "encoding_id", "encoded_size", "plain_size")] == [
                r[c] for c in ("row_count", "chosen_id", "encoding_id", "encoded_size", "plain_size")
            ], (column, r)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bounds_and_order_are_gathered_without_sorting_rows(spark):
    schema = Schema(1, (Field(1, "k", "int64", False), Field(2, "l", "int64", False), Field(3, "x", "float64")))
    df = spark.range(3000).selectExpr("id AS f1", "-id AS f2", "CAST(id AS DOUBLE) AS f3", f"id AS {POSITION}", f"id div 1024 AS {GROUP}")
    index = zones.zone_map(df, schema, Layout(1024, 1024, (1, 2), (1, 3)))
    assert "SortAggregate" not in _plan(index)
    ends = {r[GROUP]: (tuple(r["first_key"]), tuple(r["last_key"])) for r in index.collect()}
    assert ends == {0: ((0, 0), (1023, -1023)), 1: ((1024, -1024), (2047, -2047)), 2: ((2048, -2048), (2999, -2999))}
    broken = G.count_violations(df, ["f2", "f1"])
    assert "SortAggregate" not in _plan(broken) and broken.first()["violations"] == 2999


def test_a_report_of_groups_that_the_sample_holds(spark):
    df = spark.range(700).selectExpr("id AS __pos", "id div 130 AS __rg", "IF(id % 7 = 0, NULL, id div 40 * 1000003) AS f1", "concat('v', id % 9) AS f2", "CAST(id AS DOUBLE) AS f3")
    fields = [(1, "f1", "int64", None), (2, "f2", "string", "compact"), (3, "f3", "float64", None)]
    once = E.report_all(df, fields, 130, most_rows=130)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, E.report_all(df, fields, 130).collect()))
    # each column's values are gathered once, and the choice is one for all columns
    plan = once._jdf.queryExecution().analyzed().toString()
    assert plan.count("collect_set(") == 2 and plan.count("array_min(") == 1


@pytest.mark.parametrize("bits", [1 << 10, 1 << 17])
def test_bitmaps_hold_the_bits_of_all_probes(spark, bits):
    values = [None, float("nan"), -0.0, 0.0, *[i % 50 / 4 for i in range(400)]]
    df = chunk(spark, values, "double", 100).repartition(3)
    kept = df.filter("x IS NOT NULL AND NOT isnan(x)").select(GROUP, F.explode(bloom._positions(F.col("x") + F.lit(0.0), bits)).alias("at"))
    want = {(r[GROUP], r["at"]) for r in kept.collect()}
    built = build(df, "x", bits, True)
    got = {(r[GROUP], r["block"] * bloom.BLOCK + 8 * k + j) for r in built.collect() for k, b in enumerate(r["bitmap"]) for j in range(8) if b >> j & 1}
    assert got == want and built.columns == [GROUP, "block", "bitmap"]
