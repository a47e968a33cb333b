import glob
import json
import os
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataq import schema as S
from strataq.errors import Corrupt, Invalid, Unsupported
from strataq.layout import Layout
from strataq.operators import groups as G
from strataq.plans.scan import KeyRange, Scan, Test, resolve
from strataq.schema import Field, Schema
from strataq.sources.segment import Execution, Segment, SegmentWriter, WriterMetrics, shards

SCAN30 = Schema(21, (Field(1, "key", "int64", False), Field(2, "category", "string"), Field(3, "score", "int32"), Field(4, "payload", "binary", False)))
LAYOUT30 = Layout(5, 1024, (1,), (1, 2, 3), (2,))


def frame30(spark, start=0, stop=30):
    rows = [
        (i, None if i % 6 == 0 else "even" if i % 2 == 0 else "odd", None if i % 7 == 0 else i * 10, bytearray(f"p{i}", "ascii"))
        for i in range(start, stop)
    ]
    return spark.createDataFrame(rows, SCAN30.struct()).coalesce(1)


@pytest.fixture(scope="module")
def seg30(spark, tmp_path_factory):
    w = SegmentWriter(spark, str(tmp_path_factory.mktemp("seg") / "scan30"), SCAN30, LAYOUT30)
    w.append(frame30(spark))
    return w.finish()


def keys(result):
    return [r["key"] for r in result.frame().collect()]


def test_groups_and_round_trip(seg30):
    assert seg30.num_row_groups == 6 and seg30.num_rows == 30
    assert [r["key"] for r in seg30.read_all().collect()] == list(range(30))


def test_main_plan_and_counters(seg30):
    plan = Scan((4, 1), (Test(2, "eq", "even"), Test(3, "ge", 100)), limit=4, batch_rows=2)
    s = seg30.scan(plan)
    assert keys(s) == [10, 16, 20, 22]
    assert [b.num_rows for b in s.batches()] == [2, 2]
    m = s.metrics()
    assert (m.row_groups_considered, m.row_groups_pruned) == (5, 2)
    assert (m.predicate_chunks, m.projection_chunks, m.column_chunks_read) == (6, 6, 12)
    assert (m.predicate_rows, m.projection_rows, m.selection_indices) == (30, 8, 4)


@pytest.mark.parametrize("n", [0, 1, 7, 30])
def test_limit_reads_no_later_group(seg30, n):
    s = seg30.scan(Scan((4, 1), limit=n))
    assert keys(s) == list(range(n))
    m = s.metrics()
    assert (m.row_groups_considered, m.column_chunks_read) == (-(-n // 5), 2 * -(-n // 5))


def test_rebatching(seg30):
    assert [b.num_rows for b in seg30.scan(Scan((4, 1, 2, 3), batch_rows=7)).batches()] == [7, 7, 7, 7, 2]


def test_empty_projection(seg30):
    s = seg30.scan(Scan((), batch_rows=7))
    assert [b.num_rows for b in s.batches()] == [7, 7, 7, 7, 2] and s.metrics().column_chunks_read == 0
    assert [b.num_rows for b in seg30.scan(Scan((), (Test(1, "lt", 3),), batch_rows=2)).batches()] == [2, 1]


def test_whole_group_proof(spark, seg30):
    m = seg30.scan(Scan((4,), (Test(1, "ge", 10),))).metrics()
    assert (m.row_groups_pruned, m.predicate_chunks, m.projection_chunks) == (2, 0, 4)
    bare = Segment.open(spark, seg30.path, use_index=False).scan(Scan((4,), (Test(1, "ge", 10),)))
    m = bare.metrics()
    assert (m.row_groups_pruned, m.predicate_chunks) == (0, 6) and bare.count() == 20


def test_shared_filter_columns(seg30):
    s = seg30.scan(Scan((4, 1), (Test(1, "ge", 8), Test(2, "eq", "even"), Test(1, "lt", 22)), KeyRange((10,), (20,))))
    assert keys(s) == [10, 14, 16]
    m = s.metrics()
    assert (m.predicate_chunks, m.projection_chunks, m.column_chunks_read) == (4, 2, 6)


def test_bloom_prunes_what_statistics_leave(spark, seg30):
    m = seg30.scan(Scan((1,), (Test(2, "eq", "many"),))).metrics()
    assert (m.row_groups_considered, m.row_groups_pruned, m.column_chunks_read) == (6, 6, 0)
    bare = Segment.open(spark, seg30.path, use_index=False).scan(Scan((1,), (Test(2, "eq", "many"),)))
    assert (bare.metrics().row_groups_pruned, bare.metrics().column_chunks_read, bare.count()) == (0, 6, 0)


def test_range_counters(seg30):
    s = seg30.scan(Scan((1,), key_range=KeyRange((12,), (18,)), batch_rows=4))
    assert [b.num_rows for b in s.batches()] == [4, 2] and keys(s) == list(range(12, 18))
    assert (s.metrics().row_groups_pruned, s.metrics().column_chunks_read) == (4, 2)
    whole = seg30.scan(Scan((4,), key_range=KeyRange((10,), (20,)))).metrics()
    assert (whole.row_groups_pruned, whole.predicate_chunks, whole.column_chunks_read) == (4, 0, 2)
    open_ = seg30.scan(Scan((4,), key_range=KeyRange((10,), (20,), False, False))).metrics()
    assert (open_.predicate_chunks, open_.column_chunks_read) == (1, 3)


@pytest.mark.parametrize(
    "op,value,want",
    [("eq", 10, 1), ("ne", 10, 29), ("lt", 10, 10), ("le", 10, 11), ("gt", 10, 19), ("ge", 10, 20)],
)
def test_operators(seg30, op, value, want):
    assert seg30.scan(Scan((1,), (Test(1, op, value),))).count() == want


def test_null_tests(seg30):
    assert keys(seg30.scan(Scan((1,), (Test(3, "is_null"),)))) == [0, 7, 14, 21, 28]
    assert seg30.scan(Scan((1,), (Test(3, "is_not_null"),))).count() == 25
    assert seg30.scan(Scan((1,), (Test(3, "ne", 10),))).count() == 24  # nulls never match


@pytest.mark.parametrize("workers", [1, 2, 4, 8])
def test_parallel_scan_is_the_serial_one(seg30, workers):
    plan = Scan((1, 2), (Test(1, "ge", 3),))
    want = [tuple(r) for r in seg30.scan(plan).frame().collect()]
    assert [tuple(r) for r in seg30.scan(plan, Execution(workers)).frame().collect()] == want


def test_shards_cover_a_scan_once(seg30):
    assert sorted(r["key"] for r in shards(seg30, Scan((1,)), [(7,), (20,)]).collect()) == list(range(30))


@pytest.mark.parametrize(
    "plan",
    [
        Scan((9,)), Scan((1, 1)), Scan((1,), batch_rows=0), Scan((1,), (Test(9, "eq", 1),)), Scan((1,), (Test(1, "eq"),)),
        Scan((1,), (Test(1, "eq", "x"),)), Scan((1,), (Test(1, "eq", 1.0),)), Scan((1,), (Test(3, "eq", 2**31),)), Scan((1,), (Test(1, "eq", True),)),
        Scan((1,), (Test(1, "is_null", 3),)), Scan((1,), (Test(1, "like", 3),)), Scan((1,), key_range=KeyRange((1, 2))),
        Scan((1,), key_range=KeyRange((5,), (4,))), Scan((1,), key_range=KeyRange((None,))), Scan((1,), key_range=KeyRange(("a",))),
    ],
)
def test_bad_plans(seg30, plan):
    with pytest.raises(Invalid):
        seg30.scan(plan)


def test_range_needs_a_key_and_numbers():
    plain = Layout(5)
    with pytest.raises(Invalid):
        resolve(Scan((1,), key_range=KeyRange((1,))), SCAN30, plain)
    one = Schema(1, (Field(1, "x", "float64", False),))
    with pytest.raises(Invalid):
        resolve(Scan((1,), key_range=KeyRange((float("nan"),))), one, Layout(sort_key=(1,)))
    resolve(Scan((1,), (Test(1, "eq", float("nan")),)), one, Layout())  # a NaN literal is allowed


@pytest.mark.parametrize("execution", [Execution(0), Execution(65), Execution(1, 0), Execution(1, 1, 0)])
def test_bad_execution(seg30, execution):
    with pytest.raises(Invalid):
        seg30.scan(Scan((1,)), execution)


def test_schema_and_layout_rules():
    with pytest.raises(Invalid):
        Schema(1, (Field(1, "a", "int32"), Field(1, "b", "int32"))).validate()
    for kind in ("list<int32>", "decimal(10,2)", "date32"):
        with pytest.raises(Unsupported):
            Schema(1, (Field(1, "a", kind),)).validate()
    with pytest.raises(Unsupported):
        Schema(1, (Field(1, "a", "int32", True, 5),)).validate()
    for bad in (Layout(0), Layout(sample_rows=0), Layout(sort_key=(2,)), Layout(statistics=(1, 1)), Layout(bloom=(9,)), Layout(forced={1: "compact"}), Layout(forced={1: "zip"})):
        with pytest.raises(Invalid):
            bad.validate(SCAN30)
    with pytest.raises(Unsupported):
        S.kind_of(T.ArrayType(T.LongType()))
    Schema(1, ()).validate()
    Schema(1, (Field(1, "a", "int32"), Field(2, "a", "int32"))).validate()  # equal names are fine


def one(spark, tmp_path, kind, values, layout=Layout(), nullable=True, finish=True):
    schema = Schema(1, (Field(1, "value", kind, nullable),))
    w = SegmentWriter(spark, str(tmp_path / "one"), schema, layout)
    w.append(spark.createDataFrame([(v,) for v in values], schema.struct()).coalesce(1))
    return w.finish() if finish else w


def test_nan(spark, tmp_path):
    s = one(spark, tmp_path, "float64", [float("nan"), 1.0, None], Layout(statistics=(1,)))
    count = lambda op, v=None: s.scan(Scan((1,), (Test(1, op, v),))).count()
    assert [count("ne", float("nan")), count("eq", float("nan")), count("ge", 0.5), count("gt", 1.0), count("ne", 1.0), count("is_null")] == [2, 0, 1, 0, 1, 1]
    assert s.index().first()["min_1"] is None


def test_signed_zero(spark, tmp_path):
    s = one(spark, tmp_path, "float64", [0.0, -0.0, 1.0], Layout(statistics=(1,), bloom=(1,)))
    r = s.scan(Scan((1,), (Test(1, "eq", -0.0),)))
    assert r.count() == 2 and r.metrics().row_groups_pruned == 0


def test_empty_dataset(spark, tmp_path):
    schema = Schema(1, (Field(1, "value", "int32", False),))
    s = SegmentWriter(spark, str(tmp_path / "none"), schema, Layout()).finish()
    assert s.num_row_groups == 0 and s.read_all().columns == ["value"] and s.read_all().count() == 0
    assert list(s.scan(Scan((1,))).batches()) == []
    s.verify()


def test_writer_checks(spark, tmp_path):
    key = Schema(1, (Field(1, "key", "int64", False),))
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "key long").coalesce(1)
    w = SegmentWriter(spark, str(tmp_path / "a"), key, Layout(2, sort_key=(1,)))
    for bad in (rows(1, 3, 2), rows(1, 2, 3, 2), rows(1, None)):
        with pytest.raises(Invalid):
            w.append(bad)
    w.append(rows(1, 3))
    with pytest.raises(Invalid):
        w.append(rows(2, 4))
    w.append(rows(3, 4))
    with pytest.raises(Invalid):
        w.append(rows(5).withColumnRenamed("key", "other"))
    with pytest.raises(Invalid):
        w.append(spark.createDataFrame([(1,)], "key int"))
    s = w.finish()
    assert [r[0] for r in s.read_all().collect()] == [1, 3, 3, 4]
    with pytest.raises(Invalid):
        w.append(rows(9))
    with pytest.raises(Invalid):
        w.finish()
    unsigned = Schema(1, (Field(1, "u", "uint8"),))
    w = SegmentWriter(spark, str(tmp_path / "u"), unsigned, Layout())
    with pytest.raises(Invalid):
        w.append(spark.createDataFrame([(256,)], "u short"))


def test_appends_never_share_a_group(spark, tmp_path):
    w = SegmentWriter(spark, str(tmp_path / "x"), SCAN30, LAYOUT30)
    w.append(frame30(spark, 0, 7))
    w.append(frame30(spark, 7, 30))
    s = w.finish()
    assert [r["row_count"] for r in s.index().orderBy("__rg").collect()] == [5, 2, 5, 5, 5, 5, 3]
    assert [r["key"] for r in s.read_all().collect()] == list(range(30))
    s.verify()


def test_composite_key(spark, tmp_path):
    schema = Schema(1, (Field(1, "major", "int32", False), Field(2, "minor", "string", False), Field(3, "value", "int64", False)))
    w = SegmentWriter(spark, str(tmp_path / "c"), schema, Layout(2, sort_key=(1, 2)))
    w.append(spark.createDataFrame([(1, "a", 10), (1, "c", 11), (2, "a", 12), (2, "b", 13), (3, "a", 14)], schema.struct()).coalesce(1))
    s = w.finish()
    got = lambda a, b: [r[0] for r in s.scan(Scan((3,), key_range=KeyRange(a, b))).frame().collect()]
    assert got((1, "b"), (2, "b")) == [11, 12] and got((2, "a"), (3, "a")) == [12, 13]
    assert s.scan(Scan((3,), key_range=KeyRange((2, "a"), (3, "a")))).metrics().predicate_chunks == 0


def test_rename_keeps_data(spark, seg30):
    renamed = Schema(22, tuple(Field(f.id, f.name + "_new", f.kind, f.nullable) for f in SCAN30.fields))
    other = Segment(spark, seg30.path, seg30.manifest | {"schema": renamed.to_json()})
    assert other.read_all().columns == ["key_new", "category_new", "score_new", "payload_new"]
    assert other.read_all().count() == 30


def test_corruption_is_found(spark, tmp_path):
    s = one(spark, tmp_path, "int64", list(range(2000)), Layout(512, statistics=(1,)))
    s.verify()
    path = max(glob.glob(f"{s.path}/data/*/*.parquet"), key=os.path.getsize)
    raw = bytearray(open(path, "rb").read())
    raw[60] ^= 0xFF
    open(path, "wb").write(bytes(raw))
    for crc in glob.glob(f"{s.path}/data/*/.*.crc"):
        os.remove(crc)
    with pytest.raises(Corrupt):
        s.verify()
    with pytest.raises(Exception):
        s.read_all().collect()


def test_manifest_gates(spark, tmp_path):
    s = one(spark, tmp_path, "int64", [1])
    with pytest.raises(Unsupported):
        Segment.open(spark, s.path, bypass_cache=True)
    part = glob.glob(f"{s.path}/manifest/part-*")[0]
    sealed = json.loads(open(part).read())
    for crc in glob.glob(f"{s.path}/manifest/.*.crc"):
        os.remove(crc)
    open(part, "w").write(json.dumps(sealed | {"crc32c": sealed["crc32c"] ^ 1}) + "\n")
    with pytest.raises(Corrupt):
        Segment.open(spark, s.path)
    with pytest.raises(Corrupt):
        Segment.open(spark, str(tmp_path / "nowhere"))


def test_writer_metrics(spark, tmp_path):
    m = WriterMetrics(rows=5)
    schema = Schema(1, (Field(1, "a", "int64"), Field(2, "b", "string")))
    w = SegmentWriter(spark, str(tmp_path / "m"), schema, Layout(50), m)
    assert m.rows == 0
    w.append(spark.range(100).select(F.lit(7).cast("long").alias("a"), F.concat(F.lit("unique-long-value-"), "id").alias("b")).coalesce(1))
    w.finish()
    assert (m.rows, m.row_groups, m.chunks) == (100, 2, 4) and m.encoding_counts == {2: 2, 4: 2}


def test_stream_append(spark, tmp_path):
    from strataq.streaming.append import append_batches, run_once

    spark.range(20).select(F.col("id").alias("key")).write.parquet(str(tmp_path / "in"))
    schema = Schema(1, (Field(1, "key", "int64", False),))
    w = SegmentWriter(spark, str(tmp_path / "s"), schema, Layout(8))
    run_once(spark.readStream.schema("key long").parquet(str(tmp_path / "in")), w, str(tmp_path / "ck"))
    each = append_batches(w)
    extra = spark.createDataFrame([Row(key=100)])
    each(extra, 7)
    each(extra, 7)  # delivered again
    assert w.finish().read_all().count() == 21


def test_append_behind_a_shuffle_keeps_every_row(spark, tmp_path):
    """Counting and writing may coalesce the shuffle differently; rows went then."""
    w = SegmentWriter(spark, str(tmp_path / "wide"), SCAN30, Layout(4096, 1024, (1,), (1,)))
    df = spark.range(150_000).selectExpr("id AS key", "'even' AS category", "CAST(id AS INT) AS score", "CAST(repeat(sha2(string(id), 256), 4) AS BINARY) AS payload")
    w.append(df.repartition(8).orderBy("key"))
    assert w.rows == 150_000
    assert w._stored(f"{w.path}/data").filter(f"{G.POSITION} = {S.column(1)}").count() == 150_000


def test_append_refuses_a_loss(spark, tmp_path, monkeypatch):
    placed = G.with_position
    monkeypatch.setattr(G, "with_position", lambda *a: placed(*a).filter(f"{G.POSITION} != 3"))
    w = SegmentWriter(spark, str(tmp_path / "less"), SCAN30, LAYOUT30)
    with pytest.raises(Corrupt, match="29 rows written of 30"):
        w.append(frame30(spark))
    assert w.rows == 0 and sorted(os.listdir(tmp_path / "less" / "data")) == ["none"]


def scanned_rows(frame):
    """Rows that the Parquet scans of a frame put out when it runs."""
    frame.collect()
    plan, out = frame._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec":
            out += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_only_groups_that_the_index_leaves_are_read(spark, seg30):
    read = lambda plan, **k: scanned_rows(Segment.open(spark, seg30.path, **k).scan(plan).unordered())
    assert read(Scan((4,), (Test(1, "ge", 10),))) == 20  # proven whole
    assert read(Scan((4,), (Test(1, "ge", 12),))) == 20
    assert read(Scan((1,), (Test(2, "eq", "many"),))) == 0  # in the range, not in the Bloom bitmaps
    assert read(Scan((4,), key_range=KeyRange((12,), (18,)))) == 10
    whole = Segment.open(spark, seg30.path).scan(Scan((4,), (Test(1, "ge", 10),))).unordered()
    scans = [x for x in whole._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x]
    assert len(scans) == 1 and "f1:" not in scans[0]  # nor is the filter's column


@pytest.fixture()
def two_files(spark, tmp_path):
    """Two appends; the second one's file is broken."""
    w = SegmentWriter(spark, str(tmp_path / "two"), SCAN30, LAYOUT30)
    w.append(frame30(spark, 0, 15))
    w.append(frame30(spark, 15, 30))
    s = w.finish()
    for path in glob.glob(f"{s.path}/data/append-000001/*.parquet"):
        open(path, "r+b").truncate(40)
    for crc in glob.glob(f"{s.path}/data/append-000001/.*.crc"):
        os.remove(crc)
    return s


def test_a_broken_file_that_is_not_needed(two_files):
    assert keys(two_files.scan(Scan((1,), (Test(1, "lt", 15),)))) == list(range(15))
    assert keys(two_files.scan(Scan((1,), limit=15))) == list(range(15))
    assert keys(two_files.scan(Scan((1,), (Test(3, "is_null"),), limit=3))) == [0, 7, 14]
    assert sum(b.num_rows for b in two_files.scan(Scan((1,), (Test(3, "is_null"),), limit=3)).batches()) == 3
    with pytest.raises(Exception):
        keys(two_files.scan(Scan((1,), limit=16)))


@pytest.mark.parametrize("workers", [1, 3])
def test_batches_before_a_broken_piece_come_out(two_files, workers):
    s = two_files.scan(Scan((1,), batch_rows=5), Execution(workers, 2, 2 * (5 * (16 + 16) + 4096)))
    got = []
    with pytest.raises(Exception):
        for b in s.batches():
            got += b.column(0).to_pylist()
    assert got == list(range(15))


@pytest.mark.parametrize("workers", [1, 2, 4])
def test_budgets_of_a_parallel_scan(seg30, workers):
    plan = Scan((1, 2), (Test(3, "is_not_null"),), batch_rows=4)
    want = [tuple(r) for r in seg30.scan(plan).frame().collect()]
    s = seg30.scan(plan, Execution(workers, 3, 20_000))
    batches = list(s.batches())
    assert [tuple(r.values()) for b in batches for r in b.to_pylist()] == want
    assert [b.num_rows for b in batches] == [4] * 6 + [1]
    if workers > 1:
        assert s.last.parallel_tasks == 6 and s.last.parallel_peak_in_flight <= 3 and s.last.parallel_peak_bytes <= 20_000


def test_slices_and_concatenations(seg30):
    s = seg30.scan(Scan((1,), batch_rows=7), Execution(1, 1, 1))  # a group at a time
    assert [b.num_rows for b in s.batches()] == [7, 7, 7, 7, 2]
    assert (s.last.output_slices, s.last.output_concatenations, s.last.rows_returned) == (4, 4, 30)


def test_bytes_are_those_of_the_chosen_encodings(seg30):
    m = seg30.scan(Scan((4,), (Test(1, "ge", 12),))).metrics()
    size = {(r["__rg"], r["field"]): r["encoded_size"] for r in seg30.encodings().collect()}
    assert m.predicate_bytes == size[2, 1] and m.projection_bytes == sum(size[g, 4] for g in (2, 3, 4, 5))


def test_directory_is_checked_at_open(spark, tmp_path):
    s = one(spark, tmp_path, "int64", list(range(20)), Layout(5, sort_key=(1,)), nullable=False)
    for change in ({"rows": 21}, {"groups": 3}):
        with pytest.raises(Corrupt, match="format.directory"):
            Segment(spark, s.path, s.manifest | change).check_directory()
    index = spark.read.parquet(f"{s.path}/index").collect()
    turned = [r.asDict() | {"first_key": index[3 - k]["first_key"], "last_key": index[3 - k]["last_key"]} for k, r in enumerate(index)]
    spark.createDataFrame(turned, spark.read.parquet(f"{s.path}/index").schema).write.mode("overwrite").parquet(f"{s.path}/index2")
    os.rename(f"{s.path}/index", f"{s.path}/index1")
    os.rename(f"{s.path}/index2", f"{s.path}/index")
    with pytest.raises(Corrupt, match="index.order"):
        Segment.open(spark, s.path)


def test_ranges_of_groups():
    from strataq.sources import segment

    assert segment._runs([1, 2, 3, 7, 9, 10]) == [(1, 3), (7, 7), (9, 10)]
    many = segment._runs([2 * k for k in range(1000)] + [5000])
    assert len(many) == segment.MOST_RUNS and many[-1] == (5000, 5000) and many[0][0] == 0


def test_the_filter_of_scattered_groups_is_compiled(spark, tmp_path):
    schema = Schema(1, tuple(Field(k, f"c{k}", "int64", k > 1) for k in range(1, 10)))
    w = SegmentWriter(spark, str(tmp_path / "s"), schema, Layout(4, 1024, (1,), (1,), (2,)))
    w.append(spark.range(2000).selectExpr("id AS c1", "IF(id div 4 % 2 = 0, 11, id) AS c2", *[f"id * {k} AS c{k}" for k in range(3, 10)]))
    scan = w.finish().scan(Scan(tuple(range(1, 10)), (Test(2, "eq", 11),)))
    planned = [x.group for x in scan.planned()]
    assert len(planned) < 400 and set(range(0, 500, 2)) <= set(planned)
    rows = scan.unordered()
    text = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "codegen")
    largest = max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text))
    assert 0 < largest < 8000  # HotSpot interprets larger methods
    assert sorted(r["c1"] for r in rows.collect()) == [k for k in range(2000) if k // 4 % 2 == 0]


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    schema, path = Schema(1, (Field(1, "key", "int64", False),)), str(tmp_path / "s")
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "key long")
    w = SegmentWriter(spark, path, schema, Layout(8))
    w.append(rows(1, 2), 0)
    w.append(rows(3), 1)
    again = SegmentWriter(spark, path, schema, Layout(8), resume=True)
    again.append(rows(3), 1)  # delivered again
    again.append(rows(4), 2)
    assert sorted(r[0] for r in again.finish().read_all().collect()) == [1, 2, 3, 4]


def test_take(seg30):
    got = lambda p, **k: [r[0] for r in seg30.take(p, **k).collect()]
    assert got([0, 3, 4, 29]) == [0, 3, 4, 29] and got([]) == [] and got([7], project=(3,)) == [None]
    for bad in ([3, 3], [4, 2], [-1], [30], [1.0], [True]):
        with pytest.raises(Invalid):
            seg30.take(bad)
