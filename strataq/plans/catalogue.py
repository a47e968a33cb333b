"""Registered queries of the scan engine with their DuckDB SQL.

The driver's tables stand in for datasets: a table's dense key is the position, and
``key div 1024`` the row group, as a writer would have assigned them.  Nulls and NaN
are derived from the key, since the tables hold none.
"""

from __future__ import annotations

import datetime
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq import schema as S
from strataq.layout import Layout
from strataq.operators import bloom, encodings, groups, zones
from strataq.operators.groups import GROUP, POSITION
from strataq.plans.scan import KeyRange, Scan, Test, literal, resolve
from strataq.schema import Field, Schema

GROUP_ROWS, SAMPLE_ROWS = 1024, 1024


@dataclass(frozen=True)
class View:
    """A table read as a dataset."""

    table: str
    key: str
    schema: Schema
    layout: Layout
    derived: dict[str, str]

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """Stored columns (by field id) with position and group."""
        t = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        columns = [F.expr(self.derived.get(f.name, f.name)).cast(S.spark_type(f.kind)).alias(S.column(f.id)) for f in self.schema.fields]
        position = F.col(self.key).cast("long")
        return t.select(*columns, position.alias(POSITION), F.floor(position / GROUP_ROWS).cast("long").alias(GROUP))

    def scan(self, plan: Scan):
        r = resolve(plan, self.schema, self.layout)

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows = self.frame(spark, sf_dir)
            if (c := r.condition()) is not None:
                rows = rows.filter(c)
            if plan.limit is not None:
                rows = rows.orderBy(POSITION).limit(plan.limit)
            return rows.select(*r.output())

        return query

    def index(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return zones.zone_map(self.frame(spark, sf_dir), self.schema, self.layout)


NULLED = "CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id END"
WITH_NAN = "CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END"
TEXT_NULLED = "CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type END"
ZERO = "CASE WHEN event_id % 2 = 0 THEN CAST(-0.0 AS DOUBLE) ELSE value END"

EVENTS = View(
    "events",
    "event_id",
    Schema(
        1,
        (
            Field(1, "event_id", "int64", False),
            Field(2, "ts", "timestamp[us]"),
            Field(3, "user_id", "int64"),
            Field(4, "event_type", "string"),
            Field(5, "value", "float64"),
            Field(6, "v", "int64"),
            Field(7, "x", "float64"),
            Field(8, "t", "string"),
            Field(9, "z", "float64"),
        ),
    ).validate(),
    Layout(GROUP_ROWS, SAMPLE_ROWS, (1,), (1, 3, 5, 6, 7), (3, 4)),
    {"v": NULLED, "x": WITH_NAN, "t": TEXT_NULLED, "z": "CASE WHEN event_id % 2 = 0 THEN -0.0D ELSE value END"},
)

ORDERS = View(
    "orders",
    "o_orderkey",
    Schema(
        1,
        (
            Field(1, "o_orderkey", "int64", False),
            Field(2, "o_custkey", "int64"),
            Field(3, "o_orderstatus", "string"),
            Field(4, "o_totalprice", "float64"),
            Field(5, "o_orderdate", "timestamp[us]"),
            Field(6, "o_orderpriority", "string"),
        ),
    ).validate(),
    Layout(GROUP_ROWS, SAMPLE_ROWS, (1,), (1, 4)),
    {},
)

LINES = View(
    "lineitem",
    "l_orderkey",
    Schema(
        1,
        (
            Field(1, "l_orderkey", "int64", False),
            Field(2, "l_linenumber", "int32", False),
            Field(3, "l_quantity", "float64"),
        ),
    ).validate(),
    Layout(GROUP_ROWS, SAMPLE_ROWS, (1, 2)),
    {},
)

_G = f"""WITH g AS (SELECT *, {NULLED} AS v, {WITH_NAN} AS x, {TEXT_NULLED} AS t, {ZERO} AS z,
  event_id // {GROUP_ROWS} AS rg FROM events)"""


def _events(where: str, columns: str = "event_id, v") -> str:
    return f"{_G} SELECT {columns} FROM g WHERE {where}"


def _plans() -> dict:
    """name -> (view, plan, SQL)."""
    e, o, li = EVENTS, ORDERS, LINES
    day = datetime.datetime(2024, 1, 15)
    t = Test
    out = {
        "pred_eq": (e, Scan((1, 6), (t(6, "eq", 7),)), _events("v = 7")),
        "pred_ne": (e, Scan((1, 6), (t(6, "ne", 7),)), _events("v <> 7")),
        "pred_lt": (e, Scan((1, 6), (t(6, "lt", 5),)), _events("v < 5")),
        "pred_le": (e, Scan((1, 6), (t(6, "le", 5),)), _events("v <= 5")),
        "pred_gt": (e, Scan((1, 6), (t(6, "gt", 9),)), _events("v > 9")),
        "pred_ge": (e, Scan((1, 6), (t(6, "ge", 9),)), _events("v >= 9")),
        "pred_is_null": (e, Scan((1, 6), (t(6, "is_null"),)), _events("v IS NULL")),
        "pred_is_not_null": (e, Scan((1, 6), (t(6, "is_not_null"),)), _events("v IS NOT NULL")),
        "pred_and3": (
            o,
            Scan((1, 4), (t(1, "ge", 750), t(3, "eq", "F"), t(6, "is_not_null"))),
            "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 750 AND o_orderstatus = 'F' AND o_orderpriority IS NOT NULL",
        ),
        "pred_string": (e, Scan((1, 8), (t(8, "ge", "purchase"), t(8, "lt", "view"))), _events("t >= 'purchase' AND t < 'view'", "event_id, t")),
        "pred_timestamp": (e, Scan((1, 2), (t(2, "ge", day),)), _events("ts >= TIMESTAMP '2024-01-15'", "event_id, ts")),
        "nan_ne": (e, Scan((1,), (t(7, "ne", 100.0),)), _events("x <> 100.0", "event_id")),
        "nan_ge_guard": (e, Scan((1,), (t(7, "ge", 100.0),)), _events("x >= 100.0 AND NOT isnan(x)", "event_id")),
        "nan_literal_ne": (e, Scan((1,), (t(7, "ne", float("nan")),)), _events("x IS NOT NULL", "event_id")),
        "nan_literal_eq": (e, Scan((1,), (t(7, "eq", float("nan")),)), _events("false", "event_id")),
        "negative_zero_eq": (e, Scan((1,), (t(9, "eq", 0.0),)), _events("z = 0.0", "event_id")),
        "projection_reorder": (e, Scan((4, 1, 3)), _events("true", "event_type, event_id, user_id")),
        "projection_disjoint": (e, Scan((4,), (t(1, "ge", 500),)), _events("event_id >= 500", "event_type")),
        "range_half_open": (o, Scan((1, 2), key_range=KeyRange((100,), (700,))), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 700"),
        "range_closed": (o, Scan((1, 2), key_range=KeyRange((100,), (700,), True, True)), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 700"),
        "range_exclusive": (o, Scan((1, 2), key_range=KeyRange((100,), (700,), False, False)), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 AND o_orderkey < 700"),
        "range_unbounded": (o, Scan((1, 2), key_range=KeyRange((900,))), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 900"),
        "range_empty": (o, Scan((1,), key_range=KeyRange((100,), (100,), False, False)), "SELECT o_orderkey FROM orders WHERE false"),
        "range_composite": (
            li,
            Scan((1, 2, 3), key_range=KeyRange((100, 3), (200, 3))),
            """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE (l_orderkey > 100 OR (l_orderkey = 100 AND l_linenumber >= 3)) AND (l_orderkey < 200 OR (l_orderkey = 200 AND l_linenumber < 3))""",
        ),
        "limit_ordered": (e, Scan((1, 6), (t(6, "ge", 9),), limit=25), _events("v >= 9") + " ORDER BY event_id LIMIT 25"),
        "limit_zero": (e, Scan((1, 6), limit=0), _events("true") + " LIMIT 0"),
        "full_scan": (o, Scan((1, 2, 3, 4, 5, 6)), "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"),
    }
    return out


def empty_projection_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a scan that projects nothing."""
    r = resolve(Scan((), (Test(6, "ge", 9),)), EVENTS.schema, EVENTS.layout)
    return EVENTS.frame(spark, sf_dir).filter(r.condition()).agg(F.count("*").alias("rows"))


def zone_map(spark, sf_dir):
    index = EVENTS.index(spark, sf_dir)
    first, last = F.col("first_key")["f1"], F.col("last_key")["f1"]
    return index.select(
        F.col(GROUP).alias("rg"), "row_count", F.col("nulls_6").alias("null_count"), F.col("min_6").alias("min_v"), F.col("max_6").alias("max_v"),
        first.alias("first_key"), last.alias("last_key"),
    )


def zone_map_nan_guard(spark, sf_dir):
    return EVENTS.index(spark, sf_dir).select(F.col(GROUP).alias("rg"), F.col("min_7").alias("min_x"), F.col("max_7").alias("max_x"))


def sort_bounds(spark, sf_dir):
    index = zones.zone_map(ORDERS.frame(spark, sf_dir), ORDERS.schema, ORDERS.layout)
    return index.select(F.col(GROUP).alias("rg"), F.col("first_key")["f1"].alias("first_key"), F.col("last_key")["f1"].alias("last_key"))


def sort_violations(spark, sf_dir):
    return groups.count_violations(EVENTS.frame(spark, sf_dir), ["f3"])


def sort_violations_composite(spark, sf_dir):
    return groups.count_violations(EVENTS.frame(spark, sf_dir), ["f4", "f3"])


_CLASSIFIED = Scan((1, 6), (Test(1, "ge", 5000), Test(6, "ge", 20)))
_COUNTED = Scan((4,), (Test(1, "ge", 5000),))


def group_classifier(spark, sf_dir):
    r = resolve(_CLASSIFIED, EVENTS.schema, EVENTS.layout)
    return zones.classify(EVENTS.index(spark, sf_dir), r).select(F.col(GROUP).alias("rg"), "cls")


def scan_counters(spark, sf_dir):
    r = resolve(_COUNTED, EVENTS.schema, EVENTS.layout)
    c = zones.classify(EVENTS.index(spark, sf_dir), r)
    chunks = F.when(F.col("cls") == "none", 0).when(F.col("cls") == "all", 1).otherwise(2)
    return c.agg(F.count("*").alias("considered"), F.count_if(F.col("cls") == "none").alias("pruned"), F.sum(chunks).cast("long").alias("chunks"))


def rle_runs(spark, sf_dir):
    return encodings.rle_encode(EVENTS.frame(spark, sf_dir), "f6").select(F.col(GROUP).alias("rg"), "run_id", "run_len", "run_value")


def rle_decode(spark, sf_dir):
    runs = encodings.rle_encode(EVENTS.frame(spark, sf_dir), "f6")
    return encodings.rle_decode(runs).select((F.col(GROUP) * GROUP_ROWS + F.col("at")).cast("long").alias("event_id"), F.col("value").alias("v"))


def dictionary_codes(spark, sf_dir):
    return encodings.dictionary_entries(EVENTS.frame(spark, sf_dir), "f8").select(F.col(GROUP).alias("rg"), F.col("value").alias("event_type"), "code")


def dictionary_decode(spark, sf_dir):
    frame = EVENTS.frame(spark, sf_dir)
    codes, entries = encodings.dictionary_encode(frame, "f8"), encodings.dictionary_entries(frame, "f8")
    return encodings.dictionary_decode(codes, entries).select(F.col(POSITION).alias("event_id"), F.col("value").alias("t"))


def for_params(spark, sf_dir):
    return encodings.for_parameters(EVENTS.frame(spark, sf_dir), "f6").select(F.col(GROUP).alias("rg"), "base", "bit_width")


def for_deltas(spark, sf_dir):
    return encodings.for_encode(EVENTS.frame(spark, sf_dir), "f6").select(F.col(POSITION).alias("event_id"), F.col("delta").cast("long").alias("delta"))


def for_decode(spark, sf_dir):
    frame = EVENTS.frame(spark, sf_dir)
    return encodings.for_decode(encodings.for_encode(frame, "f6"), encodings.for_parameters(frame, "f6")).select(F.col(POSITION).alias("event_id"), F.col("value").alias("v"))


def plain_sizes(spark, sf_dir):
    return encodings.measure(EVENTS.frame(spark, sf_dir), "f8", "string").select(F.col(GROUP).alias("rg"), "plain_size")


def compact_sizes(spark, sf_dir):
    return encodings.measure(EVENTS.frame(spark, sf_dir), "f8", "string").select(F.col(GROUP).alias("rg"), "compact_size")


def encoding_selector(spark, sf_dir):
    return encodings.select_encoding(EVENTS.frame(spark, sf_dir), "f6", "int64", SAMPLE_ROWS).select(
        F.col(GROUP).alias("rg"), "plain_size", F.col("dictionary_size").alias("dict_size"), "rle_size", "for_size", "encoding_id"
    )


_SKEW = "CASE WHEN event_id % 1024 < 256 THEN 0 ELSE event_id * 9223372036 END"


def size_fallback(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    frame = t.select(F.expr(_SKEW).alias("f1"), F.col("event_id").alias(POSITION), F.floor(F.col("event_id") / GROUP_ROWS).cast("long").alias(GROUP))
    return encodings.report(frame, "f1", "int64", 256).select(F.col(GROUP).alias("rg"), "chosen_id", "encoding_id", "plain_size", "encoded_size")


def bloom_scan(spark, sf_dir):
    """Rows of the groups that a Bloom filter leaves for an equality, filtered."""
    frame = EVENTS.frame(spark, sf_dir)
    bits = bloom.bits_for(GROUP_ROWS)
    built = bloom.build(frame, "f3", bits)
    seen = frame.select(GROUP).distinct()
    may = bloom.probe(built, seen, literal("int64", 11), bits).filter("may").select(GROUP)
    return frame.join(may, GROUP, "left_semi").filter("f3 = 11").select(F.col("f1").alias("event_id"), F.col("f3").alias("user_id"))


def sharded_range_union(spark, sf_dir):
    edges = [None, 200, 600, 1000, None]
    out = None
    for a, b in zip(edges, edges[1:]):
        plan = Scan((1, 2), key_range=KeyRange(None if a is None else (a,), None if b is None else (b,)))
        part = ORDERS.scan(plan)(spark, sf_dir)
        out = part if out is None else out.unionAll(part)
    return out


def _folder(spark: SparkSession, name: str) -> str:
    from strataq.operators.groups import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def roundtrip_all(spark, sf_dir):
    """Write the orders as a dataset, read everything back."""
    from strataq.sources.segment import SegmentWriter

    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select(*[f.name for f in ORDERS.schema.fields])
    writer = SegmentWriter(spark, _folder(spark, "orders"), ORDERS.schema, Layout(4096, 1024, (1,), (1, 4), (3,)))
    writer.append(t.orderBy("o_orderkey"))
    return writer.finish().read_all()


_written: dict = {}


def written(spark: SparkSession, sf_dir: str):
    """The events as a dataset, written once for each session and folder."""
    from strataq.sources.segment import Segment, SegmentWriter

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        names = [f.name for f in EVENTS.schema.fields]
        t = spark.read.parquet(f"{sf_dir}/events.parquet").select(*[F.expr(EVENTS.derived.get(n, n)).alias(n) for n in names])
        writer = SegmentWriter(spark, _folder(spark, "events"), EVENTS.schema, EVENTS.layout)
        writer.append(t.orderBy("event_id"))
        _written[key] = writer.finish().path
    return Segment.open(spark, _written[key])


def _on_segment(plan: Scan):
    return lambda spark, sf_dir: written(spark, sf_dir).scan(plan).frame()


def segment_counters(spark, sf_dir):
    """Groups, chunks and rows of a scan that prunes, proves and filters."""
    m = written(spark, sf_dir).scan(_COUNTED).metrics()
    row = (m.row_groups_considered, m.row_groups_pruned, m.predicate_chunks, m.projection_chunks, m.rows_returned)
    return spark.createDataFrame([row], "considered long, pruned long, predicate_chunks long, projection_chunks long, rows long")


SHARES, WIDTHS = (1, 10, 50, 100), (1, 2, 3)


def selectivity_matrix(spark, sf_dir):
    """Rows and a sum of each scan of a share of the dataset with some columns."""
    segment = written(spark, sf_dir)
    out = None
    for share in SHARES:
        for width in WIDTHS:
            plan = Scan((1, 3, 5)[:width], (Test(1, "lt", segment.num_rows * share // 100),))
            rows = segment.scan(plan).unordered().agg(F.count("*").alias("rows"), F.coalesce(F.sum("event_id"), F.lit(0)).alias("ids"))
            one = rows.select(F.lit(share).alias("share"), F.lit(width).alias("width"), "rows", "ids")
            out = one if out is None else out.unionAll(one)
    return out


WIDE = 16


def wide_narrow(spark, sf_dir):
    """Two of sixteen columns and a filter on a third."""
    wide = Schema(1, tuple(Field(i + 1, f"c{i}", "int64", i > 0) for i in range(WIDE))).validate()
    view = View("events", "event_id", wide, Layout(GROUP_ROWS, SAMPLE_ROWS, (1,)), {f"c{i}": f"event_id * {i + 1}" for i in range(WIDE)})
    return view.scan(Scan((16, 4), (Test(8, "ge", 4000),)))(spark, sf_dir)


def concurrent_requests(spark, sf_dir):
    """Four requests at a time through one reader; each has its own key range."""
    from concurrent.futures import ThreadPoolExecutor

    segment = written(spark, sf_dir)
    edges = [segment.num_rows * k // 4 for k in range(5)]

    def ask(k: int):
        part = segment.scan(Scan((1, 5), key_range=KeyRange((edges[k],), (edges[k + 1],))))
        return k, sum(b.num_rows for b in part.batches())

    with ThreadPoolExecutor(4) as pool:
        return spark.createDataFrame(list(pool.map(ask, range(4))), "request long, rows long")


SEGMENT_PLANS = {
    "segment_filter": Scan((6, 1), (Test(1, "ge", 300), Test(6, "ge", 20))),
    "segment_range": Scan((1, 4), key_range=KeyRange((100,), (900,))),
    "segment_bloom": Scan((1, 3), (Test(3, "eq", 11),)),
    "segment_limit": Scan((1, 6), (Test(6, "ge", 9),), limit=25),
    "segment_nan": Scan((1,), (Test(7, "ge", 100.0),)),
}


def queries() -> dict:
    out = {name: view.scan(plan) for name, (view, plan, _) in _plans().items()} | {name: _on_segment(plan) for name, plan in SEGMENT_PLANS.items()}
    for f in (
        empty_projection_count, zone_map, zone_map_nan_guard, sort_bounds, sort_violations, sort_violations_composite, group_classifier,
        scan_counters, rle_runs, rle_decode, dictionary_codes, dictionary_decode, for_params, for_deltas, for_decode, plain_sizes, compact_sizes,
        encoding_selector, size_fallback, bloom_scan, sharded_range_union, roundtrip_all,
        segment_counters, selectivity_matrix, wide_narrow, concurrent_requests,
    ):
        out[f.__name__] = f
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: sql for name, (_, _, sql) in _plans().items()}
    bits = "CASE WHEN d IS NULL OR d = 0 THEN 0 ELSE length(bin(d)) END"
    size_base = f"""{_G}, a AS (SELECT rg, count(*) AS n, count(*) - count(t) AS nulls, coalesce(sum(octet_length(encode(t))), 0) AS b FROM g GROUP BY rg)"""
    head = "24 + CASE WHEN nulls > 0 THEN (n + 7) // 8 ELSE 0 END"

    def selector(source: str, sample: int) -> str:
        """Sizes of int64 chunks and the choice among them, from rows (rg, rn, v)."""
        return f"""{source},
f AS (SELECT *, CASE WHEN k = 1 OR v IS DISTINCT FROM lag(v) OVER (PARTITION BY rg ORDER BY rn) THEN 1 ELSE 0 END AS brk FROM smp WHERE k <= {sample}),
a AS (SELECT rg, count(*) AS n, CASE WHEN count(v) < count(*) THEN (count(*) + 7) // 8 ELSE 0 END AS vb, count(DISTINCT v) AS dc, sum(brk) AS runs, max(v) - min(v) AS d FROM f GROUP BY rg),
q AS (SELECT rg, CAST(24 + vb + 8 * n AS BIGINT) AS plain, CAST(48 + vb + 8 * dc + n * (CASE WHEN dc <= 256 THEN 1 WHEN dc <= 65536 THEN 2 ELSE 4 END) AS BIGINT) AS dict,
  CAST(16 + runs * 24 AS BIGINT) AS rle, CAST(40 + vb + (n * ({bits}) + 7) // 8 AS BIGINT) AS forb FROM a),
c AS (SELECT *, plain - plain // 10 AS thr FROM q),
s AS (SELECT *, CAST(CASE WHEN dict <= thr AND (rle > thr OR dict <= rle) AND (forb > thr OR dict <= forb) THEN 1
  WHEN rle <= thr AND (forb > thr OR rle <= forb) THEN 2 WHEN forb <= thr THEN 3 ELSE 0 END AS INTEGER) AS enc FROM c)"""

    numbered = f"{_G}, smp AS (SELECT rg, event_id AS rn, v, row_number() OVER (PARTITION BY rg ORDER BY event_id) AS k FROM g)"
    skewed = f"WITH smp AS (SELECT event_id // {GROUP_ROWS} AS rg, event_id AS rn, {_SKEW} AS v, row_number() OVER (PARTITION BY event_id // {GROUP_ROWS} ORDER BY event_id) AS k FROM events)"
    runs = f"""{_G}, f AS (SELECT rg, event_id, v, CASE WHEN row_number() OVER w = 1 OR v IS DISTINCT FROM lag(v) OVER w THEN 1 ELSE 0 END AS brk FROM g WINDOW w AS (PARTITION BY rg ORDER BY event_id)),
r AS (SELECT rg, v, sum(brk) OVER (PARTITION BY rg ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_id FROM f)
SELECT rg, CAST(run_id AS BIGINT) AS run_id, count(*) AS run_len, min(v) AS run_value FROM r GROUP BY rg, run_id"""
    out |= {
        "empty_projection_count": f"{_G} SELECT count(*) AS rows FROM g WHERE v >= 9",
        "zone_map": f"{_G} SELECT rg, count(*) AS row_count, count(*) - count(v) AS null_count, min(v) AS min_v, max(v) AS max_v, min(event_id) AS first_key, max(event_id) AS last_key FROM g GROUP BY rg",
        "zone_map_nan_guard": f"{_G} SELECT rg, CASE WHEN max(CASE WHEN isnan(x) THEN 1 ELSE 0 END) = 1 THEN NULL ELSE min(x) END AS min_x, CASE WHEN max(CASE WHEN isnan(x) THEN 1 ELSE 0 END) = 1 THEN NULL ELSE max(x) END AS max_x FROM g GROUP BY rg",
        "sort_bounds": f"SELECT o_orderkey // {GROUP_ROWS} AS rg, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY rg",
        "sort_violations": "SELECT count(*) AS violations FROM (SELECT user_id, lag(user_id) OVER (ORDER BY event_id) AS p FROM events) q WHERE p > user_id",
        "sort_violations_composite": "SELECT count(*) AS violations FROM (SELECT event_type t, user_id u, lag(event_type) OVER (ORDER BY event_id) AS p, lag(user_id) OVER (ORDER BY event_id) AS q FROM events) x WHERE p > t OR (p = t AND q > u)",
        "group_classifier": f"""{_G}, q AS (SELECT rg, count(*) AS n, count(*) - count(v) AS nulls, min(v) AS mn, max(v) AS mx, min(event_id) AS k0, max(event_id) AS k1 FROM g GROUP BY rg)
SELECT rg, CASE WHEN k1 < 5000 OR nulls = n OR mx < 20 THEN 'none' WHEN k0 >= 5000 AND nulls = 0 AND mn >= 20 THEN 'all' ELSE 'partial' END AS cls FROM q""",
        "scan_counters": f"""{_G}, q AS (SELECT rg, min(event_id) AS k0, max(event_id) AS k1 FROM g GROUP BY rg), k AS (SELECT CASE WHEN k1 < 5000 THEN 'none' WHEN k0 >= 5000 THEN 'all' ELSE 'partial' END AS cls FROM q)
SELECT count(*) AS considered, count(CASE WHEN cls = 'none' THEN 1 END) AS pruned, CAST(sum(CASE cls WHEN 'none' THEN 0 WHEN 'all' THEN 1 ELSE 2 END) AS BIGINT) AS chunks FROM k""",
        "rle_runs": runs,
        "rle_decode": f"{_G} SELECT event_id, v FROM g",
        "dictionary_codes": f"{_G}, o AS (SELECT rg, t, min(event_id) AS f FROM g WHERE t IS NOT NULL GROUP BY rg, t) SELECT rg, t AS event_type, row_number() OVER (PARTITION BY rg ORDER BY f) - 1 AS code FROM o",
        "dictionary_decode": f"{_G} SELECT event_id, t FROM g",
        "for_params": f"{_G}, m AS (SELECT rg, min(v) AS base, max(v) - min(v) AS d FROM g GROUP BY rg) SELECT rg, base, CAST({bits} AS INTEGER) AS bit_width FROM m",
        "for_deltas": f"{_G} SELECT event_id, v - min(v) OVER (PARTITION BY rg) AS delta FROM g",
        "for_decode": f"{_G} SELECT event_id, v FROM g",
        "plain_sizes": f"{size_base} SELECT rg, CAST({head} + 8 * (n + 1) + b AS BIGINT) AS plain_size FROM a",
        "compact_sizes": f"{size_base} SELECT rg, CAST({head} + 4 * (n + 1) + b AS BIGINT) AS compact_size FROM a",
        "encoding_selector": selector(numbered, SAMPLE_ROWS) + " SELECT rg, plain AS plain_size, dict AS dict_size, rle AS rle_size, forb AS for_size, enc AS encoding_id FROM s",
        "size_fallback": selector(skewed, 256).replace("WITH smp", "WITH smp").rstrip()
        + f""", w AS (SELECT rg, count(*) AS n, count(DISTINCT v) AS dc, max(v) - min(v) AS d, sum(brk) AS runs FROM
  (SELECT *, CASE WHEN k = 1 OR v IS DISTINCT FROM lag(v) OVER (PARTITION BY rg ORDER BY rn) THEN 1 ELSE 0 END AS brk FROM smp) GROUP BY rg),
y AS (SELECT rg, CAST(24 + 8 * n AS BIGINT) AS p, CAST(48 + 8 * dc + n * (CASE WHEN dc <= 256 THEN 1 WHEN dc <= 65536 THEN 2 ELSE 4 END) AS BIGINT) AS di,
  CAST(16 + runs * 24 AS BIGINT) AS r, CAST(40 + (n * ({bits}) + 7) // 8 AS BIGINT) AS fo FROM w),
e AS (SELECT rg, enc, p, CASE enc WHEN 1 THEN di WHEN 2 THEN r WHEN 3 THEN fo ELSE p END AS sz FROM y JOIN s USING (rg))
SELECT rg, enc AS chosen_id, CAST(CASE WHEN enc > 0 AND sz >= p THEN 0 ELSE enc END AS INTEGER) AS encoding_id, p AS plain_size, CASE WHEN enc > 0 AND sz >= p THEN p ELSE sz END AS encoded_size FROM e""",
        "bloom_scan": "SELECT event_id, user_id FROM events WHERE user_id = 11",
        "sharded_range_union": "SELECT o_orderkey, o_custkey FROM orders",
        "segment_filter": _events("event_id >= 300 AND v >= 20", "v, event_id"),
        "segment_range": _events("event_id >= 100 AND event_id < 900", "event_id, event_type"),
        "segment_bloom": "SELECT event_id, user_id FROM events WHERE user_id = 11",
        "segment_limit": _events("v >= 9") + " ORDER BY event_id LIMIT 25",
        "segment_nan": _events("x >= 100.0 AND NOT isnan(x)", "event_id"),
        "segment_counters": f"""{_G}, q AS (SELECT rg, min(event_id) AS k0, max(event_id) AS k1, count(CASE WHEN event_id >= 5000 THEN 1 END) AS hits FROM g GROUP BY rg),
k AS (SELECT *, CASE WHEN k1 < 5000 THEN 'none' WHEN k0 >= 5000 THEN 'all' ELSE 'partial' END AS cls FROM q)
SELECT count(*) AS considered, count(CASE WHEN cls = 'none' THEN 1 END) AS pruned, count(CASE WHEN cls = 'partial' THEN 1 END) AS predicate_chunks,
  count(CASE WHEN cls <> 'none' AND hits > 0 THEN 1 END) AS projection_chunks, CAST(sum(hits) AS BIGINT) AS rows FROM k""",
        "selectivity_matrix": f"""WITH s AS (SELECT unnest([{", ".join(map(str, SHARES))}]) AS share), w AS (SELECT unnest([{", ".join(map(str, WIDTHS))}]) AS width), n AS (SELECT count(*) AS n FROM events)
SELECT CAST(share AS INTEGER) AS share, CAST(width AS INTEGER) AS width, count(event_id) AS rows, CAST(coalesce(sum(event_id), 0) AS BIGINT) AS ids
FROM s CROSS JOIN w CROSS JOIN n LEFT JOIN events ON event_id < n * share // 100 GROUP BY share, width""",
        "wide_narrow": "SELECT event_id * 16 AS c15, event_id * 4 AS c3 FROM events WHERE event_id * 8 >= 4000",
        "concurrent_requests": "SELECT CAST(k AS BIGINT) AS request, (SELECT count(*) FROM events WHERE event_id >= (SELECT count(*) FROM events) * k // 4 AND event_id < (SELECT count(*) FROM events) * (k + 1) // 4) AS rows FROM (SELECT unnest(range(4)) AS k)",
        "roundtrip_all": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders",
    }
    return out
