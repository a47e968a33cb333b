"""Immutable indexed datasets: writer and reader.

A dataset is a folder: ``data`` (Parquet, columns named by field id, with a position
and a row group), ``index`` (a row per group: file, zone map and sort bounds),
``bloom_<id>`` (bitmaps), ``encodings`` (a row per chunk) and ``manifest``, written
last.  Without a manifest the dataset isn't there.

A scan is planned from the index: groups that statistics, Bloom bitmaps or sort bounds
rule out aren't read (neither are files that hold no other), groups that they prove
whole are read without the filter and its columns, and a limit ends the scan at the
group that fills it.  A group is a Parquet row group, so a range of group numbers in
the filter is all that the reader needs to skip the others.
"""

from __future__ import annotations

import json
import time
from collections import deque
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataq import schema as S
from strataq.errors import Corrupt, Invalid, Unsupported
from strataq.layout import Layout
from strataq.operators import bloom, encodings, groups, zones
from strataq.operators.groups import GROUP, POSITION
from strataq.plans.scan import Resolved, Scan, literal, resolve
from strataq.sources import integrity

FORMAT, INDEX_FORMAT = 1, 1
MOST_WORKERS = 64
MOST_LISTED = 100_000  # groups that a frame lists on the driver; beyond, Parquet's own statistics prune
MOST_RUNS = 32  # ranges of groups in a filter; more are drawn together over the smallest gaps.  The filter's
# code has to stay under the 8,000 bytes that the JVM compiles; Parquet's statistics still rule groups in the gaps out
PIECE_GROUPS = 200  # groups of a piece of a scan after which a gap ends it
WAVE = 1  # groups that a limit looks at first; twice as many each time
GROUP_BYTES = 4096  # for a group, beside its values, in the budget of a parallel scan


@dataclass
class WriterMetrics:
    """Counters of one writer; reset when it is opened."""

    rows: int = 0
    row_groups: int = 0
    appends: int = 0
    chunks: int = 0
    encoding_counts: dict = field(default_factory=dict)
    size_fallbacks: int = 0
    encoded_bytes: int = 0
    plain_bytes: int = 0
    seconds: float = 0.0


@dataclass
class ScanMetrics:
    """Counters of one scan: of its groups and chunks (``ScanResult.metrics``), and of
    the last run of ``ScanResult.batches``."""

    row_groups_considered: int = 0
    row_groups_pruned: int = 0
    column_chunks_read: int = 0
    predicate_chunks: int = 0
    projection_chunks: int = 0
    predicate_bytes: int = 0
    projection_bytes: int = 0
    predicate_rows: int = 0
    projection_rows: int = 0
    rows_examined: int = 0
    selection_indices: int = 0
    rows_returned: int = 0
    output_slices: int = 0
    output_concatenations: int = 0
    parallel_workers: int = 0
    parallel_tasks: int = 0
    parallel_peak_in_flight: int = 0
    parallel_peak_bytes: int = 0
    plan_seconds: float = 0.0
    read_seconds: float = 0.0


@dataclass(frozen=True)
class Execution:
    """Limits of ``ScanResult.batches``: pieces of consecutive groups are read by
    ``workers`` jobs at a time, at most ``in_flight`` pieces and ``max_bytes`` of stored
    values are read or wait their turn.  One worker reads a piece when it is wanted."""

    workers: int = 1
    in_flight: int = 4
    max_bytes: int = 64 << 20

    def validate(self) -> "Execution":
        if not 1 <= self.workers <= MOST_WORKERS:
            raise Invalid("scan.workers", f"workers must be 1 to {MOST_WORKERS}")
        if self.in_flight <= 0 or self.max_bytes <= 0:
            raise Invalid("scan.budget", "budgets must be positive")
        return self


class SegmentWriter:
    """Open, append frames in row order, finish.  Row groups never span two appends.

    Every append that holds is noted in ``journal``, the number of its stream batch with
    it.  ``resume`` goes on behind the noted appends; without it the dataset is begun
    anew."""

    def __init__(self, spark: SparkSession, path: str, schema: S.Schema, layout: Layout, metrics: WriterMetrics | None = None, resume: bool = False):
        self.spark, self.path, self.schema, self.layout = spark, path.rstrip("/"), schema.validate(), layout.validate(schema)
        self.metrics = metrics if metrics is not None else WriterMetrics()
        self.metrics.__dict__.update(WriterMetrics().__dict__)
        self.rows = self.groups = self.appends = 0
        self.last_batch = -1
        self.finished = False
        delete(spark, f"{self.path}/manifest")
        if resume and _exists(spark, f"{self.path}/journal"):
            noted = json.loads(_text(spark, f"{self.path}/journal"))
            self.rows, self.groups, self.appends, self.last_batch = (noted[k] for k in ("rows", "groups", "appends", "last_batch"))
            return
        delete(spark, f"{self.path}/journal")
        delete(spark, f"{self.path}/data")
        self._empty().write.parquet(f"{self.path}/data/none")

    def _empty(self) -> DataFrame:
        stored = self.schema.stored().add(POSITION, "long").add(GROUP, "long")
        return self.spark.createDataFrame([], stored)

    def append(self, df: DataFrame, batch: int | None = None) -> None:
        """Add the rows of a frame, in its order.  Checks names and types, nulls,
        ranges of unsigned types and the sort order before anything is kept.  A frame
        with the number of an earlier ``batch`` is left out."""
        if self.finished:
            raise Invalid("writer.state", "the dataset is finished")
        if batch is not None and batch <= self.last_batch:
            return
        began = time.time()
        named = self.schema.check_frame(df)
        part = f"{self.path}/data/append-{self.appends:06d}"
        given = f"{self.path}/given"
        options = {"parquet.block.row.count.limit": str(self.layout.group_rows), "parquet.page.write-checksum.enabled": "true"}
        try:
            placed = groups.with_position(named, self.rows, given)
            placed = groups.with_group(placed, self.layout.group_rows, self.rows, self.groups)
            ready = placed.repartitionByRange(GROUP).sortWithinPartitions(POSITION)
            ready.write.mode("overwrite").options(**options, **self._bloom_options()).parquet(part)
            rows = self._checked(part, self.spark.read.parquet(given).count())
        except (Invalid, Corrupt):
            delete(self.spark, part)  # nothing of a bad append stays
            raise
        finally:
            delete(self.spark, given)
        if batch is not None:
            self.last_batch = batch
        if not rows:
            delete(self.spark, part)
            return self._note()
        self.rows += rows
        self.groups += -(-rows // self.layout.group_rows)
        self.appends += 1
        self._note()
        self.metrics.rows, self.metrics.row_groups, self.metrics.appends = self.rows, self.groups, self.appends
        self.metrics.seconds += time.time() - began

    def _note(self) -> None:
        """The state behind this append, in one file that takes the old one's place."""
        state = {"rows": self.rows, "groups": self.groups, "appends": self.appends, "last_batch": self.last_batch}
        _put(self.spark, f"{self.path}/journal", json.dumps(state))

    def _checked(self, part: str, given: int) -> int:
        """Rows of an append that was written, if they are all that were given, at
        positions without a gap, and all their values keep the rules."""
        stored = self._stored(part)
        bad = [F.count_if(S.bad_value(f)).alias(S.column(f.id)) for f in self.schema.fields]
        ends = [F.min(POSITION).alias("first"), F.max(POSITION).alias("last")]
        counts = stored.agg(F.count("*").alias("rows"), *ends, *bad).first().asDict()
        if counts["rows"] != given:
            raise Corrupt("writer.rows", f"{counts['rows']} rows written of {given} given")
        if given and (counts["first"], counts["last"]) != (self.rows, self.rows + given - 1):
            raise Corrupt("writer.rows", f"positions {counts['first']} to {counts['last']} for {given} rows from {self.rows}")
        for f in self.schema.fields:
            if counts[S.column(f.id)]:
                raise Invalid("schema.value", f"field {f.name!r}: {counts[S.column(f.id)]} values are null or out of range")
        self._check_order(stored)
        return counts["rows"]

    def _stored(self, *parts: str) -> DataFrame:
        return self.spark.read.schema(self._empty().schema).option("recursiveFileLookup", "true").parquet(*parts)

    def _bloom_options(self) -> dict[str, str]:
        out = {}
        for i in self.layout.bloom:
            out[f"parquet.bloom.filter.enabled#{S.column(i)}"] = "true"
            out[f"parquet.bloom.filter.expected.ndv#{S.column(i)}"] = str(self.layout.group_rows)
        return out

    def _check_order(self, stored: DataFrame) -> None:
        keys = [S.column(i) for i in self.layout.sort_key]
        if not keys:
            return
        for i in self.layout.sort_key:
            if self.schema.by_id(i).kind in S.FLOATS and not stored.filter(F.isnan(S.column(i))).isEmpty():
                raise Invalid("writer.order", "a sort key is NaN")
        both = stored
        if self.groups:  # the last group so far and the new ones
            before = self._stored(f"{self.path}/data/append-{self.appends - 1:06d}")
            both = before.filter(F.col(GROUP) == self.groups - 1).unionByName(stored)
        if groups.count_violations(both, keys).first()["violations"]:
            raise Invalid("writer.order", "rows aren't in the order of the sort key")

    def finish(self) -> "Segment":
        """Write index, Bloom bitmaps, encodings and, last, the manifest."""
        if self.finished:
            raise Invalid("writer.state", "the dataset is finished")
        began = time.time()
        data = self._stored(f"{self.path}/data")
        relative = F.regexp_extract("path", r"((?:data|index)/.+)$", 1)
        # distinct first: a text in the aggregation's buffer would have all rows sorted
        where = data.select(GROUP, F.input_file_name().alias("path")).distinct().groupBy(GROUP).agg(F.min(relative).alias("file"))
        zones.zone_map(data, self.schema, self.layout).join(where, GROUP).write.mode("overwrite").parquet(f"{self.path}/index")
        bits = bloom.bits_for(self.layout.group_rows)
        for i in self.layout.bloom:
            built = bloom.build(data, S.column(i), bits, self.schema.by_id(i).kind in S.FLOATS)
            built.write.mode("overwrite").parquet(f"{self.path}/bloom_{i}")
        if self.schema.fields:
            fields = [(f.id, S.column(f.id), f.kind, self.layout.forced.get(f.id)) for f in self.schema.fields]
            encodings.report_all(data, fields, self.layout.sample_rows, most_rows=self.layout.group_rows).write.mode("overwrite").parquet(f"{self.path}/encodings")
            self._count(self.spark.read.parquet(f"{self.path}/encodings"))
        files = integrity.file_checksums(self.spark, f"{self.path}/data", f"{self.path}/index")
        files.select(relative.alias("path"), "length", "crc32c").write.mode("overwrite").parquet(f"{self.path}/files")
        manifest = {
            "format_version": FORMAT,
            "index_version": INDEX_FORMAT,
            "schema": self.schema.to_json(),
            "layout": self.layout.to_json(),
            "rows": self.rows,
            "groups": self.groups,
        }
        text = json.dumps(manifest, sort_keys=True)
        sealed = json.dumps({"manifest": text, "crc32c": integrity.crc32c(text.encode())})
        self.spark.createDataFrame([(sealed,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest")
        self.finished = True
        self.metrics.seconds += time.time() - began
        return Segment.open(self.spark, self.path)

    def _count(self, chunks: DataFrame) -> None:
        m = self.metrics
        for r in chunks.groupBy("encoding_id").agg(
            F.count("*").alias("n"), F.sum("encoded_size").alias("b"), F.sum("plain_size").alias("p"), F.count_if(F.col("chosen_id") != F.col("encoding_id")).alias("f")
        ).collect():
            m.encoding_counts[r["encoding_id"]] = r["n"]
            m.chunks += r["n"]
            m.encoded_bytes += r["b"]
            m.plain_bytes += r["p"]
            m.size_fallbacks += r["f"]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if there is one."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and move it there."""
    jvm = spark.sparkContext._jvm
    place, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".new")
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(place, False)
    fs.rename(beside, place)


def _text(spark: SparkSession, path: str) -> str:
    return "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class Segment:
    """A finished dataset."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.manifest = spark, path, manifest
        self.schema = S.Schema.from_json(manifest["schema"])
        self.layout = Layout.from_json(manifest["layout"]).validate(self.schema)
        self.num_rows, self.num_row_groups = manifest["rows"], manifest["groups"]

    @staticmethod
    def open(spark: SparkSession, path: str, bypass_cache: bool = False, use_index: bool = True) -> "Segment":
        path = path.rstrip("/")
        if bypass_cache:
            raise Unsupported("reader.cache", "the page cache can't be bypassed here")
        if not _exists(spark, f"{path}/manifest/_SUCCESS"):
            raise Corrupt("format.manifest", f"{path} holds no finished dataset")
        try:
            sealed = json.loads(spark.read.text(f"{path}/manifest").first()[0])
            text, crc = sealed["manifest"], sealed["crc32c"]
        except (ValueError, KeyError, TypeError) as e:
            raise Corrupt("format.manifest", f"the manifest can't be read: {e}") from e
        if integrity.crc32c(text.encode()) != crc:
            raise Corrupt("format.checksum", "the manifest's checksum differs")
        manifest = json.loads(text)
        if manifest["format_version"] != FORMAT:
            raise Unsupported("format.version", f"format {manifest['format_version']}")
        if manifest["index_version"] != INDEX_FORMAT:
            raise Unsupported("index.version", f"index format {manifest['index_version']}")
        out = Segment(spark, path, manifest)
        out.use_index = use_index
        out.check_directory()
        return out

    use_index = True

    def _data(self, files: list[str] | None = None) -> DataFrame:
        stored = self.schema.stored().add(POSITION, "long").add(GROUP, "long")
        paths = [f"{self.path}/data"] if files is None else [f"{self.path}/{f}" for f in files]
        return self.spark.read.schema(stored).options(**{"parquet.page.verify-checksum.enabled": "true", "recursiveFileLookup": "true"}).parquet(*paths)

    def index(self) -> DataFrame:
        """A row per group; bounds and statistics only where the index is in use."""
        index = self.spark.read.parquet(f"{self.path}/index")
        return index if self.use_index else index.select(GROUP, "row_count")

    def check_directory(self) -> None:
        """Compare rows and groups with the manifest, and the order of the groups."""
        index = self.spark.read.parquet(f"{self.path}/index")
        seen = index.agg(F.count("*").alias("g"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("r"), F.coalesce(F.max(GROUP) + 1, F.lit(0)).alias("m")).first()
        if (seen["g"], seen["r"], seen["m"]) != (self.num_row_groups, self.num_rows, self.num_row_groups):
            raise Corrupt("format.directory", "index and manifest disagree on rows or groups")
        if self.layout.sort_key:
            keys = [S.column(i) for i in self.layout.sort_key]
            flat = index.select(GROUP, *[F.col(f"{e}_key")[k].alias(f"{e}_{k}") for e in ("first", "last") for k in keys])
            first, last = [f"first_{k}" for k in keys], [f"last_{k}" for k in keys]
            inside = flat.filter(groups.descends([F.col(c) for c in first], [F.col(c) for c in last]))
            if not inside.select(GROUP).unionAll(groups.violations_between(flat, first, last).select(GROUP)).isEmpty():
                raise Corrupt("index.order", "groups aren't in the order of the sort key")

    def encodings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/encodings")

    def verify(self) -> None:
        """Compare rows, groups, order of groups and the CRC32C of every file."""
        self.check_directory()
        relative = F.regexp_extract("path", r"((?:data|index)/.+)$", 1)
        now = integrity.file_checksums(self.spark, f"{self.path}/data", f"{self.path}/index").select(
            relative.alias("path"), F.col("length").alias("l"), F.col("crc32c").alias("c")
        )
        kept = self.spark.read.parquet(f"{self.path}/files")
        bad = kept.join(now, "path", "full").filter(~(F.col("length").eqNullSafe(F.col("l")) & F.col("crc32c").eqNullSafe(F.col("c")))).take(1)
        if bad:
            raise Corrupt("format.checksum", f"checksum or length of {bad[0]['path']} differs")

    def read_all(self) -> DataFrame:
        """All rows in order."""
        return self.scan(Scan(tuple(f.id for f in self.schema.fields))).frame()

    def take(self, positions: list[int], project: tuple[int, ...] | None = None) -> DataFrame:
        """Rows at some positions, in order.  Positions must ascend without repetition
        and lie in the dataset; ranges of them reach Parquet's statistics."""
        if any(isinstance(p, bool) or not isinstance(p, int) for p in positions):
            raise Invalid("selection.type", "positions are whole numbers")
        if any(b <= a for a, b in zip(positions, positions[1:])):
            raise Invalid("selection.order", "positions must ascend without repetition")
        if positions and not (0 <= positions[0] and positions[-1] < self.num_rows):
            raise Invalid("selection.bounds", f"positions must lie in 0 to {self.num_rows - 1}")
        plan = Scan(tuple(f.id for f in self.schema.fields) if project is None else project)
        columns = resolve(plan, self.schema, self.layout).output()
        if not positions:
            return self._data().limit(0).select(*columns)
        rows = self._data().filter(_within(_runs(positions), POSITION))
        wanted = self.spark.createDataFrame([(p,) for p in positions], f"{POSITION} long")
        return rows.join(wanted, POSITION, "left_semi").orderBy(POSITION).select(*columns)

    def scan(self, plan: Scan, execution: Execution | None = None) -> "ScanResult":
        return ScanResult(self, resolve(plan, self.schema, self.layout), (execution or Execution()).validate())


@dataclass(frozen=True)
class Listed:
    """A group that a scan has to read; ``whole``: it needs no filter."""

    group: int
    whole: bool
    rows: int
    file: str


def _runs(numbers: list[int]) -> list[tuple[int, int]]:
    """Ascending numbers as ranges; at most MOST_RUNS, which then cover more."""
    out: list[list[int]] = []
    for n in numbers:
        if out and n == out[-1][1] + 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    if len(out) > MOST_RUNS:
        gaps = sorted(range(1, len(out)), key=lambda k: out[k][0] - out[k - 1][1])
        closed = set(gaps[: len(out) - MOST_RUNS])
        wide: list[list[int]] = []
        for k, run in enumerate(out):
            if k in closed:
                wide[-1][1] = run[1]
            else:
                wide.append(run)
        out = wide
    return [tuple(r) for r in out]


def _within(runs: list[tuple[int, int]], column: str = GROUP) -> Column:
    return reduce(Column.__or__, [F.col(column) == a if a == b else F.col(column).between(a, b) for a, b in runs])


class ScanResult:
    """A checked scan: a frame, batches, and counters."""

    def __init__(self, segment: Segment, resolved: Resolved, execution: Execution):
        self.segment, self.resolved, self.execution = segment, resolved, execution
        self._planned: list[Listed] | None = None
        self._is_planned = False
        self.last = ScanMetrics()

    def classes(self) -> DataFrame:
        """A row per group with its class."""
        r, segment = self.resolved, self.segment
        index = segment.index()
        blooms = {}
        if segment.use_index:
            for n, t in enumerate(r.tests):
                if t.op == "eq" and t.field in segment.layout.bloom:
                    kind = segment.schema.by_id(t.field).kind
                    stored = segment.spark.read.parquet(f"{segment.path}/bloom_{t.field}")
                    blooms[n] = bloom.probe(stored, index, literal(kind, t.value), bloom.bits_for(segment.layout.group_rows), kind in S.FLOATS)
        return zones.classify(index, r, blooms)

    def _left(self) -> DataFrame:
        columns = [GROUP, "row_count", (F.col("cls") == zones.ALL).alias("whole"), F.col("file") if self.segment.use_index else F.lit("").alias("file")]
        return self.classes().filter(F.col("cls") != zones.NONE).select(*columns)

    def planned(self) -> list[Listed] | None:
        """The groups to read, in order, as the index has it; None without an index or
        where they are too many to list.  With a limit the list ends at the group that
        fills it."""
        if not self._is_planned:
            self._is_planned = True
            if self.segment.use_index and self.segment.num_row_groups:
                # one row more tells whether there are too many
                rows = self._left().limit(MOST_LISTED + 1).collect()
                if len(rows) <= MOST_LISTED:
                    self._planned = self._until_full(sorted((Listed(r[GROUP], r["whole"], r["row_count"], r["file"]) for r in rows), key=lambda x: x.group))
        return self._planned

    def _until_full(self, listed: list[Listed]) -> list[Listed]:
        """The groups up to the one that fills the limit.  Groups proven whole count by
        their rows; others are counted in waves that double, on the filter's columns."""
        limit = self.resolved.plan.limit
        if limit is None:
            return listed
        at = have = 0
        wave = WAVE
        while at < len(listed) and have < limit:
            some = listed[at : at + wave]
            partial = [x for x in some if not x.whole]
            hits = {x.group: x.rows for x in some if x.whole}
            if partial and at + len(some) == len(listed) and at:
                return listed  # the last wave may be read whole
            if partial:
                hits |= {r[GROUP]: r["count"] for r in self._read(partial).groupBy(GROUP).count().collect()}
            for x in some:
                at += 1
                have += hits.get(x.group, 0)
                if have >= limit:
                    break
            wave *= 2
        return listed[:at]

    def _read(self, listed: list[Listed]) -> DataFrame:
        """Matching rows of some groups; those proven whole without the filter."""
        condition = self.resolved.condition()
        if condition is None:
            return self._of(listed)[0]
        whole, partial = [x for x in listed if x.whole], [x for x in listed if not x.whole]
        (a, a_exact), (b, b_exact) = (self._of(some) if some else (None, True) for some in (whole, partial))
        if not (a_exact and b_exact):  # ranges that cover further groups, perhaps each other's
            return self._of(listed)[0].filter(condition)
        if b is None:
            return a
        return b.filter(condition) if a is None else a.unionAll(b.filter(condition))

    def _of(self, listed: list[Listed]) -> tuple[DataFrame, bool]:
        """All rows of some groups, and whether they are of no others."""
        runs = _runs([x.group for x in listed])
        data = self.segment._data(sorted({x.file for x in listed})).filter(_within(runs))
        return data, sum(b - a + 1 for a, b in runs) == len(listed)

    def rows(self) -> DataFrame:
        """Matching rows with their position, in no order; the form to build on."""
        if (listed := self.planned()) is not None:
            return self._read(listed) if listed else self._nothing()
        condition = self.resolved.condition()
        data = self.segment._data()
        return data if condition is None else data.filter(condition)

    def _nothing(self) -> DataFrame:
        stored = self.segment.schema.stored().add(POSITION, "long").add(GROUP, "long")
        return self.segment.spark.createDataFrame([], stored)

    def frame(self) -> DataFrame:
        """Projected rows in the dataset's order, after the limit."""
        r = self.resolved
        out = self.rows().orderBy(POSITION)
        if r.plan.limit is not None:
            out = out.limit(r.plan.limit)
        return out.select(*r.output())

    def unordered(self) -> DataFrame:
        """Projected rows without the sort; with a limit the rows are those of ``frame``."""
        if self.resolved.plan.limit is not None:
            return self.frame()
        return self.rows().select(*self.resolved.output())

    def count(self) -> int:
        """Rows of the result; an empty projection still has them.  Groups proven whole
        are counted in the index."""
        limit = self.resolved.plan.limit
        if limit == 0:
            return 0
        listed = self.planned()
        if listed is None:
            n = self.rows().count()
        else:
            partial = [x for x in listed if not x.whole]
            n = sum(x.rows for x in listed if x.whole) + (self._read(partial).count() if partial else 0)
        return n if limit is None else min(n, limit)

    def _pieces(self):
        """Runs of groups to read together, in order, with the bytes of their columns."""
        e, r, segment = self.execution, self.resolved, self.segment
        wanted = [S.column(i) for i in dict.fromkeys([*r.plan.project, *r.filter_ids])]
        width = {S.column(f.id): S.width(f.kind) or 32 for f in segment.schema.fields}
        per_row = 16 + 2 * sum(width[c] for c in wanted)
        listed = self.planned()
        if listed is None:
            rows = self._left().orderBy(GROUP).toLocalIterator()
            listed = (Listed(x[GROUP], x["whole"], x["row_count"], x["file"]) for x in rows)
        piece: list[Listed] = []
        size = 0
        for x in listed:
            cost = x.rows * per_row + GROUP_BYTES
            if piece and (size + cost > e.max_bytes / e.in_flight or x.group != piece[-1].group + 1 and len(piece) >= PIECE_GROUPS):
                yield piece, size
                piece, size = [], 0
            piece.append(x)
            size += cost
        if piece:
            yield piece, size

    def _table(self, piece: list[Listed]):
        """Projected rows of a piece as an Arrow table, in order."""
        if not piece[0].file:  # no index: the file isn't known
            data = self.segment._data().filter(_within(_runs([x.group for x in piece])))
            condition = self.resolved.condition()
            rows = data if condition is None else data.filter(condition)
        else:
            rows = self._read(piece)
        return rows.orderBy(POSITION).select(*self.resolved.output()).toArrow()

    def _tables(self):
        """Tables of all pieces in order.  The first piece that fails, in this order,
        ends the scan with its error."""
        e, m = self.execution, self.last
        if e.workers == 1:
            for piece, _ in self._pieces():
                yield self._table(piece)
            return
        m.parallel_workers = e.workers
        pieces, waiting, held = self._pieces(), deque(), 0
        after = next(pieces, None)
        with ThreadPoolExecutor(e.workers) as pool:
            try:
                while after or waiting:
                    while after and len(waiting) < e.in_flight and (not waiting or held + after[1] <= e.max_bytes):
                        waiting.append((pool.submit(self._table, after[0]), after[1]))
                        held += after[1]
                        m.parallel_tasks += 1
                        m.parallel_peak_in_flight = max(m.parallel_peak_in_flight, len(waiting))
                        m.parallel_peak_bytes = max(m.parallel_peak_bytes, held)
                        after = next(pieces, None)
                    future, size = waiting.popleft()
                    yield future.result()
                    held -= size
            finally:
                for future, _ in waiting:
                    future.cancel()

    def batches(self):
        """Arrow batches of exactly ``batch_rows`` rows but for the last, in order.
        Without rows there are none.  An empty projection yields batches without
        columns whose ``num_rows`` count.  Groups are read as they are wanted, within
        the limits of the execution; a limit reads no group behind the one that fills
        it.  ``last`` holds the counters of the run."""
        import pyarrow as pa

        plan = self.resolved.plan
        m = self.last = ScanMetrics()
        if not plan.project:
            left = self.count()
            m.rows_returned = left
            for n in [plan.batch_rows] * (left // plan.batch_rows) + [left % plan.batch_rows] * (left % plan.batch_rows > 0):
                yield pa.RecordBatch.from_struct_array(pa.array([{}] * n, pa.struct([])))
            return
        if plan.limit == 0:
            return
        began = time.time()
        self.planned()
        m.plan_seconds, began = time.time() - began, time.time()
        left, held, have = plan.limit, [], 0

        def cut(n: int):
            """The first ``n`` rows held, as one batch."""
            nonlocal have
            parts, need = [], n
            while need:
                b = held[0]
                if b.num_rows > need:
                    m.output_slices += 1
                    parts.append(b.slice(0, need))
                    held[0] = b.slice(need)
                else:
                    parts.append(held.pop(0))
                need -= parts[-1].num_rows
            have -= n
            m.rows_returned += n
            if len(parts) == 1:
                return parts[0]
            m.output_concatenations += 1
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

        tables = self._tables()
        try:
            for table in tables:
                for b in table.to_batches():
                    if left is not None and b.num_rows > left:
                        b = b.slice(0, left)
                        m.output_slices += 1
                    if b.num_rows:
                        held.append(b)
                        have += b.num_rows
                        left = None if left is None else left - b.num_rows
                while have >= plan.batch_rows:
                    yield cut(plan.batch_rows)
                if left == 0:
                    break
            if have:
                yield cut(have)
        finally:
            tables.close()
            m.read_seconds = time.time() - began

    def metrics(self) -> ScanMetrics:
        """Counters of this plan: groups pruned by the index cost nothing, groups proven
        whole cost their projected chunks, others their filter chunks and, with a hit,
        the projected chunks not read yet.  A limit ends the scan in the group that
        fills it.  Only groups that aren't proven are counted in the data, on the
        filter's columns; bytes are those of the encodings that the writer chose."""
        r, segment = self.resolved, self.segment
        plan, filters = r.plan, list(r.filter_ids)
        rest = [i for i in plan.project if i not in filters]
        classes = self.classes().select(GROUP, "row_count", "cls")
        condition = r.condition()
        if condition is None:
            per = classes.withColumn("hits", F.col("row_count"))
        else:
            listed = self.planned()
            partial = None if listed is None else [x for x in listed if not x.whole]
            data = self._read(partial) if partial else self._nothing() if partial is not None else segment._data().filter(condition)
            hits = data.groupBy(GROUP).agg(F.count("*").alias("hits"))
            per = classes.join(hits, GROUP, "left").withColumn("hits", F.when(F.col("cls") == zones.ALL, F.col("row_count")).otherwise(F.coalesce("hits", F.lit(0))))
        taken = F.col("hits")
        if plan.limit is not None:
            # a running count over the index: one row for each group
            before = F.coalesce(F.sum("hits").over(Window.orderBy(GROUP).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            per = per.withColumn("before", before).filter(F.col("before") < plan.limit)
            taken = F.least(F.col("hits"), F.lit(plan.limit) - F.col("before"))
        per = per.withColumn("taken", taken)
        part, whole, found = F.col("cls") == zones.PARTIAL, F.col("cls") == zones.ALL, F.col("hits") > 0
        per = per.join(self._chunk_bytes(filters, rest), GROUP, "left") if segment.schema.fields else per.withColumns({c: F.lit(0) for c in ("filter_bytes", "rest_bytes", "shown_bytes")})

        def total(c: Column) -> Column:
            return F.coalesce(F.sum(c), F.lit(0))

        a = per.agg(
            F.count("*").alias("considered"),
            F.count_if(F.col("cls") == zones.NONE).alias("pruned"),
            F.count_if(part).alias("part"),
            F.count_if(part & found).alias("part_hit"),
            F.count_if(whole & found).alias("whole"),
            total(F.when(part, F.col("row_count"))).alias("examined"),
            total(F.when(part | (F.col("taken") < F.col("hits")), F.col("taken"))).alias("indices"),
            total(F.col("taken")).alias("rows"),
            total(F.when(part, F.col("filter_bytes"))).alias("predicate_bytes"),
            total(F.when(part & found, F.col("rest_bytes")).when(whole & found, F.col("shown_bytes"))).alias("projection_bytes"),
        ).first()
        predicate, projection = a["part"] * len(filters), a["part_hit"] * len(rest) + a["whole"] * len(plan.project)
        return ScanMetrics(
            row_groups_considered=a["considered"],
            row_groups_pruned=a["pruned"],
            column_chunks_read=predicate + projection,
            predicate_chunks=predicate,
            projection_chunks=projection,
            predicate_bytes=a["predicate_bytes"],
            projection_bytes=a["projection_bytes"],
            predicate_rows=a["examined"] * len(filters),
            projection_rows=a["rows"] * len(plan.project),
            rows_examined=a["examined"],
            selection_indices=a["indices"],
            rows_returned=a["rows"],
            parallel_workers=self.execution.workers if self.execution.workers > 1 else 0,
        )

    def _chunk_bytes(self, filters: list[int], rest: list[int]) -> DataFrame:
        """Encoded bytes of each group's chunks: of the filter's fields, of the projected
        fields that it doesn't read, of all projected ones."""

        def of(ids) -> Column:
            return F.sum(F.when(F.col("field").isin(*ids), F.col("encoded_size")).otherwise(0)) if ids else F.lit(0)

        return self.segment.encodings().groupBy(GROUP).agg(
            of(filters).alias("filter_bytes"), of(rest).alias("rest_bytes"), of(list(self.resolved.plan.project)).alias("shown_bytes")
        )

    def describe(self) -> dict:
        return asdict(self.metrics())


def shards(segment: Segment, plan: Scan, bounds: list[tuple]) -> DataFrame:
    """One scan cut into disjoint key ranges at ``bounds`` and put together again."""
    from dataclasses import replace

    from strataq.plans.scan import KeyRange

    outer = plan.key_range or KeyRange()
    edges = [outer.lower, *bounds, outer.upper]
    out = None
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        part = KeyRange(a, b, outer.lower_inclusive if k == 0 else True, outer.upper_inclusive if k == len(edges) - 2 else False)
        rows = segment.scan(replace(plan, key_range=part, limit=None)).unordered()
        out = rows if out is None else out.unionAll(rows)
    return out
