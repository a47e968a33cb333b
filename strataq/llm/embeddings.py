"""Embedding near-dedup with randomised-rotation binary codes.

A unit vector is rotated by random orthogonal matrices and stored as a code: the packed
signs, the factor ``f = <x', signs / sqrt(D)>`` of the first rotation, and, for its part
as a query, the rotated coordinates in four bits each.  With the code of ``y``,
``<q', signs / sqrt(D)> / f`` estimates the inner product of ``q`` and ``y`` without
bias, within ``BOUND * sqrt((1 - f*f) / (D - 1) + step*step / 12) / f`` with high
confidence (``step`` is that of the rounding of ``q'``).  Pairs whose bound stays below the threshold are dropped on the
codes alone; vectors are fetched only for those that are left, and only the exact cosine
in double precision decides.

Pairs are looked for among vectors of one label that agree in all signs of some band,
which are bits of the code.  The length of a band follows the size of the largest label
and the number of bands follows the length, so that a pair at the threshold is missed
with a probability of at most ``MISS`` at every size.  Equal vectors are one node with a
multiplicity.  A bucket is split into blocks of bounded size and every two blocks meet in
a group of their own.  Codes meet first and tell which vectors have an undecided partner
that they share no earlier band with; then these vectors meet, and the group sends counts
and a spanning forest, not pairs.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataq.llm.graph import components, cut, forest, join_spread, shelve
from strataq.llm.wordbatch import mix
from strataq.llm.workers import quiet

THRESHOLD = 0.98
MISS = 1e-3
BOUND = 4.0
BLOCK = 512  # vectors of a bucket in one block
PER_BUCKET = 256  # vectors of a label in a bucket that chance alone puts there
STEPS = 15  # of a coordinate rounded to four bits
GROUP = ["label", "dim", "band", "bucket", "first", "second"]


@functools.lru_cache(maxsize=256)
def rotation(dim: int, number: int) -> np.ndarray:
    """Random orthogonal matrix, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng([dim, number]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def bands(largest: int) -> tuple[int, int]:
    """(signs in a band, bands) for the size of the largest label."""
    signs = max(6, math.ceil(math.log2(max(2, largest) / PER_BUCKET)))
    agree = (1 - math.acos(THRESHOLD) / math.pi) ** signs
    return signs, math.ceil(math.log(MISS) / math.log(1 - agree))


def coded(unit: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(signs, about) of unit vectors: packed signs of as many rotations as ``bits``
    need, the first of them whole; and bytes that hold f, the smallest coordinate and
    the step of the rounding, then the coordinates of the first rotation, two a byte."""
    n, dim = unit.shape
    turned = unit @ rotation(dim, 0).T
    signs = [turned > 0, *(unit @ rotation(dim, i).T > 0 for i in range(1, -(-bits // dim)))]
    f = np.abs(turned).sum(1) / math.sqrt(dim)
    low = turned.min(1)
    step = np.maximum(turned.max(1) - low, 1e-12) / STEPS
    level = np.clip(np.rint((turned - low[:, None]) / step[:, None]), 0, STEPS).astype(np.uint8)
    if dim % 2:
        level = np.hstack([level, np.zeros((n, 1), np.uint8)])
    about = np.hstack([np.stack([f, low, step], 1).astype("<f4").view(np.uint8), level[:, ::2] << 4 | level[:, 1::2]])
    return np.packbits(np.hstack(signs), axis=1), about


def keys_of(code: np.ndarray, signs: int, n: int) -> np.ndarray:
    """(vectors, n) band keys from packed signs."""
    bits = np.unpackbits(code, axis=1, count=signs * n).reshape(len(code), n, signs)
    out = np.zeros((len(code), n), np.uint64)
    for k in range(signs):  # longer bands than 64 signs are hashed
        out = (out << np.uint64(1) | bits[:, :, k]) if k % 64 or not k else mix(out) + bits[:, :, k]
    return out.view(np.int64)


def undecided(dim: int, x_about: np.ndarray, y_code: np.ndarray, y_about: np.ndarray) -> np.ndarray:
    """Whether the code of ``y`` leaves open that its cosine with the query ``x`` is at
    the threshold or above, for every pair."""
    head = x_about[:, :12].copy().view("<f4").astype(float)
    packed = x_about[:, 12:]
    level = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(packed), -1)[:, :dim]
    q = head[:, 1:2] + level * head[:, 2:3]
    sign = (np.unpackbits(y_code, axis=1, count=dim).astype(float) * 2 - 1) / math.sqrt(dim)
    f = y_about[:, :12].copy().view("<f4").astype(float)[:, 0]
    spread = np.maximum(0, 1 - f * f) / max(1, dim - 1) + head[:, 2:3] ** 2 / 12  # of the signs and of rounding q
    return (q @ sign.T + BOUND * np.sqrt(spread)) / f >= THRESHOLD - 1e-5


def linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of ``x`` and ``y`` have a cosine >= THRESHOLD, for every pair."""
    near = x @ y.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1))
    out = near >= THRESHOLD
    i, j = np.nonzero(np.abs(near - THRESHOLD) < 1e-9)  # a sum's order must not decide
    if len(i):
        out[i, j] = [math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b)) >= THRESHOLD for a, b in zip(x[i], y[j])]
    return out


def _matrices(lists: pa.Array):
    """(rows, matrix) of the vectors of each length that can link: without nulls, finite
    and not zero."""
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    size = np.where(valid, np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)), 0).astype(np.int64)
    for dim in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == dim)
        flat = lists.take(pa.array(rows)).flatten().cast(pa.float64())
        x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)  # a null is NaN
        good = np.isfinite(x).all(1)
        good &= np.linalg.norm(np.where(good[:, None], x, 0), axis=1) > 0
        if good.any():
            yield rows[good], x[good]


def _named(rows: DataFrame) -> DataFrame:
    """(vec_id, label, node, other, vec): node and other, two 64-bit names of label and
    vector, are null where nothing can link."""

    @quiet
    def run(batches):
        digest = xxhash.xxh3_128_intdigest
        for b in batches:
            names = np.zeros((2, b.num_rows), np.uint64)
            vecs: list[bytes | None] = [None] * b.num_rows
            able = b.column(0).is_valid().to_numpy(zero_copy_only=False) & b.column(1).is_valid().to_numpy(zero_copy_only=False)
            labels = b.column(1).to_pylist()
            on = np.zeros(b.num_rows, bool)
            for at, x in _matrices(b.column(2)):
                for i, v in zip(at.tolist(), x):
                    if able[i]:
                        vecs[i] = v.tobytes()
                        d = digest(vecs[i] + str(labels[i]).encode())
                        names[:, i] = d >> 64, d & 0xFFFFFFFFFFFFFFFF
                        on[i] = True
            node, other = (pa.array(x.view(np.int64), mask=~on) for x in names)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), node, other, pa.array(vecs, pa.binary())], names=["vec_id", "label", "node", "other", "vec"])

    return rows.mapInArrow(run, "vec_id long, label long, node long, other long, vec binary")


def _codes(classes: DataFrame, signs: int, n: int) -> DataFrame:
    """(node, label, dim, code, about) of every different vector."""

    @quiet
    def run(batches):
        for b in batches:
            vecs = b.column(2)
            size = np.diff(np.frombuffer(vecs.buffers()[1], np.int32)[vecs.offset : vecs.offset + len(vecs) + 1])
            for bytes_ in np.unique(size).tolist():
                at = pa.array(np.flatnonzero(size == bytes_))
                x = np.frombuffer(b"".join(vecs.take(at).to_pylist()), np.float64).reshape(len(at), -1)
                code, about = coded(x / np.linalg.norm(x, axis=1, keepdims=True), signs * n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array(np.full(len(at), bytes_ // 8, np.int32))]
                    + [pa.array([r.tobytes() for r in c], pa.binary()) for c in (code, about)],
                    names=["node", "label", "dim", "code", "about"],
                )

    return classes.select("node", "label", "vec").mapInArrow(run, "node long, label long, dim int, code binary, about binary")


def _buckets(codes: DataFrame, signs: int, n: int) -> DataFrame:
    """(node, label, dim, band, bucket): a row for each band of a code."""

    @quiet
    def run(batches):
        for b in batches:
            by_dim = b.column(2).to_numpy()
            for dim in np.unique(by_dim).tolist():
                at = np.flatnonzero(by_dim == dim)
                some = b.take(pa.array(at))
                keys = keys_of(np.frombuffer(b"".join(some.column(3).to_pylist()), np.uint8).reshape(len(at), -1), signs, n)
                each = pa.array(np.repeat(np.arange(len(at)), n))
                yield pa.RecordBatch.from_arrays(
                    [some.column(k).take(each) for k in range(3)] + [pa.array(np.tile(np.arange(n, dtype=np.int32), len(at))), pa.array(keys.ravel())],
                    names=["node", "label", "dim", "band", "bucket"],
                )

    return codes.select("node", "label", "dim", "code").mapInArrow(run, "node long, label long, dim int, band int, bucket long")


def _grouped(rows: DataFrame, settle, schema: str) -> DataFrame:
    """``settle(group, rows)`` for the rows of each group; the rows begin with the
    columns of GROUP and ``side``."""

    @quiet
    def run(batches):
        held: list[tuple] = []
        name = None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[: len(GROUP)] != name:
                    if len(held) > 1 and (out := settle(name, held)) is not None:
                        yield out
                    name, held = row[: len(GROUP)], []
                held.append(row[len(GROUP) :])
        if len(held) > 1 and (out := settle(name, held)) is not None:
            yield out

    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, schema)


def _sides(group, held):
    side = np.array([h[0] for h in held])
    return np.flatnonzero(side == group[4]), np.flatnonzero(side == group[5])


def _first_met(code: np.ndarray, i: np.ndarray, j: np.ndarray, signs: int, band: int) -> np.ndarray:
    """Pairs that share no band before this one."""
    new = np.ones(len(i), bool)
    keys = keys_of(code, signs, band) if band else None
    for t in range(band):
        new &= keys[i, t] != keys[j, t]
    return new


def _bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def _open(groups: DataFrame, signs: int) -> DataFrame:
    """The rows of ``groups`` (GROUP, side, node, code, about) that have an undecided
    partner in their group, without codes' queries."""

    def settle(group, held):
        a, b = _sides(group, held)
        if not len(a) or not len(b):
            return None
        dim, band = group[1], group[2]
        code, about = _bytes([h[2] for h in held]), _bytes([h[3] for h in held])
        maybe = undecided(dim, about[a], code[b], about[b])
        if group[4] == group[5]:
            maybe = np.triu(maybe & maybe.T, 1)
        i, j = np.nonzero(maybe)
        i, j = a[i], b[j]
        new = _first_met(code, i, j, signs, band)
        on = np.unique(np.concatenate([i[new], j[new]]))
        if not len(on):
            return None
        k = len(on)
        columns = [pa.array([v] * k, t) for v, t in zip(group, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()))]
        columns += [pa.array([held[x][0] for x in on], pa.int32()), pa.array([held[x][1] for x in on], pa.int64()), pa.array([held[x][2] for x in on], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[*GROUP, "side", "node", "code"])

    return _grouped(groups, settle, "label long, dim int, band int, bucket long, first int, second int, side int, node long, code binary")


def _met(groups: DataFrame, signs: int) -> DataFrame:
    """(node, links, other): links found in one group, and a vertex of its forest."""

    def settle(group, held):
        a, b = _sides(group, held)
        if not len(a) or not len(b):
            return None
        nodes, weight = np.array([h[1] for h in held], np.int64), np.array([h[4] for h in held], np.int64)
        code = _bytes([h[2] for h in held])
        x = np.frombuffer(b"".join([h[3] for h in held]), np.float64).reshape(len(held), -1)
        near = linked(x[a], x[b])
        if group[4] == group[5]:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        i, j = a[i], b[j]
        if not len(i):
            return None
        root = forest(len(nodes), i, j)
        new = _first_met(code, i, j, signs, group[2])
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, i[new], weight[j[new]])
        np.add.at(links, j[new], weight[i[new]])
        on = np.flatnonzero((links > 0) | (root != np.arange(len(nodes))))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (nodes[on], links[on], nodes[root[on]])], names=["node", "links", "other"])

    return _grouped(groups, settle, "node long, links long, other long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Null, zero and empty vectors, vectors with null or non-finite components, and
    rows with a null label or id link with nothing: n_links 0, their own id as
    component.  Vectors of different length are never compared.  Repeated rows are
    vectors of their own that link with each other; an empty table gives no rows;
    further columns are not read.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("embedding")
    )
    named = _named(rows.select("vec_id", "label", "embedding"))
    classes = shelve(
        named.filter("node IS NOT NULL")
        .groupBy("node", "other")
        .agg(F.max("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
        # two vectors of one name differ in the other one, which then names the class
        .withColumn("at", F.when(F.col("other") == F.min("other").over(Window.partitionBy("node")), F.col("node")).otherwise(F.xxhash64("node", "other")))
    )
    unique = classes.select(F.col("at").alias("node"), "label", "vec", "n")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    signs, n = bands(int(largest))
    codes = shelve(_codes(unique, signs, n))
    spread = _buckets(codes, signs, n)
    bucket = ["label", "dim", "band", "bucket"]
    sizes = spread.groupBy(*bucket).agg(F.count("*").alias("m")).filter("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    mine = spread.join(sizes, bucket).select(*bucket, "node", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("side"), blocks.alias("blocks"))
    mine = mine.select(*bucket, "node", "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    groups = mine.select(*bucket, F.least("side", "with").alias("first"), F.greatest("side", "with").alias("second"), "side", "node")
    open_ = shelve(_open(groups.join(codes.select("node", "code", "about"), "node").select(*GROUP, "side", "node", "code", "about"), signs))
    met = cut(_met(open_.join(unique.select("node", "vec", "n"), "node").select(*GROUP, "side", "node", "code", "vec", "n"), signs))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("node").alias("a"), F.col("other").alias("b")))
    placed = classes.select("node", "other", "at", "n", "least").join(links.withColumnRenamed("node", "at"), "at", "left")
    placed = shelve(placed.join(roots.withColumnRenamed("node", "at"), "at", "left").withColumn("class", F.coalesce("root", "at")))
    least = placed.groupBy("class").agg(F.min("least").alias("component"))
    found = placed.join(least, "class").select(
        "node", "other", F.col("n").alias("copies"), "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("links")
    )
    out = join_spread(named.select("vec_id", "node", "other"), found, ["node", "other"], "copies")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all rows of ``embeddings``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_sql() -> str:
    """The same in DuckDB SQL: the cosine of every pair of one label."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
      WHERE list_cosine_similarity(x.e, y.e) >= {THRESHOLD}),
r AS (SELECT vec_id AS v, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.v WHERE r.root < l.b),
c AS (SELECT v, min(root) AS root FROM r GROUP BY v),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT m.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, CAST(c.root AS BIGINT) AS component_id, m.vec_id = c.root AS kept
FROM embeddings m JOIN c ON c.v = m.vec_id LEFT JOIN n ON n.a = m.vec_id"""
