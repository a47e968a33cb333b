"""Labelled rows shared by the two text classifiers, and sums over their shards."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.graph import shelve
from strataq.llm.workers import quiet
from strataq.operators.groups import shared_folder
from strataq.sources.segment import delete

FOLDS, HELD_OUT = 3, 1
SHARD_ROWS, SHARD_CHARS = 8_000, 16_000_000  # of one shard, about
SUMMED = 16  # arrays added at once
PART = "shard long, body binary"


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo the number of folds; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(0))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, extra: list[str] = []) -> tuple[DataFrame, int]:
    """All labelled rows outside the held-out fold with their whole texts, as a table
    (doc_id, y, text, extra, shard), and the number of shards, which follows the size.

    Null ids, labels and texts are left out; an id with several labels counts as its
    largest; rows that repeat an id count each.
    """
    known = (
        labels.select("doc_id", F.col(target).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold() != HELD_OUT))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    text = F.col("text").cast("string").alias("text")
    rows = docs.filter(F.col("text").isNotNull() & (fold() != HELD_OUT)).select("doc_id", text, *extra)
    n, known_n = rows.count(), known.count()
    chars = (rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0) * known_n / max(1, n)
    shards = max(1, math.ceil(known_n / SHARD_ROWS), math.ceil(chars / SHARD_CHARS))
    # one exchange, for the join as for the shards; never a broadcast, so cost is in proportion
    rows = rows.repartition(shards, "doc_id").join(known.repartition(shards, "doc_id").hint("merge"), "doc_id")
    return shelve(rows.select("doc_id", "y", "text", *extra, F.pmod(F.hash("doc_id"), F.lit(shards)).alias("shard"))), shards


def by_shard(rows: DataFrame, shards: int, make) -> DataFrame:
    """(shard, body) with the sum of the arrays that ``make`` makes of the shards of a
    task, each in the order of ids and texts, as numbers of 64 bits."""

    @quiet
    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            at = b.schema.get_field_index("shard")
            for k in pc.unique(b.column(at)).to_pylist():
                held.setdefault(k, []).append(b.filter(pc.equal(b.column(at), k)))
        total = 0
        for k in sorted(held):
            table = pa.Table.from_batches(held.pop(k)).sort_by([("doc_id", "ascending"), ("text", "ascending")])
            total = total + np.asarray(make(table), np.float64)
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["shard", "body"])

    return rows.coalesce(shards).mapInArrow(run, PART)


def summed(parts: DataFrame, shards: int) -> np.ndarray | None:
    """Sum of the arrays of (shard, body), about SUMMED at a time; the driver sees one.
    Tables on the way go when they are added up."""

    @quiet
    def add(batches):
        held = sorted((k, body) for b in batches for k, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        if held:
            total = sum(np.frombuffer(body) for _, body in held)
            yield pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["shard", "body"])

    spark, before = parts.sparkSession, None
    while True:
        path = f"{shared_folder(spark)}/sums-{uuid.uuid4().hex}"
        parts.write.parquet(path)
        if before:
            delete(spark, before)
        before, parts = path, spark.read.schema(PART).parquet(path)
        if shards == 1:
            break
        shards = -(-shards // SUMMED)
        parts = parts.coalesce(shards).mapInArrow(add, PART)
    bodies = [r["body"] for r in parts.collect()]
    delete(spark, before)
    return sum(map(np.frombuffer, bodies)) if bodies else None
