"""Connected components and lineage cuts."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.workers import quiet
from strataq.operators.groups import shared_folder


def _shared(df: DataFrame) -> str:
    """The checkpoint folder, which ``spark.checkpoint.dir`` names; a folder of our
    own only in a local session that names none."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    _shared(df)
    return df.checkpoint(eager=True)


def shelve(df: DataFrame) -> DataFrame:
    """Written as a table in the shared folder and read again: a lineage cut whose
    columns are read one by one."""
    return _read_back(df, f"{_shared(df)}/table-{uuid.uuid4().hex}")


def _read_back(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


HOT_SHARE = 10_000  # a key is hot with more than one of so many rows; there are fewer such keys


def join_spread(rows: DataFrame, named: DataFrame, keys: list[str], copies: str) -> DataFrame:
    """Left join of ``rows`` with a table that has one row for each key and the number
    of ``rows`` that hold it, so that no key makes a hot task: rows of hot keys meet a
    broadcast table of at most HOT_SHARE rows.  A null key meets nothing."""
    total = named.agg(F.sum(copies)).first()[0] or 0
    hot = F.col(copies) > max(1000, total // HOT_SHARE)
    few = F.broadcast(named.filter(hot).drop(copies))
    others = rows.join(F.broadcast(named.filter(hot).select(*keys)), keys, "left_anti")
    return rows.join(few, keys).unionByName(others.join(named.filter(~hot).drop(copies), keys, "left"))


LOCAL = 1_000_000  # edges that one task contracts at once


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` vertices over edges (i, j): roots
    hook to smaller roots, then all paths are halved until they are one step long."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        on = a != b
        if not on.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[on], np.minimum(a, b)[on])
        while (root != (two := root[root])).any():
            root = two


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges (u, v) of stars that connect what the edges of a task connect.  A task
    holds LOCAL edges or so, in arrays."""

    @quiet
    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        u, v = (np.concatenate([p[k] for p in parts]) for k in range(2))
        names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = forest(len(names), at[: len(u)], at[len(u) :])
        moved = np.flatnonzero(root != np.arange(len(names)))
        for k in range(0, len(moved), 100_000):
            some = moved[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(names[root[some]])], names=["u", "v"])

    return edges.select("u", "v").coalesce(tasks).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, most_rounds: int = 60, local: int = LOCAL) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the
    smallest node it is connected to.

    Tasks first contract about ``local`` edges each to stars.  If that took more than
    one task, large-star and small-star rounds follow: a round joins the edges with
    the smallest neighbour of each node, so no neighbour list is gathered anywhere
    and a hub's edges can be split between tasks.  Rounds go on until nothing
    changes; their number grows with the logarithm of the size.  Self loops and
    repeated edges are harmless; edges with a null end are dropped.
    """
    marks = F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))  # of a set of edges
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    tasks = -(-now.count() // local)
    if tasks:
        now = cut(_contracted(now, tasks).distinct() if tasks > 1 else _contracted(now, 1))
    mark = None
    for _ in range(most_rounds if tasks > 1 else 0):
        # large star: each node's larger neighbours move to its smallest neighbour
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m0")).select("x", F.least("x", "m0").alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = cut(
            small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .filter("u > v")
            .distinct()
        )
        seen = tuple(now.agg(*marks).first())
        if seen == mark:
            break
        mark = seen
    else:
        if tasks > 1:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # now a forest of stars: every node points at the root
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
