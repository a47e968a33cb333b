"""Sequence packing by Karmarkar-Karp multiway differencing.

Every document is cut into full windows and a rest; the rests of a batch are
dealt to near-equal windows: each starts as a partial partition with one
occupied window, and the two partial partitions with the largest imbalance are
merged, the fullest windows of one with the emptiest of the other, until one
is left.  When its fullest window exceeds the capacity, the window count rises
and the batch is dealt again.

Batches are made inside a scan task, so there is no shuffle, no task grows with
the corpus, and a task that is run again after a lost executor makes the same
sequences: ids are ``partition << 33 | counter``.
"""

from __future__ import annotations

import functools
import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strataq.llm import bpe
from strataq.llm.wordbatch import slices
from strataq.llm.workers import quiet

WINDOW = 4096
END_ID = 2
BATCH = 2048  # pieces dealt together by differencing
PIECE = 1024  # a rest is cut so that no piece is longer, which keeps windows level

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window of each size by multiway largest differencing."""
    n, k = len(sizes), windows
    if k <= 1:
        return np.zeros(n, np.int64)
    sums, merged, heap = {}, {}, []
    for i in range(n):
        first = np.zeros(k, np.int64)
        first[0] = sizes[i]
        sums[i] = first
        heap.append((-int(sizes[i]), i))
    heapq.heapify(heap)
    name = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]  # only differences matter
        sums[name], merged[name] = both, (a, b, order)
        heapq.heappush(heap, (-int(both[0]), name))
        name += 1
    out = np.zeros(n, np.int64)
    todo = [(heap[0][1], np.arange(k))]
    while todo:
        node, names = todo.pop()
        if node < n:
            out[node] = names[0]
            continue
        a, b, order = merged[node]
        at = np.empty(k, np.int64)
        at[order] = names
        todo += [(a, at), (b, at[::-1])]
    return out


def deal(sizes: np.ndarray, capacity: int = WINDOW) -> tuple[np.ndarray, int]:
    """Window of each size and the number of windows, none above ``capacity``."""
    total = int(sizes.sum())
    windows = max(1, -(-total // capacity))
    while True:
        at = differencing(sizes, windows)
        fill = np.bincount(at, sizes, windows)
        over = fill.max() - capacity
        if over <= 0:
            return at, windows
        # the count rises by what the worst window exceeds, spread over all windows
        windows = min(len(sizes), windows + max(1, int(over * windows / capacity / 4)))


def pieces_of(tokens: int, window: int = WINDOW, piece: int = PIECE) -> tuple[list[int], list[int]]:
    """Lengths of a document's full windows and of the pieces of its rest."""
    rest = tokens % window
    parts = -(-rest // piece)
    small = [rest // parts + (i < rest % parts) for i in range(parts)]
    return [window] * (tokens // window), small


@functools.lru_cache(maxsize=2)
def _packed_words(path: str) -> bpe.WordTable:
    return bpe.WordTable(path, lambda ids: struct.pack(f"<{len(ids)}I", *ids))


def _texts(b: pa.RecordBatch, table: bpe.WordTable):
    for start, stop in slices(b.column(1)):
        yield from zip(b.column(0)[start:stop].to_pylist(), table.rows(b.column(1)[start:stop].to_pylist()))


def pack(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in sequences of ``WINDOW`` ids.

    Null text: empty, a piece that holds the end id alone.  Null ids of documents
    stay null; repeated rows are packed as often as they come; an empty table
    gives no rows; further columns are not read.  With ``keep_ids`` the ids of
    each piece follow as an array.
    """
    schema = SCHEMA + (", ids array<int>" if keep_ids else "")
    end = struct.pack("<I", END_ID)

    @quiet
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        full: list[tuple] = []
        rests: list[tuple] = []

        def rows(some: list[tuple]):
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = list(zip(*some))
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            if keep_ids:
                arrays.append(pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in columns[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * keep_ids)

        def settle(some: list[tuple], first: int):
            at, windows = deal(np.array([r[2] for r in some], np.int64))
            filled = [0] * windows
            out = []
            for r, w in zip(some, at.tolist()):
                out.append((*r[:5], first + w, filled[w], *r[5:]))
                filled[w] += r[2]
            return out, windows

        table = _packed_words(path)
        for b in batches:
            for doc_id, got in _texts(b, table):
                got.append(end)
                ids = b"".join(got)
                tokens, start = len(ids) // 4, 0
                whole, small = pieces_of(tokens)
                for n in whole + small:
                    part = ids[4 * start : 4 * (start + n)]
                    row = (doc_id, start, n, zlib.crc32(part), tokens)
                    if n == WINDOW:
                        full.append((*row, number, 0, *([part] * keep_ids)))
                        number += 1
                    else:
                        rests.append((*row, *([part] * keep_ids)))
                    start += n
                while len(rests) >= BATCH:
                    out, used = settle(rests[:BATCH], number)
                    number += used
                    del rests[:BATCH]
                    yield rows(out)
                if len(full) >= 4 * BATCH:
                    yield rows(full)
                    full.clear()
        if full:
            yield rows(full)
        if rests:
            yield rows(settle(rests, number)[0])

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(run, schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every whole text of ``documents``."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), bpe.vocabulary())
