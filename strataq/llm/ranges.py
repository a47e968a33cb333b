"""Who shares a key, asked of tasks that each own a range of the key space.

An item (a document, a set) sends its distinct 64-bit keys.  A sending task sorts what
it holds by key and item and packs, for each range, one entry per key: that of its
smallest item, with a mark whether it holds others.  The others need no owner: it is
plain already that they share the key with a smaller item.  So a key that any number
of items have reaches its owner once per batch, and a hot key makes no hot task.  The
owner of a range puts the entries of all batches together and answers.

The number of ranges follows the number of keys, so an owner holds about ``PER_RANGE``
keys at every size; nothing is collected, broadcast or capped.

Answers travel packed by buckets of items and end as one row (item, names) for each
item: a key is named by its range and 32 bits of it, or by a second 64-bit hash where
the sender gives one (``strong``).  Without one, owners may take two keys of a range for
one and answer too much, never too little.

With ``counted`` every item's entry goes to the owner, and the names that it answers
have the number of items with the key, as its power of two, in front: in order, they
start with the rarest.  A hot key then costs its owner 12 bytes an item.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataq.llm.wordbatch import mix
from strataq.llm.workers import quiet

PER_RANGE = 2_000_000  # keys of one range
FLUSH = 500_000  # keys that a task packs together
COUNT_AT = 57  # bits of a counted name behind its power of two
SENT = "part long, body binary"


def ranges_for(keys: float, spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(keys / PER_RANGE))


def named_by(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Names of keys: the range they fall into and their lower 32 bits."""
    part = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return part << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)


def rows(names: list, bodies: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(bodies, pa.binary())], names=["part", "body"])


class Sender:
    """Packs the keys of the items of one task."""

    def __init__(self, ranges: int, strong: bool = False, counted: bool = False):
        self.ranges, self.strong, self.counted = ranges, strong, counted
        self.held: list[tuple] = []
        self.told: list[tuple[int, int]] = []
        self.size = 0

    def tell(self, item: int, value: int):
        """A number below 2**63 that comes among the answers to an item, plus 2**63."""
        self.told.append((item, value | 1 << 63))

    def add(self, items: int | np.ndarray, keys: np.ndarray, more: np.ndarray | None = None):
        """Keys of one item, or of the items in an array beside them."""
        self.held.append((keys, items if isinstance(items, np.ndarray) else np.full(len(keys), items, np.int64), more))
        self.size += len(keys)

    def full(self) -> bool:
        return self.size >= FLUSH

    def batch(self) -> pa.RecordBatch:
        """What is held: entries to the owner of a range have its number as part,
        answers that need no owner a negative one."""
        keys, items = (np.concatenate([h[i] for h in self.held]) for i in range(2))
        name = named_by(keys, self.ranges)
        part, low = name >> np.uint64(32), name & np.uint64(0xFFFFFFFF)
        if self.strong:
            name = np.concatenate([h[2] for h in self.held])
        self.held, self.size = [], 0
        order = np.lexsort((items, name, keys) if self.strong else (items, keys))
        part, low, name, items = part[order], low[order].astype("<u4"), name[order], items[order]
        first = np.ones(len(items), bool)  # of a key
        first[1:] = (part[1:] != part[:-1]) | (low[1:] != low[:-1]) | (name[1:] != name[:-1])
        other = ~first
        other[1:] &= items[1:] != items[:-1]
        if self.counted:  # all go to the owner
            first, other = first | other, np.zeros(len(items), bool)
        at, rest = np.flatnonzero(first), np.flatnonzero(other)
        many = np.add.reduceat(other, at, dtype=np.int64) > 0
        edges = np.flatnonzero(np.diff(part[at], prepend=part[at[0]] + np.uint64(1)))
        parts, bodies = part[at[edges]].astype(np.int64).tolist(), []
        for k in np.split(np.arange(len(at)), edges[1:]):
            body = [low[at[k]], items[at[k]], many[k]] + [name[at[k]]] * self.strong
            bodies.append(b"".join(x.tobytes() for x in body))
        for k in range(0, len(rest), 65_536):
            some = rest[k : k + 65_536]
            parts.append(-1 - int(name[some[0]] & np.uint64(0x7FFFFFFF)))
            bodies.append(items[some].tobytes() + name[some].tobytes())
        if self.told:
            told_items, told = zip(*self.told)
            parts.append(-1 - (told_items[0] & 0x7FFFFFFF))
            bodies.append(np.array(told_items, np.int64).tobytes() + np.array(told, np.uint64).tobytes())
            self.told = []
        return rows(parts, bodies)


def _unpacked(part: int, body: bytes, strong: bool):
    n = len(body) // (21 if strong else 13)
    low, items, many = np.frombuffer(body, "<u4", n), np.frombuffer(body, np.int64, n, 4 * n), np.frombuffer(body, bool, n, 12 * n)
    name = np.frombuffer(body, np.uint64, n, 13 * n) if strong else np.uint64(part << 32) | low.astype(np.uint64)
    return low, items, many, name


def _settled(held: list[tuple], later: bool, counted: bool = False):
    """(items, names) that the entries of one range answer."""
    low, items, many, name = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((items, name, low))
    low, items, many, name = low[order], items[order], many[order], name[order]
    first = np.ones(len(items), bool)
    first[1:] = (low[1:] != low[:-1]) | (name[1:] != name[:-1])
    at = np.flatnonzero(first)
    size = np.diff(at, append=len(items))
    least, most = items[at], items[at + size - 1]
    if later:
        on = items > np.repeat(least, size)
    else:
        on = np.repeat((least != most) | np.logical_or.reduceat(many, at), size)
    new = first.copy()
    new[1:] |= items[1:] != items[:-1]
    if counted:
        power = np.frexp(np.add.reduceat(new, at, dtype=np.int64))[1].astype(np.uint64)
        name = name | np.repeat(power, size) << np.uint64(COUNT_AT)
    on &= new
    return items[on], name[on]


class _Answers:
    """Answers of one owner, packed by bucket of items."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.size = buckets, [], 0

    def add(self, items: np.ndarray, names: np.ndarray):
        self.held.append((items, names))
        self.size += len(items)

    def batches(self, least: int = 1):
        if self.size < least:
            return
        items, names = (np.concatenate(c) for c in zip(*self.held))
        self.held, self.size = [], 0
        bucket = ((mix(items.view(np.uint64)) >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        bucket, items, names = bucket[order], items[order], names[order]
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
        bodies = [items[i:j].tobytes() + names[i:j].tobytes() for i, j in zip(edges, [*edges[1:], len(items)])]
        yield rows(bucket[edges].astype(np.int64).tolist(), bodies)


def _pairs(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(body) // 16
    return np.frombuffer(body, np.int64, n), np.frombuffer(body, np.uint64, n, 8 * n)


def answered(sent: DataFrame, ranges: int, strong: bool = False, later: bool = False, counted: bool = False) -> DataFrame:
    """(item, names) from what senders sent, one row for each item with an answer:
    ``names`` packs the different keys that it shares with another item; with ``later``
    only those that a smaller item has; with ``counted``, as the senders have it, they
    are counted names."""

    @quiet
    def own(batches):
        held: dict[int, list] = {}
        out = _Answers(ranges)
        for b in batches:
            for part, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if part >= 0:
                    held.setdefault(part, []).append(_unpacked(part, body, strong))
                else:
                    out.add(*_pairs(body))
            yield from out.batches(FLUSH)
        for part in list(held):
            out.add(*_settled(held.pop(part), later, counted))
            yield from out.batches(FLUSH)
        yield from out.batches()

    @quiet
    def gather(batches):
        held = [_pairs(body) for b in batches for body in b.column(1).to_pylist()]
        if not held:
            return
        items, names = (np.concatenate(c) for c in zip(*held))
        del held
        order = np.lexsort((names, items))
        items, names = items[order], names[order]
        new = np.ones(len(items), bool)
        new[1:] = (items[1:] != items[:-1]) | (names[1:] != names[:-1])
        items, names = items[new], names[new]
        edges = np.append(np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]])), len(items))
        for k in range(0, len(edges) - 1, 10_000):
            at = edges[k : k + 10_001]
            offsets = ((at - at[0]) * 8).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(names[at[0] : at[-1]].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(items[at[:-1]]), packed], names=["item", "names"])

    return sent.repartition(ranges, "part").mapInArrow(own, SENT).repartition(ranges, "part").mapInArrow(gather, "item long, names binary")


def unpacked(names: bytes) -> np.ndarray:
    """Names of an answer, in order."""
    return np.frombuffer(names, np.uint64)
