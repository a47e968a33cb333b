"""Word hashing shared by the operators on word windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 2_000_000  # text split together

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array):
    """(start, stop) of runs of rows of about SLICE_BYTES, one row at least."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES)))
        yield at, stop
        at = stop


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts, end to end; null text: none.

    ``flat`` holds the words, ``values`` their 64-bit hashes, ``edges`` where each
    text begins and the last one ends.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        keep = pc.greater(pc.binary_length(flat), 0)
        some = keep.to_numpy(zero_copy_only=False)
        if not some.all():
            counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[some], minlength=len(counts))
            flat = flat.filter(keep)
        self.flat = flat
        self.edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        coded = flat.dictionary_encode()
        digest = xxhash.xxh3_64_intdigest
        names = np.array([digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
        self.values = names[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)

    def of(self, i: int) -> pa.Array:
        return self.flat.slice(self.edges[i], self.edges[i + 1] - self.edges[i])

    def owner(self, size: int) -> np.ndarray:
        """Text of each start of ``size`` consecutive words; -1 where they would
        cross an end."""
        n = max(0, len(self.values) - size + 1)
        out = np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))
        return np.where(out[:n] == out[size - 1 :], out[:n], -1) if n else np.zeros(0, np.int64)


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((BASE, INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of every ``size`` consecutive values."""
    n = len(values)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _upto(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:n], dtype=np.uint64)])
    return (total[size:] - total[:-size]) * down[: n - size + 1]


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest of every ``size`` consecutive values, by doubling."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
