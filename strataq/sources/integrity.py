"""CRC32C of byte strings and files, computed where the bytes are."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession

POLYNOMIAL = 0x82F63B78  # reflected Castagnoli polynomial
STRIPS = 1024


@functools.lru_cache(maxsize=1)
def _table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(POLYNOMIAL), out >> 1)
    return out.astype(np.uint32)


def _plain(data: bytes, state: int) -> int:
    table = _table().tolist()
    for b in data:
        state = table[(state ^ b) & 255] ^ (state >> 8)
    return state


@functools.lru_cache(maxsize=64)
def _shift(zeros: int) -> tuple[tuple[int, ...], ...]:
    """Four tables that move a state over ``zeros`` zero bytes."""
    basis = [1 << i for i in range(32)]
    table = _table().tolist()
    one = [table[x & 255] ^ (x >> 8) for x in basis]  # over one byte

    def apply(m, x):
        out = 0
        for i in range(32):
            if x >> i & 1:
                out ^= m[i]
        return out

    total, power = basis, one
    while zeros:
        if zeros & 1:
            total = [apply(power, x) for x in total]
        power = [apply(power, x) for x in power]
        zeros >>= 1
    return tuple(tuple(apply(total, b << 8 * k) for b in range(256)) for k in range(4))


def crc32c(data: bytes, value: int = 0) -> int:
    """CRC32C; ``value`` continues an earlier one.  Large inputs are cut into strips
    whose states advance together, then are joined by shifting."""
    state = value ^ 0xFFFFFFFF
    length = len(data) // STRIPS
    if length >= 64:
        table = _table()
        block = np.frombuffer(data, np.uint8, STRIPS * length).reshape(STRIPS, length).T.copy()
        states = np.zeros(STRIPS, np.uint32)
        states[0] = state
        for row in block:
            states = table[(states ^ row) & 255] ^ (states >> np.uint32(8))
        a, b, c, d = _shift(length)
        state = int(states[0])
        for s in states[1:].tolist():
            state = a[state & 255] ^ b[state >> 8 & 255] ^ c[state >> 16 & 255] ^ d[state >> 24] ^ s
        data = data[STRIPS * length :]
    return _plain(data, state) ^ 0xFFFFFFFF


def file_checksums(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, length, crc32c) of every Parquet file in some folders."""
    import pandas as pd

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "length": b["length"], "crc32c": [crc32c(bytes(x)) for x in b["content"]]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(list(paths))
    return files.select("path", "length", "content").mapInPandas(run, "path string, length long, crc32c long")
