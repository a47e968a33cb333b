"""Memory manners of functions that run in Python workers."""

from __future__ import annotations

import ctypes
import functools
import gc


def quiet(run):
    """For a function over batches: no garbage collections while it runs, since they
    would walk tables without cycles; what it freed goes back to the system at its
    end, for workers live on from task to task beside a heap that is full."""

    @functools.wraps(run)
    def wrapped(batches):
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
            release()

    return wrapped


def release() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass
