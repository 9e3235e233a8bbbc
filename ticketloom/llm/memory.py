"""Memory of Python workers, which outlive their tasks."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa


def give_back() -> None:
    """Returns freed memory to the system; allocators keep it otherwise, and every idle worker would hold its peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """The task function ``run`` (batches to batches), followed by ``give_back``."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
