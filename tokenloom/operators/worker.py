"""What every Python task does about its memory."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa


def give_back() -> None:
    """Return memory that is free but held: a Python worker lives on beside the stages after its own."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def tidy(work: Callable) -> Callable:
    """`work`, a generator over the Arrow batches of a partition, that gives memory back when it ends."""

    @functools.wraps(work)
    def run(batches):
        yield from work(batches)
        give_back()

    return run
