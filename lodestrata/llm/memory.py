"""Memory of worker processes, which Spark uses again from stage to stage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def give_back() -> None:
    """Returns freed memory to the system, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def giving_back(over_batches: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over the batches of a partition that gives memory back when they are done."""

    @wraps(over_batches)
    def run(batches):
        yield from over_batches(batches)
        give_back()

    return run
