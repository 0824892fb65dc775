"""Memory of Python workers, which Spark keeps from task to task and from query to query.

What a task has freed stays with the allocators of its worker, and what a worker holds between tasks lies idle beside the
stages after it. Both count towards the executor, so a task gives back what it no longer needs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: What this worker holds between tasks of one kind, by name.
HELD: dict[str, object] = {}


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def lean(read: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], holds: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``read`` for mapInArrow, giving memory back at its end; what the worker holds goes first, unless the task ``holds`` it too."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds and HELD:
            HELD.clear()
            give_back()
        yield from read(batches)
        give_back()

    return task
