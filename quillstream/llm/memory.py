"""What a task's process keeps when the task has ended.

Spark keeps Python processes for later tasks, of other stages too.  Memory that a task
freed stays with the allocators of its idle process, where it counts against the executor.
"""

from __future__ import annotations

import ctypes
import functools
import inspect

import pyarrow as pa


def give_back() -> None:
    """Let the allocators return what is free to the system, where they can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(run):
    """A function of a task's batches, or of one group's table, after which free memory is given back."""
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def task(batches):
            try:
                yield from run(batches)
            finally:
                give_back()

    else:

        @functools.wraps(run)
        def task(table):
            try:
                return run(table)
            finally:
                give_back()

    return task
