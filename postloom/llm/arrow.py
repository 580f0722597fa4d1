"""Arrow passes over texts."""

from __future__ import annotations

import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

Pass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def uncollected(run: Pass) -> Pass:
    """``run`` with the collector of cycles off while it runs, for passes that make many small objects and no cycles.

    Objects are still freed when nothing refers to them; only the repeated search through all of them is saved.
    """

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was = gc.isenabled()
        gc.disable()
        try:
            yield from run(batches)
        finally:
            if was:
                gc.enable()

    return inner
