"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import clear_stashes, scratch_dir, stash

__all__ = ["BROADCAST_ROWS", "clear_stashes", "fresh", "release", "scratch_dir", "small", "stash", "tidy"]

#: Rows of ids, hashes or rates (well under 100 bytes each) up to which a join's smaller side is broadcast.
BROADCAST_ROWS = 1_000_000


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small(df: DataFrame) -> DataFrame:
    """For a join's smaller side: broadcast where a count shows that it is small; else Spark joins by a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def release() -> None:
    """Hand freed memory of Arrow and of the C library back to the system, where the latter can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with freed memory released after each batch and at the end: Spark keeps Python workers for later tasks, and they would keep it beside those."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given() -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b
                del b
                release()

        yield from run(given())
        release()

    return tidied
