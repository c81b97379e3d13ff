"""Sequential work on ordered sources without one task per source.

Rows are range-partitioned and sorted by (source, order), and a task takes its partition in chunks of at most ``CHUNK`` rows
or a little more, so its memory doesn't grow with the partition. A chunk holds whole sources except, possibly, its first
and its last one. Such a stretch of one source in one chunk is a *piece*. Only a chunk's first and last piece can
go on elsewhere; whatever an operator can't decide about them is at most a bounded number of rows per chunk. Chunks are
numbered in the order of their rows, so a border between two chunks is the same thing within a partition as between two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a chunk, and how many chunks a partition can have at most (a number space, not a limit on rows in practice).
CHUNK, CHUNKS = 1_000_000, 1 << 32


def range_sorted(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Range-partitioned and sorted within partitions. The range bounds come from Spark's own sampling, so a hot source is split."""
    return df.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A partition's rows as tables of at least CHUNK rows, the last one possibly smaller; batches aren't cut. No rows, no table."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def codes(table: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) row indices of the pieces: maximal stretches with equal keys. NULL keys are a value of their own."""
    change = np.zeros(table.num_rows, dtype=bool)
    change[0] = True
    for k in keys:
        c = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= c[1:] != c[:-1]
    start = np.flatnonzero(change)
    return start, np.append(start[1:], table.num_rows)


def doubles(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.float64, copy=False)


def longs(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64, copy=False)


def map_sorted(df: DataFrame, order: Sequence[str], work: Callable[[pa.Table, int], Iterator[pa.RecordBatch] | list], schema: str, partitions: int | None = None) -> DataFrame:
    """Apply ``work(table, chunk number)`` to each chunk of the range-sorted rows. Chunk numbers rise in the order of ``order``.
    ``partitions`` is the number of partitions, by default Spark's own."""

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() * CHUNKS
        for i, table in enumerate(chunks(batches)):
            yield from work(table, first + i)

    return range_sorted(df, order, partitions).mapInArrow(run, schema)
