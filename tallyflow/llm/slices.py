"""Texts of a task put together into slices of bounded size, and words as numbers within a slice."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

Batches = Iterator[pa.RecordBatch]


class Coder(dict):
    """Numbers from 0 for keys in the order in which they come first."""

    def __missing__(self, key: bytes | str) -> int:
        self[key] = code = len(self)
        return code


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose values of ``column`` have some ``most`` bytes together; one longer value is a part by itself."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)
