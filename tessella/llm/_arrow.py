"""Arrow batches in and out of Python, with bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def pieces(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most so many rows and about so many bytes; a single row may be larger."""
    for batch in batches:
        step = max(1, min(rows, int(batch.num_rows * size / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def strings(column: pa.Array) -> tuple[memoryview, list[int], list[bool]]:
    """The UTF-8 bytes of a string column, the offsets of its rows, and which rows are null."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
        width = 8
    else:
        column = column.cast(pa.binary())
        width = 4
    import numpy as np

    nulls = column.is_null().to_pylist() if column.null_count else [False] * len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=f"<i{width}")[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=int)
    return memoryview(data) if data is not None else memoryview(b""), at.tolist(), nulls
