"""Arrow string columns as flat numpy code-point arrays and back, without a Python string per row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def codepoints(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all rows, offsets of the rows in them, which rows are valid); a null row is empty."""
    column = column.cast(pa.large_string())
    valid = np.asarray(column.is_valid())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return points, starts[at - at[0]], valid


def strings(points: np.ndarray, offsets: np.ndarray, valid: np.ndarray) -> pa.Array:
    """The Arrow strings of code points with row offsets; the inverse of `codepoints`."""
    raw = points.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8")
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate(([0], np.cumsum(width)))[offsets].astype(np.int64)
    mask = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.LargeStringArray.from_buffers(len(valid), pa.py_buffer(at.tobytes()), pa.py_buffer(raw), mask).cast(pa.string())


#: Bytes of text that an operator on whole batches takes at once; its arrays take some 30 times as much.
SLICE = 4_000_000


def slices(batch: pa.RecordBatch, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices of about `limit` bytes of text, of one row at least."""
    sizes = np.ones(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // limit
    starts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]))
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b > a:
            yield batch.slice(a, b - a)


Batches = Iterator[pa.RecordBatch]


def by_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], limit: int | None = None) -> Callable[[Batches], Batches]:
    """A mapInArrow function of a function on one batch; empty batches and results are left out.

    With a limit, f gets slices of about so many bytes of text.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                for part in slices(batch, limit) if limit else (batch,):
                    if (out := f(part)) is not None and out.num_rows:
                        yield out

    return run
