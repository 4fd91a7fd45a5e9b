"""Arrow batches cut so that no run of equal keys is split, and a hash for draws inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def starts_of(table: pa.Table | pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Where the runs of equal (non-null) keys begin."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for key in keys:
        column = table.column(key)
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of sorted rows, with the starts of their runs and their length at the end."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        last = starts_of(batch, keys)[-1]
        if last:
            table = pa.Table.from_batches([*rest[:-1], batch.slice(0, last)]).combine_chunks()
            yield table, np.append(starts_of(as_batch(table), keys), table.num_rows)
            rest = [batch.slice(last)]
        elif len(rest) > 1 and any(rest[-2].column(k)[0].as_py() != batch.column(k)[0].as_py() for k in keys):
            table = pa.Table.from_batches(rest[:-1]).combine_chunks()
            yield table, np.append(starts_of(as_batch(table), keys), table.num_rows)
            rest = [batch]
    if rest:
        table = pa.Table.from_batches(rest).combine_chunks()
        yield table, np.append(starts_of(as_batch(table), keys), table.num_rows)


def runs_of(batches: Iterator[pa.RecordBatch], keys: Sequence[str], take: Callable[[pa.RecordBatch], tuple]) -> Iterator[tuple[tuple, list]]:
    """The keys of each run of sorted rows, with what ``take`` makes of its pieces; a caller that clears the list frees these."""
    own, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = np.append(starts_of(batch, keys), batch.num_rows).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            here = tuple(batch.column(k)[a].as_py() for k in keys)
            if here != own:
                if held:
                    yield own, held
                own, held = here, []
            held.append(take(batch.slice(a, b - a)))
    if held:
        yield own, held


def as_batch(table: pa.Table) -> pa.RecordBatch:
    return table.to_batches()[0]


def matrix(column: pa.Array | pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    """An Arrow list column of equally long lists as a two-dimensional array."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.chunk(0) if isinstance(array, pa.ChunkedArray) else array
    return array.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(array), -1) if len(array) else np.zeros((0, 0), kind)


def lists(values: np.ndarray) -> pa.Array:
    """A two-dimensional array as an Arrow list column."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).reshape(-1)))


def blobs(values: np.ndarray) -> pa.Array:
    """A two-dimensional array as an Arrow column of its lines' bytes, which cost no work per number on their way to a task."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * (values.shape[1] * values.dtype.itemsize)
    return pa.BinaryArray.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())])


def from_blobs(column: pa.Array, kind) -> np.ndarray:
    """What ``blobs`` made a column of."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)


def mixed(*parts) -> np.ndarray:
    """A 64-bit hash of integers or arrays of them, the same wherever it's computed."""
    h = np.zeros((), np.uint64)
    with np.errstate(over="ignore"):
        for part in parts:
            h = h ^ np.asarray(part).astype(np.int64).astype(np.uint64)
            h = h + np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


def uniform(*parts) -> np.ndarray:
    """Draws in [0, 1) from ``mixed``."""
    return (mixed(*parts) >> np.uint64(11)).astype(np.float64) * 2.0**-53
