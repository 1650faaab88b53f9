"""Small helpers that every operator of this package uses."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def give_back() -> None:
    """Returns freed memory to the system, Arrow's and, where it can, the C library's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass


def released(task: Callable) -> Callable:
    """The task, giving freed memory back at its end: Python workers are reused, and an executor counts them all."""

    @wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def released_group(task: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """released for a function of a group."""

    @wraps(task)
    def run(table: pa.Table) -> pa.Table:
        try:
            return task(table)
        finally:
            give_back()

    return run


def released_pair(task: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """released for a function of two groups of one key."""

    @wraps(task)
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return task(left, right)
        finally:
            give_back()

    return run


def rows(schema: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in schema])


def dealt(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns split by bucket, each part in the given order."""
    order = np.argsort(bucket, kind="stable")
    some, cut = np.unique(bucket[order], return_index=True)
    cut, columns = np.append(cut, len(order)), [c[order] for c in columns]
    for k, b in enumerate(some.tolist()):
        yield b, [c[cut[k] : cut[k + 1]] for c in columns]


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays[0])], np.int64).tobytes()
    return head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes, *types: type) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    out, at = [], 8
    for t in types:
        out.append(np.frombuffer(blob, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def unpack_all(blobs, *types: type) -> list[np.ndarray]:
    parts = [unpack(b.as_py() if hasattr(b, "as_py") else b, *types) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate(types)]


def row_key(*columns):
    """A number that rows share only if these columns are equal (and by chance at 2**-64); what tells rows with one id apart."""
    from pyspark.sql import functions as F

    return F.xxhash64(*columns)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under names of its own; other columns never clash."""
    from pyspark.sql import functions as F

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
