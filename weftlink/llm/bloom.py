"""A Bloom filter of fixed size over ids; it only ever saves work, never decides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftlink.llm.tokens import mix

BITS = 25
PARTS = 16


def _places(ids: np.ndarray) -> list[np.ndarray]:
    x = ids.astype(np.int64).view(np.uint64)
    return [(mix(x, 40 + i) >> np.uint64(64 - BITS)).astype(np.int64) for i in range(3)]


def bloom_filter(ids: DataFrame) -> np.ndarray:
    """The bits of all ids of a one-column DataFrame: 4 MB whatever its size."""

    def mark(batches):
        bits = np.zeros(1 << BITS, bool)
        for batch in batches:
            for p in _places(batch.column(0).to_numpy(zero_copy_only=False)):
                bits[p] = True
        packed = np.packbits(bits).reshape(PARTS, -1)
        some = [i for i in range(PARTS) if packed[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([packed[i].tobytes() for i in some], pa.binary())], ["part", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << BITS) // 8 // PARTS, np.uint8)
        for b in table.column("bits"):
            total |= np.frombuffer(b.as_py(), np.uint8)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "bits": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((PARTS, (1 << BITS) // 8 // PARTS), np.uint8)
    for r in ids.mapInArrow(mark, "part int, bits binary").groupBy("part").applyInArrow(merge, "part int, bits binary").collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def maybe(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    ok = np.ones(len(ids), bool)
    for p in _places(ids):
        ok &= (bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 > 0
    return ok
