"""Routing of repeated passages to shards by their content; shared by the two substring operators.

Every window (a fixed number of units, bytes or words, of one document) has an anchor: the smallest hash among
the short grams inside it. Equal windows have equal anchors, so all copies of a window reach the shard of its
anchor, and shards are independent. Neighbouring windows mostly share an anchor and travel as one run.

1. One scan counts the places of anchors (unique hashes of each task are exchanged). Those that occur twice or more go into a
   Bloom filter of fixed size: a window with any other anchor occurs once. A full filter only means more to send.
2. A second scan sends the runs with such anchors. A task sends equal runs once, with their places.
3. Shards merge equal runs and decide, by the operator's own index, which windows are repeats.
4. Spans of repeats meet their documents by document bucket; texts are shuffled once, here.

A row is known by its key, a hash of its id and its text, so rows that share an id don't share spans, and the rows
without an id, or of one id, are spread over all buckets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm import tokens
from weftlink.llm.sessions import dealt, give_back, pack, released, released_group, rows, unpack_all

FILTER_BITS = 27
PARTS = 64
FLUSH_ANCHORS = 2_000_000
FLUSH_UNITS = 4_000_000
BUCKET_BYTES = 16_000_000
#: Units whose places are laid out at a time; a place takes 8 bytes, a unit 1.
TAKE_UNITS = 500_000

_BLOBS = [("bucket", pa.int32()), ("blob", pa.binary())]
BLOB_SCHEMA = "bucket int, blob binary"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i : i + w] for every i, by running minima of blocks."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = -n % w
    top = np.iinfo(x.dtype).max
    y = np.concatenate([x, np.full(pad, top, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs(grams: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor) of the runs of a slice; grams: hash of the gram at every unit."""
    least = sliding_min(grams, window - gram + 1)
    size = np.diff(bounds) - window + 1
    some = size > 0
    if not some.any():
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    begin, count = bounds[:-1][some], size[some]
    at = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    anchor = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), anchor[first]


def anchor_grams(grams: np.ndarray, w: int) -> np.ndarray:
    """The hash at every place that is the smallest of some w neighbours; a run that repeats itself has two such places."""
    if len(grams) < w:
        return grams[:0]
    edge = np.zeros(w - 1, np.uint64)
    most = ~sliding_min(~np.concatenate([edge, sliding_min(grams, w), edge]), w)
    return grams[grams == most]


def _count(slices_of: Callable, buckets: int, width: int):
    def run(batches):
        held, size = [], 0

        def flush():
            key = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            twice = (np.diff(np.append(at, len(key))) > 1).astype(np.uint8)
            parts = list(dealt((tokens.mix(key[at], 21) % np.uint64(buckets)).astype(np.int64), key[at], twice))
            return rows(_BLOBS, [[b for b, _ in parts], [pack(*c) for _, c in parts]])

        for s in slices_of(batches):
            anchor = anchor_grams(s["grams"], width)
            if len(anchor):
                held.append(anchor)
                size += len(anchor)
            if size >= FLUSH_ANCHORS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def _places(key: np.ndarray) -> list[np.ndarray]:
    return [(tokens.mix(key, 60 + i) >> np.uint64(64 - FILTER_BITS)).astype(np.int64) for i in range(2)]


def _repeated(table: pa.Table) -> pa.Table:
    key, twice = unpack_all(table.column("blob"), np.uint64, np.uint8)
    o = np.argsort(key, kind="stable")
    key, twice = key[o], twice[o]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    many = (np.diff(np.append(at, len(key))) > 1) | (np.maximum.reduceat(twice, at) > 0)
    place = np.unique(np.concatenate(_places(key[at][many])))
    width = (1 << FILTER_BITS) // PARTS
    cut = np.searchsorted(place, np.arange(PARTS + 1) * width)
    some = [p for p in range(PARTS) if cut[p] < cut[p + 1]]
    return pa.table({"bucket": pa.array(some, pa.int32()), "blob": pa.array([(place[cut[p] : cut[p + 1]] - p * width).astype(np.uint32).tobytes() for p in some], pa.binary())})


def _bits(table: pa.Table) -> pa.Table:
    bits = np.zeros((1 << FILTER_BITS) // PARTS, bool)
    for b in table.column("blob"):
        bits[np.frombuffer(b.as_py(), np.uint32)] = True
    return pa.table({"bucket": table.column("bucket")[:1].combine_chunks(), "blob": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def repeated_filter(docs: DataFrame, slices_of: Callable, buckets: int, width: int) -> np.ndarray:
    found = docs.mapInArrow(released(_count(slices_of, buckets, width)), BLOB_SCHEMA).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(released_group(_repeated), BLOB_SCHEMA)
    out = np.zeros((PARTS, (1 << FILTER_BITS) // PARTS // 8), np.uint8)
    for r in found.groupBy("bucket").applyInArrow(released_group(_bits), BLOB_SCHEMA).toLocalIterator():
        out[r["bucket"]] = np.frombuffer(bytes(r["blob"]), np.uint8)
    return out.ravel()


def maybe_repeated(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    ok = np.ones(len(key), bool)
    for p in _places(key):
        ok &= (bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 > 0
    return ok


# A message: runs of distinct content with their units, then places of those runs.
RUN = (np.uint64, np.uint64, np.int32)  # anchor, content hash, windows
# A place is the run in this message, the document (some columns, by the operator) and its first unit.


def message(run_cols, units: np.ndarray, place_cols) -> bytes:
    return b"".join([pack(*run_cols), pack(units), pack(*place_cols)])


def read_messages(blobs, unit: np.dtype, who: tuple):
    """(anchor, content, windows, units, run of each place, documents' columns, first unit)."""
    got: list[list] = [[] for _ in range(6 + len(who))]
    base = 0
    for b in blobs:
        b, at, parts = b.as_py(), 0, []
        for types in (RUN, (unit,), (np.int32, *who, np.int32)):
            n = int(np.frombuffer(b, np.int64, 1, at)[0])
            at += 8
            for t in types:
                parts.append(np.frombuffer(b, t, n, at))
                at += n * np.dtype(t).itemsize
        parts[4] = parts[4] + base
        base += len(parts[0])
        for g, p in zip(got, parts, strict=True):
            g.append(p)
    anchor, content, windows, units, run, *doc, first = (np.concatenate(g) for g in got)
    return anchor, content, windows.astype(np.int64), units, run.astype(np.int64), doc, first.astype(np.int64)


def take_units(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def taken(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[take_units(starts, sizes)], laid out for some stretches at a time."""
    ends = np.cumsum(sizes)
    out, i = np.empty(ends[-1] if len(ends) else 0, values.dtype), 0
    while i < len(sizes):
        begin = ends[i] - sizes[i]
        j = max(i + 1, int(np.searchsorted(ends, begin + TAKE_UNITS, "right")))
        out[begin : ends[j - 1]] = values[take_units(starts[i:j], sizes[i:j])]
        i = j
    return out


def distinct_runs(anchor, content, windows, units, run, window: int):
    """Equal runs become one: (windows, units side by side, their starts, new run of each place), in the order of anchors."""
    size = windows + window - 1
    starts = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    o = np.lexsort((windows, content, anchor))
    new = np.ones(len(o), bool)
    new[1:] = (anchor[o][1:] != anchor[o][:-1]) | (content[o][1:] != content[o][:-1]) | (windows[o][1:] != windows[o][:-1])
    name = np.empty(len(o), np.int64)
    name[o] = np.cumsum(new) - 1
    keep = o[new]
    flat = taken(units, starts[keep], size[keep])
    return windows[keep], flat, np.concatenate([[0], np.cumsum(size[keep])]).astype(np.int64), name[run], anchor[keep]


def contents(units: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each stretch units[cut[i] : cut[i + 1]]."""
    raw, at = memoryview(np.ascontiguousarray(units).view(np.uint8)), (cut * units.itemsize).tolist()
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)), np.uint64, len(at) - 1)


def send(slices_of: Callable, bits, buckets: int, window: int, gram: int):
    def run(batches):
        held, size = [], 0

        def flush():
            units = np.concatenate([h[0] for h in held])
            anchor, content, count, src, first, *doc = (np.concatenate([h[i] for h in held]) for i in range(1, len(held[0])))
            bucket = (tokens.mix(anchor, 22) % np.uint64(buckets)).astype(np.int64)
            b_out, m_out = [], []
            for b, (a, c, n, s, f, *d) in dealt(bucket, anchor, content, count, src, first, *doc):
                o = np.lexsort((n, c))
                new = np.ones(len(o), bool)
                new[1:] = (c[o][1:] != c[o][:-1]) | (n[o][1:] != n[o][:-1])
                name = np.empty(len(o), np.int32)
                name[o] = np.cumsum(new) - 1
                k = o[new]
                m_out.append(message((a[k], c[k], n[k].astype(np.int32)), taken(units, s[k], n[k] + window - 1), (name, *d, f.astype(np.int32))))
                b_out.append(b)
            return rows(_BLOBS, [b_out, m_out])

        for s in slices_of(batches):
            at, n, anchor = runs(s["grams"], s["bounds"], window, gram)
            go = maybe_repeated(bits.value, anchor)
            at, n, anchor = at[go], n[go], anchor[go]
            if not len(at):
                continue
            own = np.searchsorted(s["bounds"], at, "right") - 1
            sizes = n + window - 1
            units = taken(s["units"], at, sizes)
            cut = np.concatenate([[0], np.cumsum(sizes)])
            held.append((units, anchor, contents(units, cut), n, cut[:-1] + size, at - s["bounds"][own], *[c[own] for c in s["who"]]))
            size += int(sizes.sum())
            if size >= FLUSH_UNITS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def spans_of(flags: np.ndarray, cut: np.ndarray, window: int, doc: list[np.ndarray], first: np.ndarray):
    """(begin, end, *doc) of the units covered by flagged windows of each place; flags of place i are flags[cut[i] : cut[i + 1]]."""
    lead, lag = flags.copy(), flags.copy()
    lead[1:] &= ~flags[:-1]
    lag[:-1] &= ~flags[1:]
    inner = cut[(cut > 0) & (cut < len(flags))]
    lead[inner] = flags[inner]
    lag[inner - 1] = flags[inner - 1]
    a, b = np.flatnonzero(lead), np.flatnonzero(lag)
    owner = np.searchsorted(cut, a, "right") - 1
    return first[owner] + a - cut[owner], first[owner] + b - cut[owner] + window, *[d[owner] for d in doc]


def cut_documents(docs: DataFrame, spans: DataFrame, buckets: int, who: tuple, finish: Callable, schema: str) -> DataFrame:
    """docs (_key, _text, ...) and spans (bucket, blob of begin, end and documents' columns, the last one the key) meet by bucket; finish(rows of docs, begin, end, *columns) gives a table."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        types = (np.int64, np.int64, *who)
        try:
            return finish(left, *(unpack_all(right.column("blob"), *types) if right.num_rows else [np.zeros(0, t) for t in types]))
        finally:
            give_back()

    return docs.withColumn("bucket", F.pmod("_key", F.lit(buckets)).cast("int")).groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(meet, schema)


def span_rows(begin, end, *doc, buckets: int) -> pa.Table:
    parts = list(dealt(doc[-1].astype(np.int64) % buckets, begin.astype(np.int64), end.astype(np.int64), *doc))
    return pa.table({"bucket": pa.array([b for b, _ in parts], pa.int32()), "blob": pa.array([pack(*c) for _, c in parts], pa.binary())})


def bucket_count(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    return int(max(24, -(-size // BUCKET_BYTES)))


def covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, begin, 1)
    np.add.at(mark, end, -1)
    return np.cumsum(mark[:-1]) > 0
