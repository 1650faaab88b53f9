"""Suffix-array deduplication of byte strings with a difference-cover suffix sort in every shard.

Texts are UTF-8 bytes. A byte is removed if a WINDOW-byte string that covers it also starts anywhere else, in
the same document or another; strings are judged on the input. Documents never run together.

Passages are routed to shards by content (see routed.py); a shard sorts the suffixes of its distinct runs by the
difference cover of 3: the suffixes at places 1 and 2 mod 3 are named by their triples, recursion on the names
orders them, the others follow from one byte and the rank behind it, and both are merged. Suffixes whose
neighbour in the order has the same WINDOW bytes are repeats; a run that stands at several places is one too.
Null texts are empty. Every row is a document of its own, whether it repeats another row, shares its id or has none.
Other columns are ignored, or kept by without_repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm import routed, tokens
from weftlink.llm.sessions import id_and_text, released, released_group, row_key

WINDOW, GRAM = 200, 24
SHARD = 500_000
#: Bytes of texts whose windows are laid out at a time, at over 100 bytes each.
SLICE = 500_000
#: A document is known by its row's key.
WHO = (np.int64,)


def _sort_keys(*cols: np.ndarray) -> np.ndarray:
    """Order of rows by the columns, in one key where they fit."""
    width = [int(c.max(initial=0)).bit_length() for c in cols]
    if sum(width) > 63:
        return np.lexsort(cols[::-1])
    return np.argsort(_join(cols, width), kind="stable")


def _join(cols, width) -> np.ndarray:
    key = cols[0].astype(np.int64)
    for c, w in zip(cols[1:], width[1:], strict=True):
        key = (key << w) | c
    return key


def _merge_counts(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """For every row of a, how many rows of b are smaller; both are in order and no two rows are equal."""
    width = [max(int(x.max(initial=0)), int(y.max(initial=0))).bit_length() for x, y in zip(a, b, strict=True)]
    if sum(width) <= 63:
        return np.searchsorted(_join(b, width), _join(a, width))
    n = len(a[0])
    o = np.lexsort(tuple(np.concatenate([x, y]) for x, y in zip(a, b, strict=True))[::-1])
    before = np.cumsum(o >= n)
    out = np.empty(n, np.int64)
    mine = o < n
    out[o[mine]] = before[mine]
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes of s, whose values are 1 or more; an end counts as 0."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), [0, 0, 0, 0]])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # where n is 1 mod 3 the empty triple at n ends the first half
    at = np.concatenate([one, two])
    triples = t[at], t[at + 1], t[at + 2]
    order = _sort_keys(*triples)
    new = np.ones(len(at), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in triples])
    name = np.empty(len(at), np.int64)
    name[order] = np.cumsum(new)
    if not new.all():
        order = suffix_array(name)
        name[order] = np.arange(1, len(at) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[at] = name
    sa12 = at[order]
    sa12 = sa12[sa12 < n]
    zero = np.arange(0, n, 3)
    zero = zero[_sort_keys(t[zero], rank[zero + 1])]
    first, second = sa12[sa12 % 3 == 1], sa12[sa12 % 3 == 2]
    ahead = _merge_counts((t[zero], rank[zero + 1]), (t[first], rank[first + 1]))
    ahead = ahead + _merge_counts((t[zero], t[zero + 1], rank[zero + 2]), (t[second], t[second + 1], rank[second + 2]))
    out = np.empty(n, np.int64)
    place = np.arange(len(zero)) + ahead
    out[place] = zero
    rest = np.ones(n, bool)
    rest[place] = False
    out[rest] = sa12
    return out


def repeated_windows(units: np.ndarray, starts: np.ndarray, windows: np.ndarray, many: np.ndarray, window: int) -> np.ndarray:
    """Flags of all windows, run after run: the window's bytes start a second time; many: the run stands at several places."""
    size = np.diff(starts)
    # runs side by side, a separator behind each
    text = np.ones(starts[-1] + len(size), np.int16)
    text[routed.take_units(starts[:-1] + np.arange(len(size)), size)] = units.astype(np.int16) + 2
    sa = suffix_array(text)
    begin = starts[:-1] + np.arange(len(size))
    is_window = np.zeros(len(text), bool)
    at = routed.take_units(begin, windows)
    is_window[at] = True
    sa = sa[is_window[sa]]
    same = np.zeros(len(sa), bool)
    if len(sa) > 1:
        # neighbours of equal first words, then compared byte by byte in growing steps
        pairs = np.arange(len(sa) - 1)
        d = 0
        while d < window and len(pairs):
            step = min(window - d, 8 if d == 0 else 64)
            view = np.lib.stride_tricks.sliding_window_view(text, step)
            keep = np.empty(len(pairs), bool)
            for i in range(0, len(pairs), 50_000):
                p = pairs[i : i + 50_000]
                keep[i : i + 50_000] = (view[sa[p] + d] == view[sa[p + 1] + d]).all(1)
            pairs = pairs[keep]
            d += step
        same[pairs] = True
        same[pairs + 1] = True
    flags = np.zeros(len(text), bool)
    flags[sa[same]] = True
    return flags[at] | np.repeat(many, windows)


def _slices(gram: int):
    def of(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for a, b, data, off in tokens.slices(batch.column(1), SLICE):
                yield {"who": (keys[a:b],), "bounds": off, "units": data, "grams": tokens.mix(tokens.rolling(data, gram), 31)}

    return of


def _shard(window: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        anchor, content, windows, units, place, doc, first = routed.read_messages(table.column("blob"), np.uint8, WHO)
        windows, units, starts, place, anchor = routed.distinct_runs(anchor, content, windows, units, place, window)
        many = np.bincount(place, minlength=len(windows)) > 1
        # shards of about SHARD bytes, cut between anchors
        cuts = [0]
        edges = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        for e in [*edges.tolist(), len(windows)]:
            if starts[e] - starts[cuts[-1]] >= SHARD or e == len(windows):
                cuts.append(e)
        flags = [repeated_windows(units[starts[a] : starts[b]], starts[a : b + 1] - starts[a], windows[a:b], many[a:b], window) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        flags = np.concatenate(flags) if flags else np.zeros(0, bool)
        own = np.concatenate([[0], np.cumsum(windows)])
        placed = routed.taken(flags, own[place], windows[place])
        return routed.span_rows(*routed.spans_of(placed, np.concatenate([[0], np.cumsum(windows[place])]), window, doc, first), buckets=buckets)

    return run


_OUT = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cuts(left: pa.Table, begin, end, doc):
    """(bytes, removed flags) of each row."""
    o = np.argsort(doc, kind="stable")
    doc, begin, end = doc[o], begin[o], end[o]
    for k, text in zip(left.column("_key").to_pylist(), left.column("_text"), strict=True):
        data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
        lo, hi = np.searchsorted(doc, k), np.searchsorted(doc, k, "right")
        yield data, routed.covered(len(data), begin[lo:hi], end[lo:hi]) if hi > lo else np.zeros(len(data), bool)


def _digests(left: pa.Table, begin, end, doc) -> pa.Table:
    n, gone, spans, sha = [], [], [], []
    for data, cut in _cuts(left, begin, end, doc):
        n.append(len(data))
        gone.append(int(cut.sum()))
        spans.append(int((cut & ~np.concatenate([[False], cut[:-1]])).sum()) if len(cut) else 0)
        sha.append(hashlib.sha256(data[~cut].tobytes()).hexdigest())
    return pa.table({"doc": left.column("_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def _kept_texts(left: pa.Table, begin, end, doc) -> pa.Table:
    texts, changed = [], []
    for (data, cut), old in zip(_cuts(left, begin, end, doc), left.column("_text"), strict=True):
        changed.append(bool(cut.any()))
        # a character that lost some of its bytes goes whole
        texts.append(data[~cut].tobytes().decode("utf-8", "ignore") if cut.any() else old.as_py())
    return pa.table({"kept": pa.array(texts, pa.string()), "changed": pa.array(changed, pa.bool_()), "rest": left.column("_rest")})


def _keyed(plain: DataFrame) -> DataFrame:
    return plain.withColumn("_key", row_key("_id", "_text"))


def _found(plain: DataFrame, window: int, gram: int) -> tuple[DataFrame, int]:
    plain = plain.select("_key", "_text")
    spark, buckets = plain.sparkSession, routed.bucket_count(plain)
    slices = _slices(gram)
    bits = spark.sparkContext.broadcast(routed.repeated_filter(plain, slices, buckets, window - gram + 1))
    sent = plain.mapInArrow(released(routed.send(slices, bits, buckets, window, gram)), routed.BLOB_SCHEMA).repartition(buckets, "bucket")
    return sent.groupBy("bucket").applyInArrow(released_group(_shard(window, buckets)), routed.BLOB_SCHEMA), buckets


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256."""
    plain = _keyed(id_and_text(docs, id_col, text_col))
    spans, buckets = _found(plain, window, gram)
    return routed.cut_documents(plain, spans, buckets, WHO, _digests, _OUT).withColumnRenamed("doc", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, length_col: str | None = None) -> DataFrame:
    """docs with all their columns and the remaining text; a character of which a byte was removed goes whole.

    length_col, if given, is set to the new number of characters where a text changed.
    """
    spans, buckets = _found(_keyed(id_and_text(docs, id_col, text_col)), window, gram)
    whole = docs.select(row_key(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("_key"), F.col(text_col).cast("string").alias("_text"), F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("_rest"))
    kind = whole.schema["_rest"].dataType.simpleString()
    out = routed.cut_documents(whole, spans, buckets, WHO, _kept_texts, f"kept string, changed boolean, rest {kind}")
    new = {c: F.col("rest")[c] for c in docs.columns if c != text_col} | {text_col: F.col("kept")}
    if length_col:
        new[length_col] = F.when(F.col("changed"), F.length("kept").cast(docs.schema[length_col].dataType)).otherwise(new[length_col])
    return out.select(*[new[c].alias(c) for c in docs.columns])
