"""Substring deduplication with a compressed FM-index in every shard.

Texts are words `[^\\x20\\x09-\\x0D]+`, unchanged. A word is removed if a window of WINDOW consecutive words that
covers it also starts in a document with a smaller id; windows are judged on the input.

Passages are routed to shards by content (see routed.py). A shard indexes its distinct runs: a Burrows-Wheeler
transform of contexts of WINDOW words, kept as a wavelet matrix of bit-packed levels with block counts. Every
run is then streamed through the index from its last word to its first, all runs side by side. Backward search
by one word turns the interval of the WINDOW - 1 words behind it into that of the window, whose length-limited
matching statistic has thus reached the threshold; the interval of its first WINDOW - 1 words is the state for
the next step. An interval reports the smallest document in which its window starts.
Null and empty texts have no words. No id is smaller than itself, so rows with the same id remove nothing of each other,
and each loses only its own words. Rows without an id have no order: they are returned unchanged and don't count.
Equal rows give equal results; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftlink.llm import routed, tokens
from weftlink.llm.sessions import id_and_text, released, released_group, row_key

WINDOW, GRAM = 13, 4
SHARD = 1_500_000
#: Words travel as 40 bits of their hash.
UNIT = np.dtype("V5")
#: What stands for a document in messages: its id, and 32 bits of its row's key, which tell rows with one id apart.
WHO = (np.int64, np.uint32)


class WaveletMatrix:
    """rank of symbols in a sequence; one bit-packed level for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, top: int):
        self.levels, self.n = [], len(seq)
        seq = seq.astype(np.int64)
        for b in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (seq >> b) & 1
            packed = np.zeros(len(bit) // 64 + 1, np.uint64)
            raw = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32)
            zeros = len(bit) - int(bit.sum())
            self.levels.append((b, packed, before, zeros))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.base = np.searchsorted(self._order(seq), self._rev(np.arange(top + 1)))

    def _rev(self, x: np.ndarray) -> np.ndarray:
        out, bits = np.zeros_like(x), len(self.levels)
        for i in range(bits):
            out |= ((x >> i) & 1) << (bits - 1 - i)
        return out

    def _order(self, seq: np.ndarray) -> np.ndarray:
        return self._rev(seq)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol stands before at."""
        p = at.copy()
        for b, packed, before, zeros in self.levels:
            word = p >> 6
            ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            p = np.where((symbol >> b) & 1, zeros + ones, p - ones)
        return p - self.base[symbol]


class FMIndex:
    """Of runs of names (1 and more) with a separator 0 behind each; contexts of `depth` words."""

    def __init__(self, names: np.ndarray, depth: int):
        n, self.top = len(names), int(names.max(initial=0))
        self.names = names

        def pair(a: np.ndarray, step: int) -> np.ndarray:
            b = np.concatenate([a[step:], np.full(min(step, n), -1)])[:n] + 1
            return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]

        rank, known = names.astype(np.int64), 1
        ranks = {1: rank}
        while known * 2 <= depth - 1:
            rank = pair(rank, known)
            known *= 2
            ranks[known] = rank
        shorter = pair(rank, depth - 1 - known) if known < depth - 1 else rank
        full = pair(rank, depth - known)
        self.sa = np.argsort(full, kind="stable")
        self.shorter = shorter[self.sa]
        block = np.concatenate([[True], self.shorter[1:] != self.shorter[:-1]]) if n else np.zeros(0, bool)
        at = np.flatnonzero(block)
        which = np.cumsum(block) - 1
        self.begin, self.end = at[which], np.append(at[1:], n)[which]
        f = full[self.sa]
        self.window_at = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if n else at
        self.bwt = WaveletMatrix(names[self.sa - 1], self.top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(names, minlength=self.top + 1))])

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the interval of symbol followed by what [lo, hi) begins with."""
        return self.first[symbol] + self.bwt.rank(symbol, lo), self.first[symbol] + self.bwt.rank(symbol, hi)


def window_intervals(index: FMIndex, starts: np.ndarray, windows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of all windows of all runs, run after run, by streaming the runs backwards side by side."""
    size = windows + depth - 1
    order = np.argsort(-size, kind="stable")
    own = np.concatenate([[0], np.cumsum(windows)])
    lo, hi = np.zeros(own[-1], np.int64), np.zeros(own[-1], np.int64)
    a, b = np.zeros(len(size), np.int64), np.full(len(size), len(index.names))
    by = size[order]
    for t in range(int(by[0]) if len(by) else 0):
        live = order[: np.searchsorted(-by, -t, "left")]  # runs of more than t words
        place = size[live] - 1 - t
        x, y = index.step(index.names[starts[live] + place], a[live], b[live])
        if t >= depth - 1:
            lo[own[live] + place], hi[own[live] + place] = x, y
            x, y = index.begin[x], index.end[x]
        a[live], b[live] = x, y
    return lo, hi


def _slices(gram: int):
    def of(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy().astype(np.uint32)
            for a, b, data, off in tokens.slices(batch.column(1)):
                w = tokens.scan(data, off, tokens.SPACE)
                grams = np.zeros(max(0, len(w.hashes) - gram + 1), np.uint64)
                with np.errstate(over="ignore"):
                    for j in range(gram if len(grams) else 0):
                        grams += w.hashes[j : j + len(grams)] * tokens._Q[j]
                units = np.ascontiguousarray(w.hashes.view(np.uint8).reshape(-1, 8)[:, :5]).view(UNIT).ravel()
                yield {"who": (ids[a:b], keys[a:b]), "bounds": w.bounds, "units": units, "grams": tokens.mix(grams, 32)}

    return of


def _names(units: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(units), 8), np.uint8)
    wide[:, :5] = np.ascontiguousarray(units).view(np.uint8).reshape(-1, 5)
    return wide.view(np.uint64).ravel()


def first_documents(hashes: np.ndarray, starts: np.ndarray, windows: np.ndarray, least: np.ndarray, depth: int) -> np.ndarray:
    """For every window of every run: the smallest document in which it starts; least: the smallest document of each run."""
    size = np.diff(starts)
    text = np.zeros(starts[-1] + len(size), np.int64)
    begin = starts[:-1] + np.arange(len(size))
    text[routed.take_units(begin, size)] = np.unique(hashes, return_inverse=True)[1] + 1
    index = FMIndex(text, depth)
    lo, hi = window_intervals(index, begin, windows, depth)
    owner = np.repeat(least, size + 1)[index.sa]
    inside = np.zeros(len(text), bool)
    inside[routed.take_units(begin, windows)] = True
    owner = np.where(inside[index.sa], owner, np.iinfo(np.int64).max)
    smallest = np.minimum.reduceat(owner, index.window_at) if len(owner) else owner
    which = np.searchsorted(index.window_at, lo)
    if len(lo) and not (index.window_at[which] == lo).all():
        raise RuntimeError("an interval doesn't begin with its window")
    return smallest[which]


def _shard(window: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        anchor, content, windows, units, place, doc, first = routed.read_messages(table.column("blob"), UNIT, WHO)
        windows, units, starts, place, anchor = routed.distinct_runs(anchor, content, windows, units, place, window)
        hashes = _names(units)
        least = np.full(len(windows), np.iinfo(np.int64).max)
        np.minimum.at(least, place, doc[0])
        cuts = [0]
        for e in [*(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), len(windows)]:
            if starts[e] - starts[cuts[-1]] >= SHARD or e == len(windows):
                cuts.append(e)
        docs = [first_documents(hashes[starts[a] : starts[b]], starts[a : b + 1] - starts[a], windows[a:b], least[a:b], window) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        docs = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        own = np.concatenate([[0], np.cumsum(windows)])
        flags = docs[routed.take_units(own[place], windows[place])] < np.repeat(doc[0], windows[place])
        return routed.span_rows(*routed.spans_of(flags, np.concatenate([[0], np.cumsum(windows[place])]), window, doc, first), buckets=buckets)

    return run


_OUT = "doc long, n_words long, n_removed long, kept_sha256 string, kept string"


def _finish(keep_text: bool):
    def run(left, begin, end, doc, key) -> pa.Table:
        ids, keys, texts = left.column("_id"), left.column("_key"), left.column("_text")
        o = np.lexsort((key, doc))
        doc, key, begin, end = doc[o], key[o], begin[o], end[o]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(o) else o
        spans = {(d, k): (a, b) for d, k, a, b in zip(doc[new].tolist(), key[new].tolist(), new.tolist(), np.append(new, len(o))[1:].tolist(), strict=True)}
        n, gone, sha, kept = [], [], [], []
        for i, k, text in zip(ids.to_pylist(), keys.to_pylist(), texts, strict=True):
            data = (text.as_py() or "").encode().split()  # bytes.split() cuts at exactly 0x20 and 0x09-0x0D
            lo, hi = spans.get((i, k & 0xFFFFFFFF), (0, 0))
            cut = routed.covered(len(data), begin[lo:hi], end[lo:hi]) if hi > lo else None
            rest = b" ".join(data if cut is None else [w for w, x in zip(data, cut.tolist(), strict=True) if not x])
            n.append(len(data))
            gone.append(0 if cut is None else int(cut.sum()))
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode() if keep_text else None)
        return pa.table({"doc": ids, "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.string())})

    return run


def fm_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 and, if asked for, the kept words joined by spaces."""
    spark = docs.sparkSession
    plain = id_and_text(docs, id_col, text_col).withColumn("_key", row_key("_id", "_text").bitwiseAND(0xFFFFFFFF))
    buckets = routed.bucket_count(plain)
    slices, own = _slices(gram), plain.where("_id is not null")
    bits = spark.sparkContext.broadcast(routed.repeated_filter(own, slices, buckets, window - gram + 1))
    sent = own.mapInArrow(released(routed.send(slices, bits, buckets, window, gram)), routed.BLOB_SCHEMA).repartition(buckets, "bucket")
    spans = sent.groupBy("bucket").applyInArrow(released_group(_shard(window, buckets)), routed.BLOB_SCHEMA)
    out = routed.cut_documents(plain, spans, buckets, WHO, _finish(keep_text), _OUT).withColumnRenamed("doc", id_col)
    return out if keep_text else out.drop("kept")
