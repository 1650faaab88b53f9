"""Benchmark decontamination by suffix arrays over the training documents.

Documents form shards of a few MB. A shard's suffix array holds the word positions at which a match of
benchmark text can begin: those followed by enough words of the benchmark's vocabulary (every other suffix
can't match a whole window). Every suffix of every benchmark item is looked up by binary search, word by word,
all at once: the interval of document suffixes that begin with its window, which gives the stretches of words
that an item covers. The longest verbatim match of a document, of those that hold a whole window, and its place are
found by doubling from the windows, in a logarithm of its words, and don't depend on other documents of the shard.
Nothing is shuffled; a document is scored where it is read. The benchmark is taken in blocks of bounded size,
each broadcast, so a larger benchmark adds passes, not memory.

A window is `window` consecutive words of an item, or the whole of a shorter item. Null or empty texts and
items have no words. Rows with equal ids, of either table, are handled on their own (items: an id counts once).
Words of an item without an id are hit like others, but such an item has no name to be counted under. Documents
without an id are scored like others. Repeated benchmark rows are read once; other columns are ignored or kept.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm import tokens
from weftlink.llm.sessions import id_and_text, released, rows

BLOCK_BYTES = 4_000_000
NAMELESS = np.iinfo(np.int64).min


@dataclass
class Tests:
    """A block of benchmark items: word names from 1, suffixes, and the distinct windows they begin with."""

    vocab: np.ndarray  # sorted word hashes
    words: np.ndarray  # names of all words, item after item
    left: np.ndarray  # words from each position to the end of its item
    item: np.ndarray  # item of each position
    ids: np.ndarray
    begins: np.ndarray  # positions with a window
    lengths: np.ndarray  # their window's words

    @property
    def least(self) -> int:
        return int(self.lengths.min()) if len(self.lengths) else 0


def make_tests(ids: list[int | None], texts: list[str | None], window: int) -> Tests:
    w = tokens.scan(*tokens.column_bytes(pa.array(texts, pa.string())), tokens.PUNCT, lower=True)
    vocab, names = np.unique(w.hashes, return_inverse=True)
    n = np.diff(w.bounds)
    item = np.repeat(np.arange(len(n)), n)
    left = w.bounds[1:][item] - np.arange(len(item))
    lengths = np.minimum(n[item], window)
    begins = np.flatnonzero((left >= lengths) & (lengths > 0))
    return Tests(vocab, names.astype(np.int64) + 1, left, item, np.array([NAMELESS if i is None else i for i in ids], np.int64), begins, lengths[begins])


def suffix_array(names: np.ndarray, run: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions `at` in the order of the word sequences they begin, told apart up to `depth` words; names beyond run are 0."""
    pad = np.concatenate([names, np.zeros(depth + 4, np.int64)])
    width = int(names.max(initial=0)) + 1
    step = 3 if width < 1 << 21 else 2
    group, order, d = np.zeros(len(at), np.int64), np.arange(len(at)), 0
    open_ = np.ones(len(at), bool)
    while d < depth and open_.any():
        o = np.flatnonzero(open_)
        key = np.zeros(len(o), np.int64)
        for j in range(d, d + step):
            key = key * width + np.where(run[at[order[o]]] > j, pad[at[order[o]] + j], 0)
        s = np.lexsort((key, group[o]))
        order[o], key = order[o][s], key[s]
        new = np.ones(len(o), bool)
        new[1:] = (group[o][1:] != group[o][:-1]) | (key[1:] != key[:-1])
        group[o] = o[np.flatnonzero(new)][np.cumsum(new) - 1]
        alone = new & np.concatenate([new[1:], [True]])
        open_[o[alone]] = False
        d += step
    return at[order]


def match(tests: Tests, names: np.ndarray, run: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every test suffix: the interval of document suffixes that begin with its window."""
    n = len(tests.words)
    pad = np.concatenate([names, [0]])
    lo, hi = np.zeros(n, np.int64), np.full(n, len(sa))
    wlo, whi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    need = np.zeros(n, np.int64)
    need[tests.begins] = tests.lengths
    live, d = np.arange(n) if len(sa) else np.zeros(0, np.int64), 0
    while len(live):
        word = tests.words[live + d]

        def bound(a, b, right, word=word, d=d):
            a, b = a.copy(), b.copy()
            while (a < b).any():
                m = (a + b) >> 1
                p = sa[np.minimum(m, len(sa) - 1)]
                v = np.where(run[p] > d, pad[np.minimum(p + d, len(names))], 0)
                go = (a < b) & ((v <= word) if right else (v < word))
                a, b = np.where(go, m + 1, a), np.where((a < b) & ~go, m, b)
            return a

        low = bound(lo[live], hi[live], False)
        high = bound(low, hi[live], True)
        lo[live], hi[live] = low, high
        live = live[low < high]
        d += 1
        full = live[need[live] == d]
        wlo[full], whi[full] = lo[full], hi[full]
        live = live[need[live] > d]
    return wlo, whi


def _at(places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted place among sorted places, -1 where it is none."""
    k = np.minimum(np.searchsorted(places, wanted), max(len(places) - 1, 0))
    return np.where(places[k] == wanted, k, -1) if len(places) else np.full(len(wanted), -1)


def _longer(names: tuple, tests: Tests, run: np.ndarray, size: int, length: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of factors of `length` words from those of `size` words, size <= length <= 2 * size: document places and names, test places and names.

    Two such factors are equal where those of `size` words at their begins and ends are. Only names that both sides have stay.
    """
    dp, dn, tp, tn = names
    width = int(max(dn.max(initial=0), tn.max(initial=0))) + 1

    def key(p, n, room):
        end = _at(p, p + length - size)
        ok = (end >= 0) & (room >= length)
        return p[ok], n[ok] * width + n[end[ok]]

    tp, tk = key(tp, tn, tests.left[tp])
    dp, dk = key(dp, dn, np.where(own[dp], run[dp], 0) if own is not None else run[dp])
    known = np.intersect1d(tk, dk)
    t, d = _at(known, tk), _at(known, dk)
    return dp[d >= 0], d[d >= 0], tp[t >= 0], t[t >= 0]


def longest_matches(tests: Tests, run: np.ndarray, doc: np.ndarray, docs: int, window: int, names: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word) of every document's longest run that occurs in an item, of those with `window` words at least; names: places and names of its windows, and those of the tests.

    Names double in length while a document has a factor that an item has; then its length is found by halves, as a
    factor between two lengths is named by the two that cover it. So a match takes the logarithm of its words in passes.
    """
    longest, first = np.zeros(docs, np.int64), np.full(docs, -1)
    size, now = window, names

    def note(dp: np.ndarray, length: np.ndarray | int) -> None:
        d, k = np.unique(doc[dp], return_index=True)  # places rise
        longest[d], first[d] = length, dp[k]

    while len(now[0]):
        note(now[0], size)
        longer = _longer(now, tests, run, size, 2 * size)
        # documents whose factors end here, by halves between size and 2 * size
        todo = np.setdiff1d(doc[now[0]], doc[longer[0]])
        low, high = np.full(docs, size), np.full(docs, 2 * size)
        while len(todo := todo[high[todo] - low[todo] > 1]):
            middle = (low[todo] + high[todo]) // 2
            for m in np.unique(middle).tolist():
                asked = todo[middle == m]
                of = np.zeros(docs, bool)
                of[asked] = True
                dp = _longer(now, tests, run, size, m, of[doc])[0]
                note(dp, m)
                some = np.isin(asked, doc[dp])
                low[asked[some]], high[asked[~some]] = m, m
        now, size = longer, 2 * size
    return longest, first


def _merged(item: np.ndarray, at: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first word, end) of the hit stretches: windows of one item that overlap in a document are one."""
    order = np.lexsort((at, item, doc[at]))
    item, at, end = item[order], at[order], end[order]
    group = np.cumsum(np.concatenate([[0], (item[1:] != item[:-1]) | (doc[at[1:]] != doc[at[:-1]])])) if len(at) else at
    reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)
    new = np.ones(len(at), bool)
    new[1:] = (group[1:] != group[:-1]) | (at[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return item[first], at[first], reach[np.append(first[1:], len(at)) - 1] if len(at) else end


@dataclass
class Found:
    """What a shard has of the tests."""

    hit: np.ndarray  # flag of every word
    spans: tuple[np.ndarray, np.ndarray, np.ndarray]  # item, first word and end of the hit stretches in order of documents
    longest: np.ndarray  # words of every document's longest verbatim match with a whole window, 0 without
    first: np.ndarray  # its first word in the shard


def scan_shard(tests: Tests, w: tokens.Words, lengths: bool = True) -> Found:
    """lengths: whether the longest matches are asked for."""
    docs, hit = len(w.bounds) - 1, np.zeros(len(w.hashes), bool)
    none = np.zeros(0, np.int64)
    nothing = Found(hit, (none, none, none), np.zeros(docs, np.int64), np.full(docs, -1))
    if not len(tests.begins) or not len(w.hashes):
        return nothing
    place = np.minimum(np.searchsorted(tests.vocab, w.hashes), len(tests.vocab) - 1)
    names = np.where(tests.vocab[place] == w.hashes, place + 1, 0)
    stop = np.append(np.flatnonzero(names == 0), len(names))
    place = np.arange(len(names))
    doc_of = w.docs
    run = np.minimum(stop[np.searchsorted(stop, place)], w.bounds[1:][doc_of]) - place
    at = np.flatnonzero(run >= tests.least)
    if not len(at):
        return nothing
    window = int(tests.lengths.max())
    sa = suffix_array(names, run, at, window)
    lo, hi = match(tests, names, run, sa)
    found = hi[tests.begins] > lo[tests.begins]
    begins, size = tests.begins[found], tests.lengths[found]
    # a window that an item has more than once counts once
    same = np.unique(np.stack([lo[begins], hi[begins], size, tests.ids[tests.item[begins]]], 1), axis=0)
    much = same[:, 1] - same[:, 0]
    p = sa[np.repeat(same[:, 0] - np.cumsum(much) + much, much) + np.arange(int(much.sum()))]
    length, item = np.repeat(same[:, 2], much), np.repeat(same[:, 3], much)
    mark = np.zeros(len(names) + 1, np.int64)
    np.add.at(mark, p, 1)
    np.add.at(mark, p + length, -1)
    longest, first = nothing.longest, nothing.first
    if lengths:
        # windows of shorter items are their longest matches; longer matches begin with a whole window
        order = np.lexsort((p, -length, doc_of[p]))
        of, k = np.unique(doc_of[p[order]], return_index=True)
        longest[of], first[of] = length[order][k], p[order][k]
        whole = np.unique(np.stack([same[:, 0], same[:, 1]], 1)[same[:, 2] == window], axis=0)
        much = whole[:, 1] - whole[:, 0]
        dp = sa[np.repeat(whole[:, 0] - np.cumsum(much) + much, much) + np.arange(int(much.sum()))]
        dn, order = np.repeat(np.arange(len(whole)), much), np.argsort(dp)
        tp = begins[size == window]
        tn = np.searchsorted(whole[:, 0], lo[tp])
        long_, start = longest_matches(tests, run, doc_of, docs, window, (dp[order], dn[order], tp, tn))
        longest, first = np.where(long_ > longest, long_, longest), np.where(long_ > longest, start, first)
    return Found(np.cumsum(mark[:-1]) > 0, _merged(item, p, p + length, doc_of), longest, first)


def _items(w: tokens.Words, spans: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[list[int]]:
    """The items found in each document."""
    cut = np.searchsorted(spans[1], w.bounds) if not len(spans[1]) else np.searchsorted(w.docs[spans[1]], np.arange(len(w.bounds)))
    return [sorted(set(spans[0][a:b].tolist()) - {NAMELESS}) for a, b in zip(cut[:-1], cut[1:], strict=True)]


_STATE = [("doc", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.int64())), ("longest", pa.int64()), ("first", pa.int64())]
_OUT = [("doc", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest_match", pa.int64()), ("longest_first_word", pa.int64())]


def _block(tests, first: bool, last: bool):
    def run(batches):
        t: Tests = tests.value
        for batch in batches:
            for a, b, data, off in tokens.slices(batch.column(1)):
                w = tokens.scan(data, off, tokens.PUNCT, lower=True)
                found = scan_shard(t, w)
                hit, n, items = found.hit, np.diff(w.bounds), _items(w, found.spans)
                longest, start = found.longest, np.where(found.longest > 0, found.first - w.bounds[:-1], -1)
                if not first:
                    for k in range(b - a):
                        old = batch.column(3)[a + k].as_py()
                        if old:
                            hit[w.bounds[k] : w.bounds[k + 1]] |= np.unpackbits(np.frombuffer(old, np.uint8), count=int(n[k])).astype(bool)
                        items[k] = sorted(set(items[k]) | set(batch.column(4)[a + k].as_py()))
                    was, place = (batch.column(k).to_numpy(zero_copy_only=False)[a:b] for k in (5, 6))
                    start = np.where((was > longest) | (was == longest) & (place < start), place, start)
                    longest = np.maximum(longest, was)
                total = np.concatenate([[0], np.cumsum(hit)])
                n_hit = total[w.bounds[1:]] - total[w.bounds[:-1]]
                ids = batch.column(0).slice(a, b - a)
                if last:
                    sha = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items]
                    yield rows(_OUT, [ids, n, n_hit, [len(x) for x in items], sha, n_hit > 0, longest, start])
                else:
                    bits = [np.packbits(hit[w.bounds[k] : w.bounds[k + 1]]).tobytes() if n_hit[k] else b"" for k in range(b - a)]
                    yield rows(_STATE, [ids, batch.column(1).slice(a, b - a), n, bits, items, longest, start])

    return run


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """(distinct items with the block of each, number of blocks). A block is about block_bytes, and one item at least."""
    items = id_and_text(benchmark, id_col, text_col).where("_text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    return items.withColumn("_block", F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks))), blocks


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match (words, 0 where no window occurs), longest_first_word (the first of those that begin such a match, from 0; -1 without)."""
    spark = docs.sparkSession
    items, blocks = _blocks(benchmark, item_id_col, item_text_col, block_bytes)
    state = id_and_text(docs, id_col, text_col)
    for k in range(blocks):
        got = items.where(F.col("_block") == k).collect()
        tests = spark.sparkContext.broadcast(make_tests([r["_id"] for r in got], [r["_text"] for r in got], window))
        last = k == blocks - 1
        schema = "doc long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_first_word long" if last else "doc long, text string, n_words long, hits binary, items array<long>, longest long, first long"
        state = state.mapInArrow(_block(tests, k == 0, last), schema)
    return state.withColumnRenamed("doc", id_col)


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per stretch of a document that windows of an item cover: id, item_id, first word (from 0) and words. Rows of docs with equal ids give their stretches each."""
    spark = docs.sparkSession
    (items, blocks), plain, out = _blocks(benchmark, item_id_col, item_text_col, block_bytes), id_and_text(docs, id_col, text_col), None
    for k in range(blocks):
        got = items.where(F.col("_block") == k).collect()
        tests = spark.sparkContext.broadcast(make_tests([r["_id"] for r in got], [r["_text"] for r in got], window))

        def find(batches, tests=tests):
            for batch in batches:
                for a, b, data, off in tokens.slices(batch.column(1)):
                    w = tokens.scan(data, off, tokens.PUNCT, lower=True)
                    item, first, end = scan_shard(tests.value, w, lengths=False).spans
                    doc = w.docs[first]
                    yield rows([(c, pa.int64()) for c in ("doc", "item_id", "first_word", "n_words")], [batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(item, mask=item == NAMELESS), first - w.bounds[doc], end - first])

        part = plain.mapInArrow(released(find), "doc long, item_id long, first_word long, n_words long")
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("doc", id_col)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows in which a window of the benchmark occurs; all columns stay, and nothing is shuffled."""
    spark, place = docs.sparkSession, docs.columns.index(text_col)
    items, blocks = _blocks(benchmark, item_id_col, item_text_col, block_bytes)
    for k in range(blocks):
        texts = [r["_text"] for r in items.where(F.col("_block") == k).collect()]
        tests = spark.sparkContext.broadcast(make_tests(list(range(len(texts))), texts, window))

        def clean(batches, tests=tests):
            for batch in batches:
                keep = []
                for _, _, data, off in tokens.slices(batch.column(place)):
                    w = tokens.scan(data, off, tokens.PUNCT, lower=True)
                    hit = np.concatenate([[0], np.cumsum(scan_shard(tests.value, w, lengths=False).hit)])
                    keep.append(hit[w.bounds[1:]] == hit[w.bounds[:-1]])
                yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

        docs = docs.mapInArrow(released(clean), docs.schema)
    return docs
