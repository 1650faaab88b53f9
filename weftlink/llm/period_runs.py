"""Periodic runs of words, found by partition refinement (Crochemore 1981), and their collapse.

Level l holds the classes of positions whose factors of l words are equal, each document apart; a document ends in a
mark of its own. Level l + 1 parts a class by the class of the next position. Only the smaller parts of what was parted
last are looked at (all but the largest part of each class), so a position is moved a logarithm of times at most. Each
class is a linked list in text order beside a segment of one array; neighbours at distance l on level l are squares with
a primitive root, and squares at consecutive places are one run. All documents of a slice are refined side by side.

A run is a longest stretch with smallest period p, of at least `power` periods and `least` words. It is reported as
(start, length, period), words numbered from 0; the collapsed text keeps the words that no run holds after its first
period, joined by one space. A document's level ends at its number of words over `power`: longer periods make no run.

Every row is a document: rows without an id, of one id, or equal each get their own row. Null and empty texts, and texts
of separators alone, have no run and collapse to an empty text. Other columns are ignored. An empty table gives one.
Words are told apart by 64-bit hashes. The work is a map over rows; no row depends on another, so no source or group of
copies weighs on one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.sessions import id_and_text, released
from weftlink.llm.tokens import mix, scan, slices

LEAST = 6
POWER = 4
_TEXT_BYTES = 4_000_000


class _Distances:
    """(distance, place) of neighbours, handed out by rising distance; sorted lists, of which small ones are merged."""

    def __init__(self):
        self.lists: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, far: np.ndarray, place: np.ndarray) -> None:
        if not len(far):
            return
        while self.lists and len(self.lists[-1][0]) <= 2 * len(far):
            f, p = self.lists.pop()
            far, place = np.concatenate([f, far]), np.concatenate([p, place])
        order = np.argsort(far, kind="stable")
        self.lists.append((far[order], place[order]))

    def take(self, distance: int) -> np.ndarray:
        """Places with this distance; smaller ones have been taken before."""
        found = []
        for k, (far, place) in enumerate(self.lists):
            if far[0] == distance:
                end = int(np.searchsorted(far, distance, "right"))
                found.append(place[:end])
                self.lists[k] = far[end:], place[end:]
        if not found:
            return np.zeros(0, np.int64)
        self.lists = [x for x in self.lists if len(x[0])]
        return np.unique(np.concatenate(found))

    def least(self) -> int | None:
        return min((int(far[0]) for far, _ in self.lists), default=None)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of size[0] numbers, then the same of the others."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _firsts(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


class _Classes:
    """Positions by equal factors; level 1 is made of the words."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray, power: int):
        sizes = np.diff(bounds)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        self.total = len(words) + len(sizes)
        at, marks = np.arange(len(words)) + doc, bounds[1:] + np.arange(len(sizes))
        self.limit = np.repeat(sizes // power, sizes + 1)
        own = words ^ mix(doc.astype(np.uint64), 70)
        order = np.argsort(own, kind="stable")
        first = _firsts(own[order])
        known, size = len(first), np.diff(np.append(first, len(order)))
        self.perm = np.concatenate([at[order], marks])
        self.loc = np.empty(self.total, np.int64)
        self.loc[self.perm] = np.arange(self.total)
        self.cls = np.empty(self.total, np.int64)
        self.cls[self.perm] = np.concatenate([np.repeat(np.arange(known), size), known + np.arange(len(sizes))])
        self.start, self.size = np.zeros((2, self.total + 1), np.int64)
        self.start[: known + len(sizes)] = np.concatenate([first, len(words) + np.arange(len(sizes))])
        self.size[: known + len(sizes)] = np.concatenate([size, np.ones(len(sizes), np.int64)])
        self.used = known + len(sizes)
        self.next, self.prev = np.full((2, self.total), -1)
        self.moved = np.zeros(self.total, bool)
        self.near = _Distances()
        inside = np.ones(max(len(order), 1), bool)
        inside[first] = False
        inside = inside[: len(order)]
        a, b = at[order][:-1][inside[1:]], at[order][1:][inside[1:]]
        self._link(a, b, 1)
        # the largest class of each document is left out
        of = doc[order[first]] if known else doc
        by = np.lexsort((size, of))
        largest = by[np.append(of[by][1:] != of[by][:-1], True)] if known else by
        small = np.ones(known, bool)
        small[largest] = False
        self.small = np.sort(np.concatenate([self.perm[_ranges(first[small], size[small])], marks]))

    def _link(self, a: np.ndarray, b: np.ndarray, level: int) -> None:
        self.next[a], self.prev[b] = b, a
        near = (b - a >= level) & (b - a <= self.limit[a])
        self.near.add((b - a)[near], a[near])

    def squares(self, level: int) -> np.ndarray:
        """Places of the squares with a primitive root of this many words."""
        place = self.near.take(level)
        return place[self.next[place] - place == level]

    def refine(self, level: int) -> None:
        """Classes of this level from those of the one before."""
        j = self.small[self.small > 0]
        i = j - 1
        live = (self.limit[i] >= level) & (self.size[self.cls[i]] > 1)
        i, j = i[live], j[live]
        self.small = i[:0]
        if not len(i):
            return
        key = self.cls[i] * (self.total + 1) + self.cls[j]
        order = np.argsort(key, kind="stable")  # places rise within each part
        i, key = i[order], key[order]
        part = _firsts(key)
        n, parent = np.diff(np.append(part, len(i))), self.cls[i[part]]
        head = _firsts(parent)
        of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(parent))))
        rest = self.size[parent[head]] - np.add.reduceat(n, head)
        # what keeps the parent's name: the rest of it, or the largest part if all have moved
        top = np.flatnonzero(n == np.maximum.reduceat(n, head)[of])
        top = top[_firsts(of[top])]
        new = np.ones(len(part), bool)
        new[top[rest == 0]] = False
        if not new.any():
            return
        i = i[np.repeat(new, n)]
        n, parent = n[new], parent[new]
        part = np.cumsum(n) - n
        head = _firsts(parent)
        of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(parent))))
        gone, old = np.add.reduceat(n, head), parent[head]
        self._unlink(i, np.repeat(of, n), level)
        together = np.ones(len(i), bool)
        together[part] = False
        self.next[i], self.prev[i] = -1, -1
        self._link(i[:-1][together[1:]], i[1:][together[1:]], level)
        # the parts move to the end of their parent's segment
        tail = self.start[old] + self.size[old] - gone
        to = _ranges(tail, gone)
        self.moved[i] = True
        there, here = self.perm[to], self.loc[i]
        there, here = there[~self.moved[there]], here[here < np.repeat(tail, gone)]
        self.perm[here], self.loc[there] = there, here
        self.perm[to], self.loc[i] = i, to
        self.moved[i] = False
        names = self.used + np.arange(len(n))
        self.used += len(n)
        self.start[names], self.size[names] = to[part], n
        self.size[old] -= gone
        self.cls[i] = np.repeat(names, n)
        # of each parent all but the largest part are looked at next
        top = np.flatnonzero(n == np.maximum.reduceat(n, head)[of])
        top = top[_firsts(of[top])]
        under = self.size[old] < n[top]
        small = np.ones(len(n), bool)
        small[top[under]] = False
        left = old[under]
        self.small = np.sort(np.concatenate([i[np.repeat(small, n)], self.perm[_ranges(self.start[left], self.size[left])]]))

    def _unlink(self, i: np.ndarray, of: np.ndarray, level: int) -> None:
        i = i[np.argsort(of * self.total + i, kind="stable")]
        joined = self.next[i[:-1]] == i[1:]
        left = self.prev[i[np.concatenate([[True], ~joined])]]
        right = self.next[i[np.concatenate([~joined, [True]])]]
        both = (left >= 0) & (right >= 0)
        self.next[left[(left >= 0) & ~both]] = -1
        self.prev[right[(right >= 0) & ~both]] = -1
        self._link(left[both], right[both], level)


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs, by document, start and period; document d has the words bounds[d]:bounds[d+1]."""
    sizes = np.diff(bounds)
    found, last = [np.zeros((3, 0), np.int64)], int(sizes.max(initial=0)) // power
    if last:
        classes, level = _Classes(words, bounds, power), 1
        while level <= last:
            place = classes.squares(level)
            if len(place):
                first = np.flatnonzero(np.concatenate([[True], np.diff(place) != 1]))
                length = np.diff(np.append(first, len(place))) - 1 + 2 * level
                whole = length >= max(least, power * level)
                found.append(np.stack([place[first[whole]], length[whole], np.full(int(whole.sum()), level)]))
            if len(classes.small):
                level += 1
                classes.refine(level)
            else:  # all that is left are single places and distances found before
                level = classes.near.least() or last + 1
    place, length, period = np.concatenate(found, axis=1)
    begin = bounds[:-1] + np.arange(len(sizes))
    doc = np.searchsorted(begin, place, "right") - 1
    order = np.lexsort((period, place))
    return doc[order], (place - begin[doc])[order], length[order], period[order]


def _kept(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """The kept words of each document, joined by one space."""
    starts, ends = starts[keep], ends[keep]
    data, inside = data.copy(), np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    chosen = np.cumsum(inside[:-1]).astype(bool)
    last = np.isin(ends, offsets)  # nothing stands between such a word and the document's end
    data[ends[~last]], chosen[ends[~last]] = 0x20, True
    at = np.concatenate([[0], np.cumsum(chosen)])[offsets]
    flat = data[chosen].tobytes()
    return [flat[a:b].removesuffix(b" ") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _collapse(least: int, power: int):
    @released
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1), _TEXT_BYTES):
                w = scan(data, offsets)
                doc, start, length, period = find_runs(w.hashes, w.bounds, least, power)
                cover = np.zeros(len(w.hashes) + 1, np.int64)
                np.add.at(cover, w.bounds[doc] + start + period, 1)
                np.add.at(cover, w.bounds[doc] + start + length, -1)
                texts = _kept(data, offsets, w.starts, w.ends, np.cumsum(cover[:-1]) == 0)
                runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(_RUN))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(b - a + 1)), pa.int32()), runs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, pa.array([t.decode() for t in texts], pa.string())], ["doc_id", "runs", "collapsed"])

    return run


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, power: int = POWER) -> DataFrame:
    """(doc_id, runs array<struct<start, length, period>> by start and period, collapsed string) for every row."""
    schema = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return id_and_text(docs, id_col, text_col).mapInArrow(_collapse(least, power), schema)


def run_digests(found: DataFrame) -> DataFrame:
    """Of collapse_runs' rows: number of runs, the run of the most periods (then the first, then the shortest period), digests of runs and text."""
    zero = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), F.lit(1).cast("long").alias("period"))
    best = F.aggregate("runs", zero, lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    some = found.withColumn("_best", F.when(F.size("runs") > 0, best))
    return some.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_period(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) in which every tenth document, by a hash of its id, goes on with a stretch of its own words again and again."""
    h = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    g, n = F.floor(h / 10), F.size("_w")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.when(h % 10 == 0, words).alias("_w"), g.alias("_g"))
    head = F.when(n > 0, F.col("_g") % n).cast("int")
    period = (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")
    chosen = chosen.withColumn("_a", head).withColumn("_p", F.when(n > 0, period))
    again = F.slice(F.flatten(F.array_repeat(F.expr("slice(_w, _a + 1, _p)"), F.expr("cast(ceil((size(_w) - _a) / _p) as int)"))), F.lit(1), F.expr("size(_w) - _a"))
    planted = F.array_join(F.concat(F.expr("slice(_w, 1, _a)"), again), " ")
    return chosen.select("doc_id", F.when(F.col("_a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))
