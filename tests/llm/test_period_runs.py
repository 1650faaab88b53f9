from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import types as T
from weftlink.llm.period_runs import collapse_runs, find_runs, run_digests, with_planted_period

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("runs", T.StringType()), T.StructField("_w", T.StringType())])


def brute(words, least=6, power=4):
    """All maximal stretches with smallest period q, by trying every q and stretch."""
    out, n = [], len(words)
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            part = words[start : start + length]
            smallest = next(p for p in range(1, q + 1) if all(part[k] == part[k + p] for k in range(length - p)))
            if length >= max(least, power * q) and smallest == q:
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(texts, least=6, power=4):
    table, flat, bounds = {}, [], [0]
    for t in texts:
        flat += [table.setdefault(w, len(table) * 7919 + 3) for w in t]
        bounds.append(len(flat))
    out = [[] for _ in texts]
    for d, *r in zip(*(x.tolist() for x in find_runs(np.array(flat, np.uint64), np.array(bounds), least, power)), strict=True):
        out[d].append(tuple(r))
    return out


def test_random_texts():
    rng = random.Random(5)
    texts = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 97, list("ab" * 30), list("aab" * 9 + "aab" * 3 + "c")]
    for _ in range(400):
        n, kinds = rng.randint(0, 80), rng.randint(1, 4)
        t = rng.choices("abcd"[:kinds], k=n)
        for _ in range(rng.randint(0, 3)):
            p, k, at = rng.randint(1, 9), rng.randint(2, 7), rng.randint(0, n)
            unit = rng.choices("abcdefg", k=p)
            t[at:at] = unit * k + unit[: rng.randint(0, p)]
        texts.append(t)
    assert found(texts) == [brute(t) for t in texts]
    assert found(texts, 2, 2) == [brute(t, 2, 2) for t in texts]
    assert sum(map(bool, found(texts))) > 150


def test_long_texts_take_no_square():
    rng = random.Random(1)
    unit = [str(rng.random()) for _ in range(9_000)]
    texts = [["a"] * 100_000, unit * 5, list("ab") * 40_000]
    began = time.perf_counter()
    assert found(texts) == [[(0, 100_000, 1)], [(0, 45_000, 9_000)], [(0, 80_000, 2)]]
    assert time.perf_counter() - began < 30


def words_of(d, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(d).encode()) if d is not None else 1
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected(d, text):
    w = words_of(d, text)
    runs, sha = brute(w), lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (d, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_query_rows_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(None, None), (None, "x x x x x x x"), (1, ""), (2, " \t\n "), (3, "go " * 50), (3, "go " * 50), (4, " é 漢 " * 6), (4, "other"), (5, "a\x00b " * 9)]
    for d in range(10, 260):
        n = rng.choice([0, 1, 3, 10, 40, 90])
        rows.append((d, rng.choice([" ", "  ", "\n", "\x0b"]).join(rng.choices(["one", "two", "thrée", "four", "five"], k=n)) + rng.choice(["", " ", "\t"])))
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(5)
    got = run_digests(collapse_runs(with_planted_period(docs)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(d, t) for d, t in rows), key=str)
    assert run_digests(collapse_runs(with_planted_period(docs.limit(0)))).collect() == []


def test_texts_and_spans(spark):
    docs = spark.createDataFrame([(1, "start so it is so it is so it is so it is end", "", "")], SCHEMA)
    row = collapse_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 12, 3)] and row["collapsed"] == "start so it is end"
