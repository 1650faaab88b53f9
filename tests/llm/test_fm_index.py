from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import types as T
from weftlink.llm.fm_index import WaveletMatrix, fm_dedup

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("bucket", T.StringType()), T.StructField("blob", T.StringType())])


def test_rank():
    rng = np.random.default_rng(3)
    for top in (0, 1, 5, 64, 1000):
        seq = rng.integers(0, top + 1, 700)
        w = WaveletMatrix(seq, top)
        c, at = rng.integers(0, top + 1, 400), rng.integers(0, 701, 400)
        assert w.rank(c, at).tolist() == [int((seq[:i] == x).sum()) for x, i in zip(c, at)]


def brute(rows, size=13):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            least[k] = min(d, least.get(k, d))
    out = []
    for d, w in words:
        cut = [False] * len(w)
        for i in range(len(w) - size + 1):
            if least[tuple(w[i : i + size])] < d:
                cut[i : i + size] = [True] * size
        kept = " ".join(x for x, c in zip(w, cut) if not c)
        out.append((d, len(w), sum(cut), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def cases():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)] + ["The", "the", "été", "\x0b".join("xy"), "a b"]
    text = lambda n: rng.choices(vocab, k=n)
    passage = text(60)
    texts = [None, "", "   ", "x", " ".join(["same"] * 12), " ".join(["same"] * 13), " ".join(["same"] * 40), " ".join("a b c d".split() * 20)]
    for k in range(50):
        t = text(rng.randint(1, 90))
        if k % 2:
            t = t + passage[k : k + rng.randint(10, 40)] + text(5)
        texts.append("\n".join(t) if k % 3 else " ".join(t))
        if k % 5 == 0:
            texts.append(texts[-1])
    long = text(30_000)
    texts += [" ".join(long), " ".join(long[5000:15000])]
    rng.shuffle(texts)
    return [(2 * i + 1, t) for i, t in enumerate(texts)]


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "p", "q") for d, t in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, fm_dedup(df, **options).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))


def test_against_brute_force(spark):
    rows = cases()
    assert run(spark, rows) == brute(rows)


def test_small_shards(spark, monkeypatch):
    import weftlink.llm.fm_index as m

    monkeypatch.setattr(m, "SHARD", 200)
    rows = [(d, t) for d, t in cases() if not t or len(t) < 5000]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert fm_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def thue_morse(k, a, b):
    s = [a]
    for _ in range(k):
        s += [b if x == a else a for x in s]
    return s


def test_words_and_runs_on_which_polynomial_hashes_collide(spark):
    same, one, two = ["same"] * 12, "".join(thue_morse(10, "a", "b")), "".join(thue_morse(10, "b", "a"))
    rows = [(1, " ".join([*same, one])), (2, " ".join([*same, two])), (3, " ".join(thue_morse(11, "x", "y"))), (4, " ".join(thue_morse(11, "y", "x")))]
    assert run(spark, rows) == brute(rows)


def test_repeated_and_missing_ids(spark):
    text = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [(1, text(0, 40)), (5, text(0, 20) + " own words"), (5, text(100, 130)), (5, text(100, 130)), (7, text(110, 125)), (None, text(0, 40)), (None, text(0, 40)), (None, None)]
    got = {(d, n, r) for d, n, r, _ in run_unsorted(spark, rows)}
    assert got == {(1, 40, 0), (5, 22, 20), (5, 30, 0), (7, 15, 15), (None, 40, 0), (None, 0, 0)}


def run_unsorted(spark, rows):
    df = spark.createDataFrame([(d, t, "p", "q") for d, t in rows], SCHEMA)
    return [tuple(r)[:4] for r in fm_dedup(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
