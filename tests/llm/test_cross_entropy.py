from __future__ import annotations

import math
import random
import re
from collections import Counter

from pyspark.sql import types as T
from weftlink.llm import cross_entropy
from weftlink.llm.cross_entropy import score_documents

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.StringType())])


def brute(rows, target, mu):
    """(id, words, losses) of every row by models of all other rows."""
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for d, t in rows]
    size = len({w for _, ws in words for w in ws}) + 1
    sides = []
    for own in ([d in target and d is not None for d, _ in words], [True] * len(words)):
        docs = [ws for (_, ws), x in zip(words, own) if x]
        sides.append((own, Counter(w for ws in docs for w in ws), Counter(p for ws in docs for p in zip(ws, ws[1:])), Counter(v for ws in docs for v in ws[:-1])))
    out = []
    for k, (d, ws) in enumerate(words):
        loss = []
        for own, *all_counts in sides:
            mine = (Counter(ws), Counter(zip(ws, ws[1:])), Counter(ws[:-1])) if own[k] else ({}, {}, {})
            uni, pairs, follow = ((lambda key, a=a, b=b: a[key] - b.get(key, 0)) for a, b in zip(all_counts, mine))
            total = sum(all_counts[0].values()) - (len(ws) if own[k] else 0)
            p1 = lambda w: (uni(w) + 1) / (total + size)  # noqa: B023, E731
            p2 = lambda v, w: (pairs((v, w)) + mu * p1(w)) / (follow(v) + mu)  # noqa: B023, E731
            if size < 400 and ws:
                vocab = {w for _, x in words for w in x} | {"\0"}
                assert abs(sum(map(p1, vocab)) - 1) < 1e-9 and abs(sum(p2(ws[0], w) for w in vocab) - 1) < 1e-9
            s = -sum(math.log(p1(w) if i == 0 else p2(ws[i - 1], w)) for i, w in enumerate(ws))
            loss.append(s / len(ws) if ws else None)
        out.append((d, len(ws), *loss))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[1], r[2] is None, r[2] or 0.0)
    got, want = sorted(((r["doc_id"], r["n_words"], r["target_loss"], r["background_loss"], r["score"]) for r in got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:2] == b[:2]
        assert a[2:] == (None,) * 3 if b[2] is None else all(abs(x - y) < 2e-6 for x, y in zip(a[2:], (*b[2:], b[2] - b[3])))


def test_against_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{int(rng.paretovariate(0.7))}" for _ in range(200)] + ["É", "The"]
    rows = [(1, None), (2, ""), (3, "one"), (4, "THE the The"), (4, "THE the The"), (4, "other text"), (None, "the the"), (None, None)] + [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 80)))) for i in range(10, 60)] + [(99, " ".join(rng.choices(vocab, k=20_000)))]
    target = [*range(10, 60, 3), 1, 4, 777]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(3)
    ids = spark.createDataFrame([(t,) for t in [*target, target[0], None]], "doc_id long")
    same(score_documents(df, ids).collect(), brute(rows, set(target), cross_entropy.MU))


def test_a_text_that_occurs_twice_stands_out(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(vocab, k=60))) for i in range(80)]
    rows += [(100 + i, rows[i][1]) for i in range(8)]
    got = {r["doc_id"]: r["background_loss"] for r in score_documents(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA), spark.createDataFrame([(1,)], "doc_id long")).collect()}
    assert max(got[i] for i in range(8)) < min(got[i] for i in range(8, 80))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert score_documents(none, none.select("doc_id")).collect() == []
    row = score_documents(spark.createDataFrame([(1, "a b", "")], SCHEMA), none.select("doc_id")).first()
    assert row["n_words"] == 2 and row["score"] is not None


def test_many_words_and_runs(spark, monkeypatch):
    monkeypatch.setattr(cross_entropy, "FLUSH_WORDS", 20_000)
    rng = random.Random(8)
    rows = [(None, "no id")] + [(i, " ".join([f"rare{i}x{k} w{rng.randrange(9)}" for k in range(1000)] * 2)) for i in range(70)]
    target = set(range(0, 70, 4))
    got = score_documents(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(3), spark.createDataFrame([(t,) for t in target], "doc_id long")).collect()
    same(got, brute(rows, target, cross_entropy.MU))
