from __future__ import annotations

import hashlib
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import types as T
from weftlink.llm import suffix_search
from weftlink.llm.suffix_search import decontaminate

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("hits", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("doc_id", T.StringType())])


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for s in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if got := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= got
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [4_000_000, 700])
def test_against_brute_force(spark, block):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)] + ["été", "L'eau", "x"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(8, 40)))) for i in range(20)] + [(90, None), (91, ""), (92, "zebra stripe"), (93, "..."), (12, "again w1 w2")]
    items.append((94, items[0][1]))
    docs = [(1, None), (2, ""), (3, "Zebra, STRIPE!"), (4, items[0][1]), (4, items[0][1])]
    for k in range(60):
        body = rng.choices(vocab, k=rng.randint(1, 200))
        if k % 2:
            w = words(rng.choice(items)[1])
            s = rng.randrange(max(1, len(w) - 9))
            body[len(body) // 2 :] = w[s : s + rng.randint(8, 14)] + body[len(body) // 2 :]
        docs.append((10 + k, "; ".join(body).upper() if k % 3 else " ".join(body)))
    docs.append((99, " ".join(rng.choices(vocab, k=50_000)) + " " + items[1][1]))
    got = decontaminate(
        spark.createDataFrame([(d, t, "q", "r") for d, t in docs], SCHEMA).repartition(3), spark.createDataFrame([(i, t, "z") for i, t in items], ITEMS), block_bytes=block
    ).drop("longest_match", "longest_first_word")
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    none, no_items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEMS)
    assert decontaminate(none, no_items).collect() == []
    row = decontaminate(spark.createDataFrame([(1, "a b", "", "")], SCHEMA), no_items).first()
    assert (row["n_words"], row["n_hit"], row["contaminated"]) == (2, 0, False)


def brute_longest(text, items):
    """(words, first word) of the longest common run that holds a window."""
    best, first, w = 0, -1, words(text)
    for _, t in items:
        v, before = words(t), [0] * (len(w) + 1)
        for x in v:
            now = [0] + [before[k] + 1 if w[k] == x else 0 for k in range(len(w))]
            for k, n in enumerate(now):
                if n >= min(10, len(v)) and (n > best or n == best and n and k - n < first):
                    best, first = n, k - n
            before = now
    return best, first


@pytest.mark.parametrize("block", [4_000_000, 700])
def test_longest_matches_and_spans(spark, block):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(8, 40)))) for i in range(15)] + [(20, "zebra stripe"), (21, None)]
    passage = words(items[3][1])
    docs = [(1, items[3][1]), (2, items[3][1]), (3, "x " + items[3][1]), (4, " ".join(passage[1:7])), (5, "w1 nothing"), (6, None), (7, "a zebra stripe zebra stripe")]
    docs += [(8, " ".join(words(items[1][1])[2:] + words(items[0][1]) + words(items[1][1]))), (9, None)]
    docs += [(10 + k, " ".join(rng.choices([*vocab, "other"], k=rng.randint(1, 60)) + passage[: rng.randint(0, len(passage))])) for k in range(40)]
    df, tests = spark.createDataFrame(docs, "doc_id long, text string").repartition(1), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["longest_match"], r["longest_first_word"]) for r in suffix_search.decontaminate(df, tests, block_bytes=block).collect()}
    assert got == {d: brute_longest(t, items) for d, t in docs}
    want = set()
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            n = min(10, len(v))
            windows = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)} if n else set()
            first = end = None
            for s in range(len(w) - n + 1) if n else ():
                if tuple(w[s : s + n]) in windows:
                    if end is None or s > end:
                        if end is not None:
                            want.add((d, i, first, end - first))
                        first = s
                    end = s + n
            if end is not None:
                want.add((d, i, first, end - first))
    spans = [tuple(r) for r in suffix_search.contaminated_spans(df, tests, block_bytes=block).collect()]
    assert len(spans) == len(set(spans)) and set(spans) == want


def test_missing_and_repeated_ids(spark):
    items = [(None, "alpha beta gamma"), (None, "alpha beta gamma"), (3, "delta epsilon"), (3, "delta epsilon"), (3, "zeta eta"), (4, None)]
    docs = [(1, "x alpha beta gamma y"), (None, "delta epsilon zeta eta"), (None, None), (1, "zeta eta alpha beta gamma")]
    df, tests = spark.createDataFrame([(d, t, "q", "r") for d, t in docs], SCHEMA), spark.createDataFrame([(i, t, "z") for i, t in items], ITEMS)
    got = sorted((tuple(r) for r in decontaminate(df, tests).select("doc_id", "n_words", "n_hit", "n_items", "contaminated").collect()), key=str)
    assert got == sorted([(1, 5, 3, 0, True), (None, 4, 4, 1, True), (None, 0, 0, 0, False), (1, 5, 5, 1, True)], key=str)
    spans = {tuple(r) for r in suffix_search.contaminated_spans(df, tests).collect()}
    assert spans == {(1, None, 1, 3), (None, 3, 0, 4), (1, 3, 0, 2), (1, None, 2, 3)}
    assert [r["text"] for r in suffix_search.remove_contaminated(df, tests).collect()] == [None]


def test_a_long_match_takes_no_square():
    """One copied item of many distinct words, whole and in a part."""
    item = [f"w{k}" for k in range(20_000)]
    tests = suffix_search.make_tests([1], [" ".join(item)], 10)
    texts = [" ".join(["x", *item]), " ".join(item[777:13_000]), " ".join(item[:9])]
    w = suffix_search.tokens.scan(*suffix_search.tokens.column_bytes(pa.array(texts)), suffix_search.tokens.PUNCT, lower=True)
    began = time.process_time()
    found = suffix_search.scan_shard(tests, w)
    assert time.process_time() - began < 3
    assert found.longest.tolist() == [20_000, 12_223, 0] and found.first.tolist() == [1, 20_001, -1]
    assert int(found.hit.sum()) == 32_223


def test_longest_matches_of_repetitive_texts():
    """Few kinds of words, so that matches overlap and repeat; every length up to some hundreds."""
    rng = random.Random(11)
    items = [" ".join(rng.choices("ab", k=n)) for n in (9, 14, 60, 300)] + ["a " * 150, "a b " * 90]
    texts = [" ".join(rng.choices("abc", [5, 5, 1], k=rng.randint(0, 200))) for _ in range(40)]
    texts += [" ".join(items[3].split()[s : s + n]) for s, n in ((0, 300), (17, 33), (5, 250), (100, 10))] + ["a " * 97, "b a " * 70, "c " + "a b " * 91]
    tests = suffix_search.make_tests(list(range(len(items))), items, 10)
    w = suffix_search.tokens.scan(*suffix_search.tokens.column_bytes(pa.array(texts)), suffix_search.tokens.PUNCT, lower=True)
    found = suffix_search.scan_shard(tests, w)
    got = [(n, p - b if n else -1) for n, p, b in zip(found.longest.tolist(), found.first.tolist(), w.bounds.tolist())]
    assert got == [brute_longest(t, list(enumerate(items))) for t in texts]
