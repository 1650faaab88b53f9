from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T
from weftlink.llm.language_id import RIDGE, SLOT_BITS, Grams, _gram_hashes, held_out, identify_languages, keep_identified, learn, predict, train_language_model

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.StringType())])
SYLLABLES = {"en": "the ing and tion er wh".split(), "fr": "le eau oux tion é que".split(), "de": "der ung sch ein ü keit".split()}


def sample(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        out.append((i, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), lang))
    return out


def test_held_out_accuracy(spark):
    rows = [(d, t, lang, "x") for d, t, lang in sample(400)]
    odd = [(1000, None, "en", ""), (1001, "", None, ""), (1002, "123 ... !!", "fr", ""), (1003, rows[0][1], None, ""), (1003, rows[0][1], None, ""), (None, "the", "en", ""), (1004, "thewh " * 30_000, "en", "")]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(3)
    rule = held_out("doc_id", 3, 1)
    got = identify_languages(df, train_language_model(df, "doc_id", "text", "lang", ~rule)).collect()
    assert len(got) == len(rows) + len(odd)
    best = {r["doc_id"]: r for r in got}
    assert {best[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"}
    assert best[1004]["lang_pred"] == "en"
    test = [(d, lang) for d, _, lang, _ in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    flags = {r["doc_id"]: r["h"] for r in df.select("doc_id", rule.alias("h")).collect()}
    assert all(flags[d] for d, _ in test)
    assert sum(best[d]["lang_pred"] == lang for d, lang in test) >= 0.97 * len(test)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None, ""), (2, "12", None, "")], SCHEMA)
    model = train_language_model(df, "doc_id", "text", "lang", ~held_out("doc_id", 3, 1))
    assert model is None
    assert {r["lang_pred"] for r in identify_languages(df, model).collect()} == {"und"}
    assert [r["doc_id"] for r in keep_identified(df, model).collect()] == [1]
    assert identify_languages(df.limit(0), model).collect() == []


def plain_grams(text):
    low = text.lower()
    return {low[i : i + n] for n in range(1, 5) for i in range(len(low) - n + 1)}


def plain_scores(texts, labels, asked):
    """Kernel ridge regression in its dual form, on kernels of Python's sets."""
    names, known = sorted(set(labels)), set().union(*map(plain_grams, texts))
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b)) if a and b else 0.0
    sets = [plain_grams(t) for t in texts]
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    n, y = len(texts), np.array([[1.0 if v == c else -1.0 for c in names] for v in labels])
    c = np.array([1 / labels.count(v) for v in labels])
    c *= n / c.sum()
    share, root = c / c.sum(), np.sqrt(c)
    aim, mean = share @ y, k @ share
    centred = k - mean[:, None] - mean[None, :] + share @ k @ share
    dual = np.linalg.solve(root[:, None] * centred * root[None, :] + RIDGE * n * np.eye(n), root[:, None] * (y - aim))
    out = []
    for t in asked:
        g = plain_grams(t) & known
        row = np.array([kernel(g, b) for b in sets])
        row = row - share @ row - mean + share @ k @ share
        f = aim + (row * root) @ dual
        out.append((names[int(f.argmax())], min(1.0, max(0.0, (f.max() + 1) / 2))))
    return out


def test_against_exact_kernel_ridge_regression():
    """With all of the training texts as landmarks nothing is approximate but single precision."""
    texts, labels = map(list, zip(*[(t, lang) for _, t, lang in sample(100, 5)]))
    asked = texts[:10] + [t for _, t, _ in sample(80, 6)] + ["thele unger", "é", "zzz the", "Ünï Ç 🙂a"]
    got = predict(learn(texts, labels), asked)
    want = plain_scores(texts, labels, asked)
    assert got[0] == [v for v, _ in want]
    assert got[1].tolist() == pytest.approx([s for _, s in want], abs=2e-3)
    alone = predict(learn(texts, labels), asked[7:8])
    assert alone[0][0] == got[0][7] and abs(alone[1][0] - got[1][7]) < 1e-5


def test_columns_of_grams_that_share_a_slot():
    low = np.arange(50, dtype=np.uint64)
    hashes = np.concatenate([low, low[:20] + np.uint64(1 << SLOT_BITS), low[:5] + np.uint64(7 << SLOT_BITS)])
    grams = Grams(hashes)
    others = np.concatenate([low + np.uint64(9 << SLOT_BITS), np.arange(100, 200, dtype=np.uint64)])
    assert grams.hashes[grams.columns(hashes)].tolist() == hashes.tolist()
    assert set(grams.columns(others).tolist()) == {len(grams)} and Grams(hashes[:0]).columns(others).tolist() == [0] * 150


def test_a_text_is_lowered_by_itself():
    alone = [h[0][h[2]].tolist() for h in _gram_hashes(["ΟΔΟΣ"])]
    beside = [h[0][h[2] & (h[1] == 0)].tolist() for h in _gram_hashes(["ΟΔΟΣ", "ΑΒΓ"])]
    assert alone == beside
