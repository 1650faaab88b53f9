from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from weftlink.llm import tokens, toxicity
from weftlink.llm.language_id import held_out
from weftlink.llm.toxicity import score_toxicity, train_toxicity_model

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType())])


def sample(n=500):
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefghijk", k=rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(5, 150))
        bad = i % 4 == 0
        if bad:
            for _ in range(1 + len(words) // 25):
                words[rng.randrange(len(words))] = rng.choice(["vilest", "rotten", "wretch", "xyl" + rng.choice(vocab)])
        docs.append((i, " ".join(words), "s"))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = sample()
    odd = [(900, None, ""), (901, "", ""), (902, " .. ", ""), (903, "abc " * 40_000 + "rotten vilest", ""), (904, docs[0][1], ""), (904, docs[0][1], "")]
    df, lab = spark.createDataFrame(docs + odd, DOCS).repartition(3), spark.createDataFrame(labels + [(900, 1), (901, None), (None, 1)], LABELS)
    model = train_toxicity_model(df, lab, ~held_out("doc_id", 4, 2))
    got = score_toxicity(df, model).collect()
    assert len(got) == len(docs) + len(odd)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    best = {r["doc_id"]: r for r in got}
    assert best[900]["score"] == best[901]["score"] == best[902]["score"] == 0
    assert best[903]["predicted"] == 1
    test = [(d, y) for d, y in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    assert np.mean([best[d]["predicted"] == y for d, y in test]) >= 0.93


def test_gradients():
    rng = np.random.default_rng(0)
    old, toxicity.f32 = toxicity.f32, np.float64
    try:
        h, e = toxicity.HIDDEN, toxicity.EMBED
        r = lambda *s: rng.standard_normal(s) * 0.4
        p = {"wx": r(2 * e, 6 * h), "bx": r(6 * h), "uf": r(h, 3 * h), "ub": r(h, 3 * h), "wa": r(2 * h, h), "va": r(h), "wo": r(2 * h), "bo": r(1)}
        model = toxicity.Model(np.zeros(0, np.uint64), p)
        x, idx = r(5, 2 * e), rng.integers(0, 5, (3, toxicity.WINDOW))
        idx[1, 7:] = -1
        d = r(3)
        loss = lambda: float((toxicity._forward(model, x, idx)[0] * d).sum())
        g = toxicity._backward(model, x, idx, d, toxicity._forward(model, x, idx, True)[1])
        for name, a in [*p.items(), ("x", x)]:
            flat = a.reshape(-1)
            for j in rng.integers(0, len(flat), 4):
                keep = flat[j]
                flat[j] = keep + 1e-5
                up = loss()
                flat[j] = keep - 1e-5
                down = loss()
                flat[j] = keep
                assert abs((up - down) / 2e-5 - g[name].reshape(-1)[j]) < 1e-4 * max(1, abs(g[name].reshape(-1)[j])), name
    finally:
        toxicity.f32 = old


def plain_logit(model, words):
    """One window, word by word and number by number, from the definitions of a gated recurrent unit and of attention."""
    h, e, p = toxicity.HIDDEN, toxicity.EMBED, {k: v.astype(float) for k, v in model.p.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    inputs = []
    for w in words:
        name = tokens.scan(*tokens.column_bytes(pa.array([w])), tokens.PUNCT, lower=True).hashes[0]
        row = model.vocab.tolist().index(name) + 1 if name in model.vocab else 0
        marked, grams = b"^" + w.encode() + b"$", []
        for n in (3, 5):
            codes = np.array([int.from_bytes(marked[i : i + n], "big") for i in range(len(marked) - n + 1)], np.uint64)
            grams += (tokens.mix(codes, n) >> np.uint64(64 - toxicity.GRAM_BITS)).tolist()
        inputs.append(np.concatenate([p["word"][row], p["gram"][grams].mean(0) if grams else np.zeros(e)]))

    def side(order, u, columns):
        state, out = np.zeros(h), {}
        for t in order:
            g = inputs[t] @ p["wx"][:, columns] + p["bx"][columns]
            z, r = sigmoid(g[:h] + state @ u[:, :h]), sigmoid(g[h : 2 * h] + state @ u[:, h : 2 * h])
            new = np.tanh(g[2 * h :] + r * (state @ u[:, 2 * h :]))
            state = z * state + (1 - z) * new
            out[t] = state
        return out

    n = len(words)
    ahead, back = side(range(n), p["uf"], slice(0, 3 * h)), side(range(n - 1, -1, -1), p["ub"], slice(3 * h, 6 * h))
    both = [np.concatenate([ahead[t], back[t]]) for t in range(n)]
    energy = np.array([np.tanh(x @ p["wa"]) @ p["va"] for x in both])
    share = np.exp(energy - energy.max())
    return float(sum(a * x for a, x in zip(share / share.sum(), both)) @ p["wo"] + p["bo"][0])


def test_scores_against_a_plain_pass():
    rng = random.Random(2)
    docs, labels = sample(120)
    model = toxicity.train([t for _, t, _ in docs], [y for _, y in labels])
    texts = [" ".join(rng.choices(["abc", "rotten", "é", "a", "vilestxyl", "kkk", "zzzzz"], k=n)) for n in (1, 2, 30, 48, 49, 61, 100)]
    got = toxicity.score_texts(model, *tokens.column_bytes(pa.array(texts)))
    for text, score in zip(texts, got, strict=True):
        words, starts = text.split(), [0]
        while starts[-1] + toxicity.WINDOW < len(words):
            starts.append(starts[-1] + toxicity.STRIDE)
        best = max(plain_logit(model, words[s : s + toxicity.WINDOW]) for s in starts)
        a, b = model.scale
        assert abs(score - 1 / (1 + np.exp(-(a * best + b)))) < 1e-4


def test_one_class_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", ""), (2, "c", "")], DOCS)
    model = train_toxicity_model(df, spark.createDataFrame([(1, 0), (2, 0)], LABELS), ~held_out("doc_id", 4, 2))
    assert model is None
    assert {r["score"] for r in score_toxicity(df, model).collect()} == {0.0}
    assert score_toxicity(df.limit(0), model).collect() == []


def test_repeated_rows_do_not_fill_the_sample(spark, monkeypatch):
    """Rows of one id, in either table, are one document to learn from; an id of both labels is toxic."""
    monkeypatch.setattr(toxicity, "PER_CLASS", 3)
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: list(zip(texts, labels, strict=True)))
    docs = spark.createDataFrame([(i, f"text {i}", "") for i in range(8)] + [(0, t, "") for t in ("a", "", None, "b")] * 50, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(i, i % 2) for i in (0, 1)] * 200 + [(2, 1), (None, 1), (3, None), (3, 7)], LABELS)
    got = train_toxicity_model(docs, labels, F.lit(True))
    assert sorted(y for _, y in got) == [0, 0, 0, 1, 1, 1] and len({t for t, _ in got}) == 6
    by_text = dict(got)
    assert by_text["a"] == 0 and "text 0" not in by_text and by_text.get("text 2", 1) == 1


def test_passages_are_whole_in_a_window_at_every_offset():
    longest, n = toxicity.WINDOW - toxicity.STRIDE + 1, 200
    assert longest >= 0.75 * toxicity.WINDOW
    texts = [" ".join(f"bad{k - at}" if at <= k < at + longest else f"w{k}" for k in range(n)) for at in range(n - longest + 1)]
    t = toxicity.read(*tokens.column_bytes(pa.array(texts, pa.large_string())))
    words = tokens.scan(*tokens.column_bytes(pa.array([f"bad{k}" for k in range(longest)])), tokens.PUNCT, lower=True).hashes
    whole = np.isin(np.append(t.hashes, np.uint64(0))[t.windows], words).sum(1) == longest
    assert set(t.doc[whole].tolist()) == set(range(len(texts)))


def test_windows_score_as_in_training():
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["ab", "cde", "fghi", "xyzzy", "q"], k=n)) for n in (1, 3, 47, 48, 49, 60, 200)] + ["", " . "]
    r = lambda *s: np.random.default_rng(len(s)).standard_normal(s).astype(np.float32)
    h, e = toxicity.HIDDEN, toxicity.EMBED
    p = {"word": r(1, e), "gram": r(1 << toxicity.GRAM_BITS, e), "wx": r(2 * e, 6 * h), "bx": r(6 * h), "uf": r(h, 3 * h), "ub": r(h, 3 * h) * 2, "wa": r(2 * h, h), "va": r(h), "wo": r(2 * h), "bo": r(1)}
    model = toxicity.Model(np.zeros(0, np.uint64), p)
    t = toxicity.read(*tokens.column_bytes(pa.array(texts, pa.large_string())))
    x = toxicity._vectors(model, t, np.arange(len(t.hashes)))
    got = toxicity.window_logits(model, t)
    assert len(got) == len(t.windows) and np.abs(got - toxicity._forward(model, x, t.windows)[0]).max() < 1e-4
    # numpy's tanh takes about four times as long as its exp: none may be left where every text is scored
    assert not {"tanh", "_layer", "_forward"} & {*toxicity.window_logits.__code__.co_names, *toxicity._states.__code__.co_names}
