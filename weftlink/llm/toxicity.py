"""Toxicity scoring by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Input of a word: an embedding of the word (words of at least MIN_DOCS training documents; one for the rest) and
the mean embedding of its hashed byte 3- and 5-grams with word marks. Two gated recurrent layers, one from
either end, run over windows of WINDOW words that start every STRIDE words; so any passage of up to WINDOW - STRIDE + 1
words is whole in one of them, wherever it starts; attention pools each
window. A document's score is its highest window's, put on a probability scale by a logistic fit on the
training documents.

Learning takes at most PER_CLASS labelled documents of each class, whole texts, those with the smallest hashes.
Labels are those of documents, so windows of toxic documents are chosen in rounds: first by log odds of their
words and grams, then by the network's own scores.
Null, empty and wordless texts score 0. Where only one class was labelled, every score is 0.
A score depends on the row's own text and the model alone: rows without an id, of one id, or equal are scored each, and
other columns are ignored. Labels without an id, or other than 0 and 1, teach nothing; repeated ones count once, and an
id labelled both 0 and 1 is toxic. Of rows that share a chosen id the smallest text that isn't empty is learned from.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm import tokens
from weftlink.llm.sessions import id_and_text, rows

PER_CLASS = 1200
WINDOW, STRIDE = 48, 12
HIDDEN, EMBED = 8, 12
MIN_DOCS = 4
GRAM_BITS = 15
BLOCK = 2048
EPOCHS = (6, 6)
THRESHOLD = 0.3

f32 = np.float32


@dataclass
class Model:
    vocab: np.ndarray  # sorted word hashes; row 0 of the table is for other words
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _scatter(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of values by row."""
    out, o = np.zeros((size, values.shape[1]), f32), np.argsort(rows, kind="stable")
    if len(o):
        at = np.flatnonzero(np.concatenate([[True], np.diff(rows[o]) != 0]))
        out[rows[o][at]] = np.add.reduceat(values[o], at, axis=0)
    return out


@dataclass
class Text:
    """Windows over distinct words: grams[gcut[u]:gcut[u+1]] are the gram buckets of distinct word u; windows hold places of distinct words, -1 for none."""

    hashes: np.ndarray
    grams: np.ndarray
    gcut: np.ndarray
    windows: np.ndarray
    doc: np.ndarray
    docs: int


def read(data: np.ndarray, offsets: np.ndarray) -> Text:
    w = tokens.scan(data, offsets, tokens.PUNCT, lower=True)
    hashes, first, of = np.unique(w.hashes, return_index=True, return_inverse=True)
    start, size = w.starts[first], (w.ends - w.starts)[first]
    # distinct words side by side, each between marks
    cut = np.concatenate([[0], np.cumsum(size + 2)])
    flat = np.full(cut[-1], 94, np.uint64)
    at = np.arange(size.sum()) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(size) else np.zeros(0, np.int64)
    flat[np.repeat(cut[:-1] + 1, size) + at] = tokens._LOWER[data[np.repeat(start, size) + at]]
    if len(size):
        flat[cut[1:] - 1] = 36
    word = np.repeat(np.arange(len(size)), size + 2)
    left = cut[1:][word] - np.arange(len(flat))
    buckets, owner = [], []
    for n in (3, 5):
        if len(flat) >= n:
            code = np.zeros(len(flat) - n + 1, np.uint64)
            for j in range(n):
                code = (code << np.uint64(8)) | flat[j : len(flat) - n + 1 + j]
            keep = left[: len(code)] >= n
            buckets.append((tokens.mix(code[keep], n) >> np.uint64(64 - GRAM_BITS)).astype(np.int32))
            owner.append(word[: len(code)][keep])
    grams, owner = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (buckets, owner))
    o = np.argsort(owner, kind="stable")
    gcut = np.searchsorted(owner[o], np.arange(len(size) + 1))
    n = np.diff(w.bounds)
    count = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    begin = w.bounds[:-1][doc] + number * STRIDE
    place = begin[:, None] + np.arange(WINDOW)
    windows = np.where(place < w.bounds[1:][doc][:, None], of[np.minimum(place, max(0, len(of) - 1))] if len(of) else 0, -1)
    return Text(hashes, grams[o], gcut, windows.astype(np.int32), doc, len(n))


def _word_rows(model: Model, hashes: np.ndarray) -> np.ndarray:
    if not len(model.vocab):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(model.vocab, hashes), len(model.vocab) - 1)
    return np.where(model.vocab[at] == hashes, at + 1, 0)


def _vectors(model: Model, t: Text, words: np.ndarray) -> np.ndarray:
    """Inputs of the given distinct words."""
    p, n = model.p, np.diff(t.gcut)[words]
    take = np.repeat(t.gcut[words] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    sums = np.zeros((len(words), EMBED), f32)
    some = np.flatnonzero(n)
    if len(some):
        sums[some] = np.add.reduceat(p["gram"][t.grams[take]], np.concatenate([[0], np.cumsum(n[some])[:-1]]), axis=0)
    return np.concatenate([p["word"][_word_rows(model, t.hashes[words])], sums / np.maximum(1, n)[:, None].astype(f32)], 1)


def _layer(gates: np.ndarray, idx: np.ndarray, u: np.ndarray, back: bool, keep: bool):
    """One gated recurrent pass; gates: input parts of distinct words and a last row for padding."""
    n, h = len(idx), np.zeros((len(idx), HIDDEN), f32)
    out, cache = np.zeros((WINDOW, n, HIDDEN), f32), []
    for t in range(WINDOW)[::-1] if back else range(WINDOW):
        g, hu = gates[idx[:, t]], h @ u
        zr = _sigmoid(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        m = (idx[:, t] >= 0).astype(f32)[:, None]
        if keep:
            cache.append((t, h, z, r, c, hu[:, 2 * HIDDEN :], m))
        h = h + m * (1 - z) * (c - h)
        out[t] = h
    return out, cache


def _forward(model: Model, x: np.ndarray, idx: np.ndarray, keep: bool = False):
    p = model.p
    gates = np.concatenate([x @ p["wx"] + p["bx"], np.zeros((1, 6 * HIDDEN), f32)])
    a, ca = _layer(np.ascontiguousarray(gates[:, : 3 * HIDDEN]), idx, p["uf"], False, keep)
    b, cb = _layer(np.ascontiguousarray(gates[:, 3 * HIDDEN :]), idx, p["ub"], True, keep)
    h = np.concatenate([a, b], 2)
    k = np.tanh(h @ p["wa"])
    e = (k @ p["va"]) - 1e4 * (idx.T < 0)
    e = np.exp(e - e.max(0))
    att = e / e.sum(0)
    pooled = (att[:, :, None] * h).sum(0)
    return pooled @ p["wo"] + p["bo"][0], (ca, cb, h, k, att, pooled)


def _backward(model: Model, x: np.ndarray, idx: np.ndarray, dlogit: np.ndarray, cache) -> dict[str, np.ndarray]:
    p, (ca, cb, h, k, att, pooled) = model.p, cache
    g = {"wo": pooled.T @ dlogit, "bo": np.array([dlogit.sum()], f32)}
    dpool = dlogit[:, None] * p["wo"]
    datt = (dpool * h).sum(2)
    de = att * (datt - (att * datt).sum(0))
    dk = de[:, :, None] * p["va"] * (1 - k * k)
    g["va"] = (de[:, :, None] * k).sum((0, 1))
    g["wa"] = h.reshape(-1, 2 * HIDDEN).T @ dk.reshape(-1, dk.shape[2])
    dh = att[:, :, None] * dpool + dk @ p["wa"].T
    sides = []
    for name, steps, side in (("uf", ca, 0), ("ub", cb, 1)):
        parts = np.zeros((WINDOW, len(idx), 3 * HIDDEN), f32)
        u, du, up = p[name], np.zeros_like(p[name]), np.zeros((len(idx), HIDDEN), f32)
        for t, h0, z, r, c, hn, m in reversed(steps):
            d = up + dh[t][:, side * HIDDEN : (side + 1) * HIDDEN]
            dn = d * m * (1 - z) * (1 - c * c)
            dz = -d * m * (c - h0) * z * (1 - z)
            dr = dn * hn * r * (1 - r)
            dhu = np.concatenate([dz, dr, dn * r], 1)
            du += h0.T @ dhu
            up = d * (1 - m * (1 - z)) + dhu @ u.T
            parts[t] = np.concatenate([dz, dr, dn], 1)
        g[name] = du
        sides.append(parts)
    flat = np.where(idx.T < 0, len(x), idx.T).ravel()
    dgates = _scatter(flat, np.concatenate(sides, 2).reshape(len(flat), -1), len(x) + 1)[:-1]
    g["wx"], g["bx"] = x.T @ dgates, dgates.sum(0)
    g["x"] = dgates @ p["wx"].T
    return g


def _squashed(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place; _sigmoid of -x. numpy's exp takes a fraction of its tanh's time."""
    np.exp(x, out=x)
    x += f32(1)
    return np.reciprocal(x, out=x)


def _states(gates: np.ndarray, idx: np.ndarray, u: np.ndarray, back: bool, out: np.ndarray) -> None:
    """The states of _layer, a row for each hidden unit. gates and u are scaled as _squashed takes them; gates' last row, for padding, keeps a state as it is."""
    n, h, ut = 2 * HIDDEN, np.zeros((HIDDEN, idx.shape[1]), f32), np.ascontiguousarray(u.T)
    for t in range(WINDOW)[::-1] if back else range(WINDOW):
        g, hu = gates.take(idx[t], axis=0).T, ut @ h
        zr, c = hu[:n], hu[n:]
        zr += g[:n]
        _squashed(zr)
        c *= zr[HIDDEN:]
        c += g[n:]
        _squashed(c)
        c *= f32(2)
        c -= f32(1)
        c -= h
        c *= f32(1) - zr[:HIDDEN]
        h = np.add(h, c, out=out[t])


def window_logits(model: Model, t: Text) -> np.ndarray:
    """_forward of all windows with a row for each unit instead of each window, so that each step works on whole rows."""
    out = np.zeros(len(t.windows), f32)
    if not len(out):
        return out
    p, x, unit = model.p, _vectors(model, t, np.arange(len(t.hashes))), np.arange(3 * HIDDEN)
    scale = np.where(unit < 2 * HIDDEN, -1, -2).astype(f32)  # tanh(x) = 2 * _sigmoid(2 * x) - 1
    pad = np.where(unit < HIDDEN, -1e4, 0).astype(f32)
    gates = (x @ p["wx"] + p["bx"]) * np.tile(scale, 2)
    sides = [(np.concatenate([part, pad[None]]), p[u] * scale, u == "ub") for part, u in zip(np.split(gates, 2, axis=1), ("uf", "ub"), strict=True)]
    wa, wo = np.split(-2 * p["wa"].T, 2, axis=1), np.split(p["wo"], 2)
    h = np.empty((2, WINDOW, HIDDEN, min(BLOCK, len(out))), f32)
    with np.errstate(over="ignore"):  # exp of much is inf, and 1 / inf 0
        for i in range(0, len(out), BLOCK):
            idx = np.ascontiguousarray(t.windows[i : i + BLOCK].T)
            both = h[..., : idx.shape[1]]
            for side, states in zip(sides, both, strict=True):
                _states(side[0], idx, *side[1:], states)
            e = np.stack([p["va"] @ (2 * _squashed(wa[0] @ a + wa[1] @ b) - 1) for a, b in zip(*both, strict=True)]) - f32(1e4) * (idx < 0)
            e = np.exp(e - e.max(0))
            e /= e.sum(0)
            pooled = np.zeros(both[:, 0].shape, f32)
            for att, states in zip(e, both.swapaxes(0, 1), strict=True):
                pooled += att * states
            out[i : i + BLOCK] = wo[0] @ pooled[0] + wo[1] @ pooled[1] + p["bo"][0]
    return out


def _document_max(values: np.ndarray, t: Text) -> np.ndarray:
    best = np.full(t.docs, -np.inf)
    np.maximum.at(best, t.doc, values)
    return best


def _pairs(t: Text) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, distinct word)."""
    flat = t.windows.ravel() >= 0
    key = np.unique(np.repeat(t.doc, WINDOW)[flat].astype(np.int64) * max(1, len(t.hashes)) + t.windows.ravel()[flat])
    return key // max(1, len(t.hashes)), key % max(1, len(t.hashes))


def _log_odds(t: Text, y: np.ndarray) -> np.ndarray:
    """Of each window: the largest smoothed log odds of a distinct word or of its grams."""
    pairs = _pairs(t)
    pos, neg = max(1, (y == 1).sum()), max(1, (y == 0).sum())

    def odds(counts):
        neg_n, pos_n = counts
        return np.where(pos_n + neg_n >= 5, np.log((pos_n + 0.5) / pos) - np.log((neg_n + 0.5) / neg), 0)

    words, grams = np.zeros((2, len(t.hashes))), np.zeros((2, 1 << GRAM_BITS))
    cut = np.searchsorted(pairs[0], np.arange(t.docs + 1))
    for d in range(t.docs):
        own = pairs[1][cut[d] : cut[d + 1]]
        words[y[d], own] += 1
        n = np.diff(t.gcut)[own]
        take = np.repeat(t.gcut[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        grams[y[d], np.unique(t.grams[take])] += 1
    word, gram = odds(words), odds(grams)
    best = np.full(len(t.hashes), -9.0)
    np.maximum.at(best, np.repeat(np.arange(len(t.hashes)), np.diff(t.gcut)), gram[t.grams])
    best = np.append(np.maximum(best, word), -9.0)
    top = np.sort(best[t.windows], axis=1)[:, -3:]
    return top.sum(1)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model | None:
    y, rng = np.array(labels), np.random.default_rng(seed)
    if len(set(labels)) < 2:
        return None
    t = read(*tokens.column_bytes(pa.array(texts, pa.large_string())))
    seen = _pairs(t)[1]
    vocab = np.sort(t.hashes[np.bincount(seen, minlength=len(t.hashes)) >= MIN_DOCS])
    r = lambda *s, k=0.1: (rng.standard_normal(s) * k).astype(f32)
    p = {"word": r(len(vocab) + 1, EMBED), "gram": r(1 << GRAM_BITS, EMBED, k=0.3), "wx": r(2 * EMBED, 6 * HIDDEN, k=0.3), "bx": np.zeros(6 * HIDDEN, f32), "uf": r(HIDDEN, 3 * HIDDEN, k=0.25), "ub": r(HIDDEN, 3 * HIDDEN, k=0.25), "wa": r(2 * HIDDEN, HIDDEN, k=0.3), "va": r(HIDDEN, k=0.5), "wo": r(2 * HIDDEN, k=0.3), "bo": np.zeros(1, f32)}
    model, m1, m2, step = Model(vocab, p), {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    toxic = y[t.doc] == 1
    for turn, epochs in enumerate(EPOCHS):
        score = _log_odds(t, y) if turn == 0 else window_logits(model, t)
        o = np.lexsort((-score, t.doc))
        place = np.arange(len(o)) - np.searchsorted(t.doc[o], t.doc[o])
        rank = np.empty(len(o), np.int64)
        rank[o] = place
        for _ in range(epochs):
            draw = rng.random(len(o))
            pick = np.flatnonzero(np.where(toxic, rank < 1, (rank < 2) | (draw < 0.12)))
            rng.shuffle(pick)
            for s in range(0, len(pick), 256):
                w = pick[s : s + 256]
                words, idx = np.unique(t.windows[w], return_inverse=True)
                idx = idx.reshape(len(w), WINDOW)
                if words[0] < 0:
                    words, idx = words[1:], idx - 1
                x = _vectors(model, t, words)
                drop = (rng.random(len(words)) > 0.05).astype(f32)[:, None]
                logit, cache = _forward(model, x * drop, idx, True)
                target = toxic[w].astype(f32)
                weight = np.where(target > 0, 2.0, 1.0).astype(f32)
                g = _backward(model, x * drop, idx, (weight * (_sigmoid(logit) - target) / len(w)).astype(f32), cache)
                gx = g.pop("x") * drop
                g["word"] = _scatter(_word_rows(model, t.hashes[words]), gx[:, :EMBED], len(p["word"]))
                n = np.diff(t.gcut)[words]
                take = np.repeat(t.gcut[words] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                g["gram"] = _scatter(t.grams[take], np.repeat(gx[:, EMBED:] / np.maximum(1, n)[:, None], n, axis=0), len(p["gram"]))
                step += 1
                for k, v in g.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.99 * m2[k] + 0.01 * v * v
                    p[k] -= (0.01 * (m1[k] / (1 - 0.9**step) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6) + (0.02 * p[k] if k in ("word", "gram") else 0))).astype(f32)
    best = _document_max(window_logits(model, t), t)
    have = np.isfinite(best)
    model.scale = _logistic(best[have], y[have])
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic fit, lightly held to slope 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        q = _sigmoid(a * x + b)
        d, h = np.array([((q - y) * x).sum() + (a - 1), (q - y).sum() + 0.1 * b]), q * (1 - q)
        m = np.array([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum() + 0.1]])
        s = np.linalg.solve(m, d)
        a, b = a - s[0], b - s[1]
        if np.abs(s).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def score_texts(model: Model | None, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if model is None:
        return np.zeros(len(offsets) - 1)
    t = read(data, offsets)
    best = _document_max(window_logits(model, t), t)
    return np.where(np.isfinite(best), _sigmoid(model.scale[0] * best + model.scale[1]), 0.0)


def train_toxicity_model(docs: DataFrame, labels: DataFrame, trainable, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """trainable: a condition on labels' id column. The chosen ids are at most 2 * PER_CLASS, so they go to every task."""
    spark = docs.sparkSession
    named = labels.where(trainable).select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
    ids = {}
    for y in (0, 1):
        for r in named.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(PER_CLASS).collect():
            ids[r["_id"]] = y
    wanted = spark.sparkContext.broadcast(np.array(sorted(ids), np.int64))

    def chosen(batches):
        for b in batches:
            yield b.filter(pa.array(np.isin(b.column(0).fill_null(-1).to_numpy(zero_copy_only=False), wanted.value) & b.column(0).is_valid().to_numpy(zero_copy_only=False)))

    got = id_and_text(docs, id_col, text_col).mapInArrow(chosen, "_id long, _text string").where("_text <> ''").groupBy("_id").agg(F.min("_text").alias("_text"))
    got = sorted((r["_id"], r["_text"]) for r in got.collect())
    return train([t for _, t in got], [ids[i] for i, _ in got])


_OUT = [("doc", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())]


def score_toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for a, b, data, off in tokens.slices(batch.column(1)):
                s = score_texts(held.value, data, off)
                yield rows(_OUT, [batch.column(0).slice(a, b - a), s, (s >= THRESHOLD).astype(np.int32)])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc long, score double, predicted int").withColumnRenamed("doc", id_col)
