"""Language identification with a string kernel.

Kernel: blended-spectrum presence kernel, k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), where G is the set of
1- to 4-grams of lower-cased characters that occur in a landmark: all of them, as no other has a part in a product
with a landmark. Grams are told apart by 64-bit hashes.
Model: Nyström features from `LANDMARKS` training documents and one-versus-rest kernel ridge regression.
Scoring: presence rows of a batch of documents, times landmarks and coefficients, which are one matrix.

Learning reads at most PER_CLASS documents of each language (those with the smallest hashes, whole texts), which
bounds the model by the landmarks' texts. Texts without a letter and null texts are `und` with score 0; so is everything where
nothing could be learned. A text without any known gram gets the best bias. Every text is read whole.
A prediction depends on the row's own text alone, so equal texts get equal results whatever their id; of languages with
equal scores the first in alphabetical order is taken. Rows that repeat an id are predicted each; null ids stay null and
are never held out. Other columns are ignored, or kept by keep_identified.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.sessions import give_back, id_and_text, released, rows
from weftlink.llm.tokens import mix

PER_CLASS = 300
LANDMARKS = 128
ORDERS = 4
SLOT_BITS = 20
BATCH_CHARS = 150_000
BATCH_CELLS = 2_000_000
RIDGE = 1e-2
UNKNOWN = "und"

_WORDLIKE = re.compile(r"[^\W\d_]")


class Grams:
    """Columns of grams. A slot, the low bits of a hash, leads to the first column there; other columns of a slot are looked up among all."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        slot = (self.hashes & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
        self.slots, self.shared = np.full(1 << SLOT_BITS, -1, np.int32), np.zeros(1 << SLOT_BITS, bool)
        self.slots[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        self.shared[slot[self.slots[slot] != np.arange(len(slot))]] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def columns(self, h: np.ndarray) -> np.ndarray:
        """The column of each hash, len(self) where it has none."""
        if not len(self):
            return np.zeros(len(h), np.int64)
        slot = (h & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
        col = self.slots[slot].astype(np.int64)
        col[(col < 0) | (self.hashes[col] != h)] = len(self)
        more = np.flatnonzero((col == len(self)) & self.shared[slot])
        at = np.minimum(np.searchsorted(self.hashes, h[more]), len(self) - 1)
        col[more] = np.where(self.hashes[at] == h[more], at, len(self))
        return col


@dataclass
class Model:
    labels: list[str]
    grams: Grams
    weights: np.ndarray  # grams x labels: landmarks times Nyström map times ridge coefficients
    bias: np.ndarray

    @property
    def batch_rows(self) -> int:
        return batch_rows(self.grams)


def batch_rows(grams: Grams) -> int:
    return max(1, min(64, BATCH_CELLS // max(1, len(grams))))


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text or ""))


def _gram_hashes(texts: list[str]):
    """For each order: (hash of the gram at each character, document of each character, whether the gram lies in one document)."""
    low = [t.lower() for t in texts]  # each by itself: the lower case of a letter may depend on its neighbours
    chars = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) for t in low])
    doc = np.repeat(np.arange(len(texts)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(chars))
    total = np.zeros(len(chars), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(ORDERS):
            total = mix(total ^ np.concatenate([chars[j:], np.zeros(min(j, len(chars)), np.uint32)]).astype(np.uint64), 60 + j)
            yield total, doc, left > j


def presence(texts: list[str], grams: Grams) -> np.ndarray:
    """0/1 rows over the grams."""
    columns = len(grams)
    out = np.zeros((len(texts), columns + 1), np.float32)
    flat = out.ravel()
    for h, doc, inside in _gram_hashes(texts):
        col = grams.columns(h)
        col[~inside] = columns
        flat[doc * (columns + 1) + col] = 1
    return out[:, :columns]


def learn(texts: list[str], labels: list[str]) -> Model | None:
    names = sorted(set(labels))
    if not names:
        return None
    y = np.array([names.index(v) for v in labels])
    turn = np.zeros(len(y), int)  # landmarks go round the languages
    for c in range(len(names)):
        turn[y == c] = np.arange((y == c).sum())
    marks = np.lexsort((y, turn))[:LANDMARKS]
    grams = Grams(np.concatenate([np.zeros(0, np.uint64), *(np.unique(h[inside]) for m in marks for h, _, inside in _gram_hashes([texts[m]]))]))

    def unit(some: list[str]) -> np.ndarray:
        rows_ = presence(some, grams)
        return rows_ / np.maximum(1, np.sqrt(rows_.sum(1, keepdims=True)))

    land, step = unit([texts[m] for m in marks]), batch_rows(grams)
    products = np.concatenate([unit(texts[i : i + step]) @ land.T for i in range(0, len(texts), step)])
    values, vectors = np.linalg.eigh((land @ land.T).astype(np.float64))
    keep = values > 1e-6 * max(values.max(), 1e-12)
    half = vectors[:, keep] / np.sqrt(values[keep])
    phi = products.astype(np.float64) @ half
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = 1 / np.bincount(y, minlength=len(names))[y]  # languages count alike
    weight /= weight.mean()
    mean, aim = np.average(phi, axis=0, weights=weight), np.average(target, axis=0, weights=weight)
    x = (phi - mean) * np.sqrt(weight)[:, None]
    coef = np.linalg.solve(x.T @ x + RIDGE * len(y) * np.eye(x.shape[1]), x.T @ ((target - aim) * np.sqrt(weight)[:, None]))
    return Model(names, grams, land.T @ (half @ coef).astype(np.float32), aim - mean @ coef)


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    labels, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
    at = 0
    while at < len(known):
        to, size = at, 0
        while to < len(known) and to - at < model.batch_rows and (size == 0 or size + len(texts[known[to]]) <= BATCH_CHARS):
            size += len(texts[known[to]])
            to += 1
        rows_ = presence([texts[i] for i in known[at:to]], model.grams)
        norm = np.maximum(1, np.sqrt(rows_.sum(1, keepdims=True)))
        f = rows_ @ model.weights / norm + model.bias
        best = f.argmax(1)
        for i, b, v in zip(known[at:to], best, f.max(1), strict=True):
            labels[i], score[i] = model.labels[b], min(1.0, max(0.0, (v + 1) / 2))
        at = to
    return labels, score


def train_language_model(docs: DataFrame, id_col: str, text_col: str, lang_col: str, trainable) -> Model | None:
    """trainable: a condition on docs. Null languages and null texts teach nothing."""
    plain = docs.where(trainable).select(F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"), F.col(id_col).cast("long").alias("_id")).where("_text is not null and _lang is not null")
    counts = {r["_lang"]: r["count"] for r in plain.groupBy("_lang").count().collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("_lang") == name, F.lit(min(1.0, 1.5 * PER_CLASS / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("_id", "_text"), F.lit(1 << 30))
    got = plain.withColumn("_draw", draw).where(F.col("_draw") < share * (1 << 30)).orderBy("_draw", "_id").limit(int(1.6 * PER_CLASS * len(counts) + 100)).collect()
    taken, texts, labels = dict.fromkeys(counts, 0), [], []
    for r in got:
        if taken[r["_lang"]] < PER_CLASS and has_letter(r["_text"]):
            taken[r["_lang"]] += 1
            texts.append(r["_text"])
            labels.append(r["_lang"])
    model = learn(texts, labels)
    give_back()
    return model


_OUT = [("doc", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())]


def identify_languages(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            labels, score = predict(held.value, batch.column(1).to_pylist())
            yield rows(_OUT, [batch.column(0), labels, score])

    return id_and_text(docs, id_col, text_col).mapInArrow(released(run), "doc long, lang_pred string, score double").withColumnRenamed("doc", id_col)


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs without the rows identified as `und`; without a model only rows that have no letter go."""
    held, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            keep = [v != UNKNOWN for v in predict(held.value, texts)[0]] if held.value else [has_letter(t) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)


def held_out(id_col: str, modulus: int, remainder: int):
    """crc32 of the id's text, mod modulus, is the remainder; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
