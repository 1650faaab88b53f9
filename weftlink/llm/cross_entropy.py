"""Language-model scoring by cross-entropy difference.

A target and a background model of the same kind (interpolated bigrams, Dirichlet-smoothed) share one
vocabulary, the words of all documents; V counts them and one unknown word.
    p1(w) = (c(w) + 1) / (N + V),   p(w | v) = (c(v, w) + MU p1(w)) / (c(v, .) + MU)
c(v, .) counts the pairs that begin with v, so both sum to 1 over the vocabulary. The target model counts the target
documents, the background model all documents; a document is scored by models of all others, its own counts taken out
of whichever model it is in, so target documents have no advantage and a text that occurs twice stands out.
A document's score is the mean over its words of target loss minus background loss, in nats; lower is closer to
the target. The first word is predicted by p1 alone.

All words and pairs of all documents are in the models, whatever their number, so no model is ever broadcast.
Documents are written as runs. A run asks for its distinct words and pairs, each once, in buckets by their hash, so
a common word or pair is no more work than others. A bucket adds up the counts of its keys and answers every run
in the order asked; answers and runs meet again by run.
Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A document without words has null losses and score. Every row is
a document of its own; rows whose id is a target id are target documents, rows without an id never are. Repeated
target ids count once. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm import tokens
from weftlink.llm.bloom import bloom_filter, maybe
from weftlink.llm.scratch import Scratch, collect_garbage
from weftlink.llm.sessions import give_back, id_and_text, released, rows

MU = 50.0
FLUSH_WORDS = 600_000
BUCKET_BYTES = 10_000_000
#: Two given pairs share a hash with a chance of 2**-56; each bit more is paid for in every shuffled pair.
PAIR_BITS = 56

WORD, PAIR, PLACES, TOTAL, GOAL = range(5)

_ROWS = "bucket int, run long, kind int, target boolean, blob binary"
_FIELDS = [("bucket", pa.int32()), ("run", pa.int64()), ("kind", pa.int32()), ("target", pa.bool_()), ("blob", pa.binary())]
#: Rows are large, so the writer has to look at their size more often than every 100 rows.
_WRITE = {"compression": "zstd", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "10", "parquet.block.size": "33554432"}


def _put(*arrays: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane, compressed."""
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    head = np.array([len(planes), *map(len, arrays)], np.int64).tobytes()
    return head + pa.compress(planes, codec="zstd", asbytes=True)


def _get(blob: bytes, *types: type) -> list[np.ndarray]:
    total, *sizes = np.frombuffer(blob, np.int64, len(types) + 1).tolist()
    planes = np.frombuffer(pa.decompress(blob[8 * (len(types) + 1) :], decompressed_size=total, codec="zstd"), np.uint8)
    out, at = [], 0
    for n, t in zip(sizes, types, strict=True):
        width = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(planes[at : at + n * width].reshape(width, n).T).view(t).reshape(n))
        at += n * width
    return out


def _gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def _begins(n: np.ndarray) -> np.ndarray:
    """Flags of the first words of documents of n words."""
    begin = np.zeros(n.sum() + 1, bool)
    begin[np.cumsum(n) - n] = True
    return begin[:-1]


def _pairs_of(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of PAIR_BITS bits for each pair of neighbouring words, place of its second word)."""
    second = np.flatnonzero(~begin[1:]) + 1
    with np.errstate(over="ignore"):
        return tokens.mix(tokens.mix(hashes[second - 1], 5) * tokens._Q[0] + hashes[second], 9) >> np.uint64(64 - PAIR_BITS), second


def _runs(batches):
    """Runs of documents of about FLUSH_WORDS words: ids, sizes, distinct words and the documents' words as places of these."""
    held, size, turn = [], 0, 0

    def flush():
        ids, valid, n, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
        words, place = np.unique(hashes, return_inverse=True)
        return rows(_FIELDS, [[0], [TaskContext.get().partitionId() << 32 | turn], [PLACES], [False], [_put(ids, valid, n, _gaps(words), place.astype(np.int32))]])

    for batch in batches:
        for a, b, data, off in tokens.slices(batch.column(1)):
            w = tokens.scan(data, off, tokens.SPACE, lower=True)
            ids = batch.column(0).slice(a, b - a)
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), np.diff(w.bounds).astype(np.int64), w.hashes))
            size += len(w.hashes)
            if size >= FLUSH_WORDS:
                yield flush()
                held, size, turn = [], 0, turn + 1
    if held:
        yield flush()


def _open(blob: bytes) -> tuple[np.ndarray, ...]:
    """(ids, which are not null, words of each document, sorted distinct words, places) of a run."""
    ids, valid, n, gaps, place = _get(blob, np.int64, np.bool_, np.int64, np.uint64, np.int32)
    return ids, valid, n, np.cumsum(gaps, dtype=np.uint64), place


def _ask(buckets: int, target: bool):
    """Distinct words and pairs of runs with their counts, by bucket."""
    edges = np.array([-(-(b << 64) // buckets) for b in range(buckets)], np.uint64)

    def run(batches):
        for batch in batches:
            for number, blob in zip(batch.column(1).to_pylist(), batch.column(4), strict=True):
                _, _, n, words, place = _open(blob.as_py())
                pairs, pair_times = np.unique(_pairs_of(words[place], _begins(n))[0], return_counts=True)
                last = np.bincount(place[np.cumsum(n)[n > 0] - 1], minlength=len(words))
                out = []
                for kind, keys, *count in ((WORD, words, np.bincount(place, minlength=len(words)), last), (PAIR, pairs, pair_times)):
                    cut = np.append(np.searchsorted(keys, edges if kind == WORD else edges >> np.uint64(64 - PAIR_BITS)), len(keys))
                    for b in np.flatnonzero(np.diff(cut)).tolist():
                        own = slice(cut[b], cut[b + 1])
                        out.append((b, number, kind, target, _put(_gaps(keys[own]), *[c[own].astype(np.int64) for c in count])))
                for k in range(0, len(out), 500):
                    yield rows(_FIELDS, list(zip(*out[k : k + 500], strict=True)))

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Of one bucket: to every asked list of keys the background's and the target's counts in the same order, and totals."""
    bucket, kinds, targets = table.column("bucket")[0].as_py(), table.column("kind").to_numpy(), table.column("target").to_numpy()
    runs, blobs = table.column("run").to_numpy(), table.column("blob")
    out = []
    for kind, fields in ((WORD, 2), (PAIR, 1)):
        at = np.flatnonzero(kinds == kind)
        if not len(at):
            continue
        got = [_get(blobs[int(k)].as_py(), np.uint64, *[np.int64] * fields) for k in at]
        cut = np.concatenate([[0], np.cumsum([len(g[0]) for g in got])])
        keys, of = np.unique(np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got]), return_inverse=True)
        side, sums = np.repeat(targets[at], np.diff(cut)), []
        for f in range(fields):
            count = np.concatenate([g[1 + f] for g in got])
            sums += [np.bincount(of, weights=np.where(s, count, 0), minlength=len(keys)).astype(np.int64) for s in (~side, side)]
        del got, count
        for i, k in enumerate(at.tolist()):
            if not targets[k]:
                own = of[cut[i] : cut[i + 1]]
                out.append((bucket, int(runs[k]), kind, False, _put(*[x[own] for x in sums])))
        if kind == WORD:
            out.append((bucket, -1, TOTAL, False, _put(np.array([len(keys), sums[0].sum(), sums[1].sum()], np.int64))))
        del keys, of, side, sums
    answer = pa.Table.from_batches([rows(_FIELDS, list(zip(*out, strict=True)))])
    del out
    give_back()
    return answer


_OUT = [("doc", pa.int64()), ("n_words", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())]


def _own(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each key stands in its document."""
    _, of, n = np.unique(doc * (int(key.max(initial=0)) + 1) + key, return_inverse=True, return_counts=True)
    return n[of]


def _score(vocabulary: int, totals: tuple[int, int]):
    """Losses of one run's documents from the answers."""

    def run(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_numpy(), table.column("blob")
        order = np.argsort(table.column("bucket").to_numpy(), kind="stable")

        def counts(kind, fields):
            got = [_get(blobs[int(k)].as_py(), *[np.int64] * fields) for k in order[kinds[order] == kind]]
            return [np.concatenate(x) for x in zip(*got, strict=True)] if got else [np.zeros(0, np.int64)] * fields

        ids, valid, n, distinct, place = _open(blobs[int(np.flatnonzero(kinds == PLACES)[0])].as_py())
        goal = np.zeros(len(n), bool)
        goal[[int(np.frombuffer(blobs[int(k)].as_py(), np.int32)[0]) for k in np.flatnonzero(kinds == GOAL)]] = True
        begin, ends = _begins(n), np.cumsum(n)
        pair, second = _pairs_of(distinct[place], begin)
        of = np.unique(pair, return_inverse=True)[1]
        del pair
        words, pairs, mean = counts(WORD, 4), counts(PAIR, 2), []
        doc = np.repeat(np.arange(len(n)), n)
        own, before = _own(doc, place), np.concatenate([place[:1], place[:-1]])
        own_before = np.concatenate([own[:1], own[:-1]]) - (before == place[(ends - 1)[doc]])
        own_pair = _own(doc[second], of)
        for side in (1, 0):
            less = goal[doc] if side else np.ones(len(doc), bool)
            p1 = (words[side][place] - less * own + 1) / (totals[side] - less * n[doc] + vocabulary)
            both = np.zeros(len(place), np.int64)
            both[second] = pairs[side][of] - less[second] * own_pair
            follow = (words[side] - words[2 + side])[before] - less * own_before
            p = np.where(begin, p1, (both + MU * p1) / (np.where(begin, 0, follow) + MU))
            sums = np.concatenate([[0.0], np.cumsum(-np.log(p))])
            s = sums[ends] - sums[ends - n]
            mean.append(np.divide(s, n, out=np.full(len(n), np.nan), where=n > 0))
            del p1, both, follow, p, sums
        t, g = (pa.array(np.round(x, 6), from_pandas=True) for x in mean)
        out = rows(_OUT, [pa.array(ids, mask=~valid), n, t, g, pa.array(np.round(mean[0] - mean[1], 6), from_pandas=True)])
        del words, pairs, doc, own, before, own_before, own_pair, of, place
        give_back()
        return pa.Table.from_batches([out])

    return run


def _likely(bits, ids: pa.Array) -> np.ndarray:
    return maybe(bits.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)


def target_documents(docs: DataFrame, wanted: DataFrame, bits) -> DataFrame:
    """Rows of (_id, _text) whose id is in the one-column wanted; its Bloom filter spares the exact join most other rows."""

    def likely(batches):
        for b in batches:
            yield b.filter(pa.array(_likely(bits, b.column(0))))

    return docs.mapInArrow(likely, "_id long, _text string").join(wanted.toDF("_id"), "_id", "left_semi")


def _target_places(runs: DataFrame, wanted: DataFrame, bits) -> DataFrame:
    """Which documents of each run are target documents."""

    def likely(batches):
        for batch in batches:
            for number, blob in zip(batch.column(1).to_pylist(), batch.column(4), strict=True):
                ids, valid, *_ = _open(blob.as_py())
                at = np.flatnonzero(_likely(bits, pa.array(ids, mask=~valid)))
                m = len(at)
                own = rows(_FIELDS, [np.zeros(m, np.int32), np.full(m, number), np.full(m, GOAL), np.zeros(m, bool), [np.int32(i).tobytes() for i in at.tolist()]])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(ids[at])], [*own.schema.names, "_id"])

    return runs.mapInArrow(likely, _ROWS + ", _id long").join(wanted.toDF("_id"), "_id", "left_semi").drop("_id")


def score_documents(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """target_ids: one column of ids of target documents; the background is all of docs. Returns id, n_words, both losses and score."""
    spark = docs.sparkSession
    plain = id_and_text(docs, id_col, text_col)
    size = plain.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = int(max(24, -(-size // BUCKET_BYTES)))
    wanted = target_ids.toDF("_id").select(F.col("_id").cast("long").alias("_id")).where("_id is not null").distinct()
    bits = spark.sparkContext.broadcast(bloom_filter(wanted))
    scratch = Scratch(spark, "cross-entropy")
    runs = scratch.save(plain.mapInArrow(released(_runs), _ROWS), "runs", **_WRITE)
    goal = target_documents(plain, wanted, bits).mapInArrow(_runs, _ROWS)
    asked = runs.mapInArrow(released(_ask(buckets, False)), _ROWS).unionByName(goal.mapInArrow(released(_ask(buckets, True)), _ROWS))
    answers = scratch.save(asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answer, _ROWS), "answers", **_WRITE)
    totals = np.zeros(3, np.int64)
    for r in answers.where(F.col("kind") == TOTAL).select("blob").toLocalIterator():
        totals += _get(bytes(r["blob"]), np.int64)[0]
    del asked, goal
    collect_garbage(spark)  # what was asked need not be kept any longer
    score = _score(int(totals[0]) + 1, (int(totals[1]), int(totals[2])))
    parts = runs.unionByName(answers.where(F.col("kind").isin(WORD, PAIR))).unionByName(_target_places(runs, wanted, bits))
    scored = parts.repartition(buckets, "run").groupBy("run").applyInArrow(score, "doc long, n_words long, target_loss double, background_loss double, score double")
    return scored.withColumnRenamed("doc", id_col)
