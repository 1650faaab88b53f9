"""Training-order materialisation of token ids into fixed-stride shards.

1. Rows are range partitioned and sorted by id and a hash of the row. Texts become token ids, each text an end mark,
   cut into sequences of `length` ids; a written table keeps the range and the position at which each sequence was
   made, so later reads agree whatever is lost.
2. Counts of the ranges give every sequence its number 0..N-1; a keyed Feistel network over the smallest even
   power of two not under N, walked until it falls below N, permutes numbers into slots.
3. Slots are dealt by shard: one group holds the slots of one shard, and writes them at slot * stride.

Shards are rows: (shard, first_slot, n_slots, stride, sha256, doc_ids, seqs, lengths, payload); payload is
little-endian unsigned 16-bit ids, padded with the end mark. The permutation spreads any hot source evenly.
Null and empty texts give no sequence. Every row is encoded, whether it repeats another, shares its id or has none (its
doc_ids entry is null). Sequences are numbered by id (none first), then row hash, then place in the text, so the same
rows and key give the same shards, however the rows lie in files. Equal rows may part between ranges: they are alike.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.scratch import Scratch
from weftlink.llm.sessions import id_and_text, row_key, rows
from weftlink.llm.tokens import mix

LENGTH = 512
SHARD_SLOTS = 4096
ROUNDS = 6


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of range(n) chosen by key, at x."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> np.uint64(half), v & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (mix(right ^ np.uint64(key & (2**64 - 1)), 1000 + r) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


_ENCODERS: dict = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)
    return _ENCODERS[path]


# where the pattern ends so, it looks ahead only for a run of white space before a word, which leaves its last one to the word
_AHEAD = r"|\s+(?!\S)|\s+"
_RUN_OF_SPACE = r"[\t-\r\x{85}\p{Z}]{2}"


def _encoder_without_runs(path: str):
    """The encoder for texts in which no two white spaces meet: the same ids without looking ahead, which is slow."""
    key = path, "without runs"
    if key not in _ENCODERS:
        import tiktoken

        encoder, _ = _encoder(path)
        pattern = encoder._pat_str
        if pattern.endswith(_AHEAD):
            encoder = tiktoken.Encoding("byte-bpe", pat_str=pattern.removesuffix(_AHEAD) + r"|\s+", mergeable_ranks=encoder._mergeable_ranks, special_tokens={})
        _ENCODERS[key] = encoder
    return _ENCODERS[key]


def _encoded(path: str, texts: pa.Array) -> Iterator[bytes]:
    """The ids of each text and the end mark, as little-endian unsigned 16-bit integers; nothing for null and empty texts."""
    (encoder, end), plain = _encoder(path), _encoder_without_runs(path)
    for text, runs in zip(texts, pc.match_substring_regex(texts, _RUN_OF_SPACE).to_pylist(), strict=True):
        text = text.as_py()
        if not text:
            yield b""
            continue
        ids = array("H", (encoder if runs else plain).encode_ordinary(text))
        ids.append(end)
        if sys.byteorder == "big":
            ids.byteswap()
        yield ids.tobytes()


_SEQS = [("part", pa.int32()), ("pos", pa.int64()), ("doc", pa.int64()), ("seq", pa.int32()), ("ids", pa.binary())]


def _tokenise(path: str, length: int):
    def run(batches):
        part, pos = TaskContext.get().partitionId(), 0
        for batch in batches:
            doc, seq, ids = [], [], []
            for d, flat in zip(batch.column(0).to_pylist(), _encoded(path, batch.column(1)), strict=True):
                cut = range(0, len(flat), 2 * length)
                ids += [flat[i : i + 2 * length] for i in cut]
                seq += range(len(cut))
                doc += [d] * len(cut)
            yield rows(_SEQS, [np.full(len(doc), part), np.arange(pos, pos + len(doc)), doc, seq, ids])
            pos += len(doc)

    return run


_OUT = "shard long, first_slot long, n_slots int, stride int, sha256 string, doc_ids array<long>, seqs array<int>, lengths array<int>, payload binary"


def materialise(docs: DataFrame, tokenizer: str, key: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    schema = "part int, pos long, doc long, seq int, ids binary"
    plain = id_and_text(docs, id_col, text_col).where("_text <> ''").select("_id", "_text", row_key("_id", "_text").alias("_key"))
    order = ["_id", "_key"]
    # the third column lets a row with very many copies fill several ranges
    ranged = plain.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order).select("_id", "_text")
    seqs = scratch.save_freeing(ranged.mapInArrow(_tokenise(tokenizer, length), schema), "sequences", compression="zstd")
    counts = {r["part"]: r["count"] for r in seqs.groupBy("part").count().collect()}  # one row for each range
    offsets, n = np.zeros(max(counts, default=0) + 1, np.int64), 0
    for part in sorted(counts):
        offsets[part], n = n, n + counts[part]
    _, end = _encoder(tokenizer)

    held = spark.sparkContext.broadcast(offsets)

    def place(batches):
        for b in batches:
            number = held.value[b.column(0).to_numpy()] + b.column(1).to_numpy()
            slot = feistel(number, n, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot // shard_slots), pa.array(slot), b.column(2), b.column(3), b.column(4)], ["shard", "slot", "doc", "seq", "ids"])

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("slot")
        shard, ids = table.column("shard")[0].as_py(), table.column("ids").to_pylist()
        slots = table.column("slot").to_numpy()
        if slots[0] != shard * shard_slots or slots[-1] - slots[0] + 1 != len(slots):
            raise RuntimeError(f"shard {shard} is not whole")
        pad = np.array([end], "<u2").tobytes()
        payload = b"".join([x + pad * (length - len(x) // 2) for x in ids])
        row = [shard, int(slots[0]), len(ids), 2 * length, hashlib.sha256(payload).hexdigest(), table.column("doc").to_pylist(), table.column("seq").to_pylist(), [len(x) // 2 for x in ids], payload]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
        names = ["shard", "first_slot", "n_slots", "stride", "sha256", "doc_ids", "seqs", "lengths", "payload"]
        return pa.table([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

    placed = seqs.mapInArrow(place, "shard long, slot long, doc long, seq int, ids binary")
    shards = max(1, -(-n // shard_slots))
    tasks = max(1, min(shards, spark.sparkContext.defaultParallelism * 4 if shards < 4096 else shards // 64))
    # shards are of one size, so hashing deals them out; a range would first read and place every sequence for its bounds
    return placed.repartition(tasks, "shard").groupBy("shard").applyInArrow(write, _OUT)


def read_slots(shards: DataFrame, start: int, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) in training order from `start`: what a reader that stopped there goes on with. One shard is held at a time."""
    wanted = shards.where((F.col("first_slot") < start + count) & (F.col("first_slot") + F.col("n_slots") > start))
    for r in wanted.orderBy("shard").toLocalIterator():
        ids = np.frombuffer(bytes(r["payload"]), "<u2").reshape(r["n_slots"], -1)
        for i in range(max(0, start - r["first_slot"]), min(r["n_slots"], start + count - r["first_slot"])):
            yield r["first_slot"] + i, ids[i][: r["lengths"][i]]


def export_files(shards: DataFrame, folder: str) -> None:
    """One file for each shard in a folder that all executors mount. Files with the shard's digest are kept, so a stopped export goes on; others, of another key or corpus, are replaced. shards.tsv, written last, lists number and digest of each."""

    def put(part):
        os.makedirs(folder, exist_ok=True)
        for r in part:
            path = f"{folder}/shard-{r['shard']:08d}.bin"
            if os.path.exists(path):
                with open(path, "rb") as f:
                    if hashlib.file_digest(f, "sha256").hexdigest() == r["sha256"]:
                        continue
            with open(f"{path}.{TaskContext.get().taskAttemptId()}", "wb") as f:
                f.write(r["payload"])
            os.replace(f.name, path)

    shards = shards.select("shard", "sha256", "payload")
    shards.foreachPartition(put)
    known = [f"{r['shard']:08d}\t{r['sha256']}\n" for r in shards.drop("payload").orderBy("shard").toLocalIterator()]
    with open(f"{folder}/shards.tsv.new", "w") as f:
        f.writelines(known)
    os.replace(f.name, f"{folder}/shards.tsv")
