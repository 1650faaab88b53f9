from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from weftlink.llm.shards import _encoded, _encoder, _encoder_without_runs, export_files, feistel, materialise, read_slots

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("slot", T.StringType()), T.StructField("part", T.StringType())])


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    for key in (0, 7, 2**63 + 1):
        assert sorted(feistel(np.arange(n), n, key).tolist()) == list(range(n))
    if n > 500:
        assert feistel(np.arange(n), n, 1).tolist() != feistel(np.arange(n), n, 2).tolist()


def test_texts_without_runs_of_space_need_no_look_ahead():
    rng = random.Random(4)
    signs = ["a", "Ä", "'s", "'", "12", "%%", "漢", "🙂", "\x1c", "e\u0301", " ", "  ", "\t", "\n", "\x0b", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u3000"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 12))) for _ in range(20_000)] + [None, "", " ", "\n\n", "x ", "x  y"]
    encoder, end = _encoder(PATH)
    want = [np.array([*encoder.encode_ordinary(t), end], "<u2").tobytes() if t else b"" for t in texts]
    assert list(_encoded(PATH, pa.array(texts))) == want
    # the quick pattern is there, and would be wrong on runs
    assert "(?!" not in _encoder_without_runs(PATH)._pat_str and _encoder_without_runs(PATH).encode_ordinary("x  y") != encoder.encode_ordinary("x  y")


def test_shards_are_dealt_without_a_pass_for_ranges(spark):
    df = spark.createDataFrame([(i, "word " * 40, "", "") for i in range(50)], SCHEMA)
    plan = materialise(df, PATH, key=1, length=4, shard_slots=16)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("Exchange") == 1


def test_round_trip(spark, tmp_path):
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, "x"), (4, "été 漢字 🙂"), (4, "été 漢字 🙂"), (5, " ".join(rng.choices(["alpha", "beta", "gamma"], k=20_000)))]
    rows += [(i, " ".join(rng.choices(["one", "two", "three"], k=rng.randint(1, 200)))) for i in range(10, 80)]
    df = spark.createDataFrame([(d, t, "", "") for d, t in rows], SCHEMA).repartition(4)
    shards = materialise(df, PATH, key=5, length=16, shard_slots=64).persist()
    encoder, end = _encoder(PATH)
    got = shards.orderBy("shard").collect()
    n = sum(r["n_slots"] for r in got)
    assert [r["first_slot"] for r in got] == list(range(0, n, 64))
    parts: dict = {}
    for r in got:
        ids = np.frombuffer(bytes(r["payload"]), "<u2").reshape(-1, 16)
        assert r["stride"] == 32 and len(ids) == r["n_slots"]
        for d, s, length, row in zip(r["doc_ids"], r["seqs"], r["lengths"], ids):
            assert (row[length:] == end).all()
            parts.setdefault((d, s), []).append(row[:length].tolist())
    for d, t in rows:
        if t:
            want = [*encoder.encode_ordinary(t), end]
            copies = sum(1 for x in rows if x[0] == d)
            whole = [x for s in range(-(-len(want) // 16)) for x in parts[d, s][0]]
            assert whole == want and all(len(parts[d, s]) == copies for s in range(-(-len(want) // 16)))
    assert {d for d, _ in parts} == {d for d, t in rows if t}
    every = list(read_slots(shards, 0, n))
    assert [s for s, _ in every] == list(range(n))
    later = list(read_slots(shards, 70, 100))
    assert [s for s, _ in later] == list(range(70, 170)) and all((a == b).all() for (_, a), (_, b) in zip(later, every[70:170]))
    again = materialise(df, PATH, key=5, length=16, shard_slots=64)
    assert again.count() == len(got)
    export_files(shards, str(tmp_path / "out"))
    folder = tmp_path / "out"
    read = lambda: {f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in folder.glob("*.bin")}
    assert sum(f.stat().st_size for f in folder.glob("*.bin")) == 32 * n
    assert read() == {f"shard-{r['shard']:08d}.bin": r["sha256"] for r in got}
    other = materialise(df, PATH, key=6, length=16, shard_slots=64).persist()
    export_files(other, str(folder))  # shards of the same sizes are replaced
    assert read() == {f"shard-{r['shard']:08d}.bin": r["sha256"] for r in other.collect()}
    assert (folder / "shards.tsv").read_text().count("\n") == len(got)
    shards.unpersist()
    other.unpersist()


def test_every_sequence_is_in_its_slot(spark):
    rows = [(None if i % 5 == 0 else i // 2, "word " * (i % 7)) for i in range(60)] + [(3, None)]
    df = spark.createDataFrame([(d, t, "", "") for d, t in rows], SCHEMA).coalesce(1)
    encoder, end = _encoder(PATH)
    # numbers follow id (none first), then row hash, then place in the text
    keyed = df.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k")).collect()
    want = []
    for d, t, _ in sorted(keyed, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        flat = [*encoder.encode_ordinary(t), end] if t else []
        want += [(d, s, flat[i : i + 4]) for s, i in enumerate(range(0, len(flat), 4))]
    slots = feistel(np.arange(len(want)), len(want), 11).tolist()
    got = {}
    for r in materialise(df, PATH, key=11, length=4, shard_slots=16).collect():
        ids = np.frombuffer(bytes(r["payload"]), "<u2").reshape(-1, 4)
        for k, (d, s, n) in enumerate(zip(r["doc_ids"], r["seqs"], r["lengths"], strict=True)):
            got[r["first_slot"] + k] = (d, s, ids[k][:n].tolist())
    assert got == dict(zip(slots, want, strict=True))


def test_files_do_not_matter(spark):
    rows = [(None if i % 9 == 0 else i % 40, f"text number {i} " * (i % 13)) for i in range(200)] + [(7, "same row")] * 60
    results = []
    for n in (1, 3, 7):
        random.Random(n).shuffle(rows)
        df = spark.createDataFrame([(d, t, "", "") for d, t in rows], SCHEMA).repartition(n)
        results.append([tuple(r) for r in materialise(df, PATH, key=3, length=8, shard_slots=32).orderBy("shard").collect()])
    assert results[0] == results[1] == results[2] and len(results[0]) > 10


def test_empty_table(spark):
    assert materialise(spark.createDataFrame([], SCHEMA), PATH, key=1).collect() == []
