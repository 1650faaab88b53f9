from __future__ import annotations

import hashlib
import random
import struct

import numpy as np

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import types as T
from weftlink.llm import piece_codec
from weftlink.llm.piece_codec import CharMap, PieceCodec, encode_digests, encode_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = [*"abc xyz   \n\n\t\r.,é漢🙂▁0123'\"<>　\x00\x01﻿​", "hello", "the ", "▁▁", "<0x0A>", "</s>"]


def texts(n=3000):
    rng = random.Random(11)
    return [None, "", " ", "\n", "\n ", "a" * 5000, " " * 500, *("".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(n))]


def test_ids_and_spans():
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=PATH), PieceCodec(PATH)
    for t in texts():
        want = sp.encode(t or "", add_bos=True, add_eos=True)
        assert codec.encode(t) == want
        assert codec.encode_bytes(t or "")[1] == sp.decode(want).encode()
        spans, source = codec.encode_spans(t), (t or "").encode()
        assert [s[0] for s in spans] == want[1:-1]
        assert b"".join(source[b:e] for _, b, e in spans) == source
        assert all(x[2] == y[1] for x, y in zip(spans, spans[1:]))


def test_table(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType())])
    rows = list(enumerate(texts(200)))
    rows.append(rows[-1])
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], schema).repartition(3)
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = []
    for d, t in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    got = encode_digests(df, PATH).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert encode_pieces(df, PATH).count() == len(rows)
    assert encode_digests(df.limit(0), PATH).collect() == []


def trie(keys):
    """A double-array trie in the layout of the compiled maps, built the slow way."""
    units, used = {0: 0}, {0}

    def place(node, items):
        labels = sorted({k[0] if k else 0 for k, _ in items})
        base = next(b for b in range(1, 1 << 14) if all((b ^ c) not in used for c in labels) and (node ^ b) < 1 << 20)
        for c in labels:
            used.add(base ^ c)
        units[node] = units.get(node, 0) & 0xFF | ((node ^ base) << 10)
        for c in labels:
            rest = [(k[1:], v) for k, v in items if (k[0] if k else 0) == c and k]
            if c == 0:
                units[node] |= 1 << 8
                units[base] = 1 << 31 | next(v for k, v in items if not k)
            else:
                units[base ^ c] = c
                place(base ^ c, rest)

    place(0, sorted(keys))
    return struct.pack(f"<{max(units) + 300}I", *[units.get(i, 0x800000FF) for i in range(max(units) + 300)])


def test_longest_prefix_of_a_compiled_map():
    values = b"X\0YY\0 \0"
    blob = trie([(b"ab", 0), (b"abc", 2), ("　".encode(), 5)])
    m = CharMap(struct.pack("<I", len(blob)) + blob + values)
    assert m.longest(b"abcd", 0) == (3, b"YY")
    assert m.longest(b"abd", 0) == (2, b"X")
    assert m.longest(b"ad", 0) is None
    codec = PieceCodec(PATH)
    codec.map = m
    normal, source = codec.normalise("zabc　ab")
    assert normal.decode() == "▁zYY▁X"
    assert source == [0, 0, 0, 0, 1, 1, 4, 4, 4, 7, 9]


@pytest.mark.parametrize("text", ["", "  x  y ", " "])
def test_squeezed_spaces(text):
    codec = PieceCodec(PATH)
    codec.squeeze = True
    normal, source = codec.normalise(text)
    assert normal.decode() == {"": "", "  x  y ": "▁x▁y", " ": ""}[text]
    assert len(source) == len(normal) + 1


def test_digests_come_from_spans(spark):
    codec, all_texts = PieceCodec(PATH), texts(500)
    for t, (ids, decoded, spans) in zip(all_texts, codec.encode_aligned(all_texts), strict=True):
        normal, source = codec.normalise(t or "")
        assert [(b, e) for _, b, e in codec._project([*struct.unpack(f"<{len(ids) // 4}I", ids)], normal, source)] == [tuple(x) for x in spans.tolist()]
        assert decoded.decode() == codec.decode([*struct.unpack(f"<{len(ids) // 4}I", ids)])
    rows = [(k, t) for k, t in enumerate(texts(100))]
    got = {r["doc_id"]: r["n_bytes"] for r in encode_digests(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    assert got == {k: len((t or "").encode()) for k, t in rows}


def test_a_batch_with_a_text_that_decodes_otherwise(monkeypatch):
    codec, own = PieceCodec(PATH), []
    right = [x[2].tolist() for x in codec.encode_aligned(["one two", "three ▁ four"])]
    codec = PieceCodec(PATH)
    encode = PieceCodec.encode_bytes
    monkeypatch.setattr(PieceCodec, "encode_bytes", lambda self, t: (encode(self, t)[0], b"?") if t == "one two" else encode(self, t))
    monkeypatch.setattr(PieceCodec, "_own_spans", lambda self, t, ids: own.append(t) or np.array([x[1:] for x in self._project(np.frombuffer(ids, "<u4").tolist(), *self.normalise(t))]))
    assert [x[2].tolist() for x in codec.encode_aligned(["one two", "three ▁ four"])] == right and own == ["one two"]


def test_cache_is_bounded():
    codec = PieceCodec(PATH)
    codec.encode_aligned(["short " + "long" * 1000])
    assert codec.seen and max(map(len, codec.seen)) <= piece_codec.CACHED_CHARS


def test_odd_rows(spark):
    rows = [(1, None), (1, ""), (1, " "), (None, "a b"), (None, "a b"), (2, "x" * 100_000)]
    df = spark.createDataFrame([(d, t, "p") for d, t in rows], "doc_id long, text string, n_tokens string")
    got = sorted(((r["doc_id"], r["n_bytes"]) for r in encode_digests(df, PATH).collect()), key=str)
    assert got == sorted([(1, 0), (1, 0), (1, 1), (None, 3), (None, 3), (2, 100_000)], key=str)
    assert encode_digests(df.limit(0), PATH).collect() == []
