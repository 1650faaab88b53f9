"""Piece encoding with source offsets, and decoding, as the sentencepiece library does it.

Normalisation follows the model's compiled character map: at every position the longest key of its
double-array trie is replaced by its value, other characters stay, and every normalised byte remembers the
source byte it came from. Pieces are then projected to spans of the original UTF-8 bytes.

Where the model allows it, a text is cut where no piece can cross: before a run of spaces, and around line
ends. Such chunks are segmented apart, once each while they stay in a cache of bounded entries, each of bounded length.
In such models no key of the map matches anywhere, so the alignment of all bytes of a batch is laid out at once: every
source byte and the dummy prefix take a stretch of the normalised text, and pieces, side by side, are read off it. What
the pieces decode to is compared with the source; a text that differs is aligned by itself. Other models take whole texts.
Null texts are empty; every text, however long, is encoded whole. Results depend on the row's text alone, so null or
repeated ids, repeated rows and other columns make no difference.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from weftlink.llm.sessions import id_and_text, released, rows
from weftlink.llm.tokens import slices

SPACE = "▁"
CACHE = 300_000
CACHED_CHARS = 48
CONTROL, BYTE = 3, 6
_CHUNK = re.compile(r"\n| +[^ \n]*|[^ \n]+").findall


class CharMap:
    """A compiled character map: the size of a double-array trie, the trie, and its zero-ended values."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.values = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length of the longest key that starts at `at`, its value)."""
        if not self.units:
            return None
        step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node, found = step(self.units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= step(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, self.units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.values[found[1] : self.values.index(b"\0", found[1])]


class PieceCodec:
    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.sp.serialized_model_proto())
        spec = model.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        self.pieces, self.types = [p.piece for p in model.pieces], [p.type for p in model.pieces]
        crossing = any(SPACE in p.lstrip(SPACE) or "\n" in p for p, t in zip(self.pieces, self.types, strict=True) if t != CONTROL)
        plain = not self.map.units and self.dummy and not self.squeeze and self.escape and not self.suffix and set(self.types) <= {1, 2, 3, 6}
        self.cuts = plain and not crossing and model.trainer_spec.byte_fallback
        self.raw = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else p.replace(SPACE, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]
        self.encoded = [p.encode() for p in self.pieces]
        self.lone = self.sp.piece_to_id(SPACE)
        self.width = np.array([1 if t == BYTE else len(p) for p, t in zip(self.encoded, self.types, strict=True)], np.int64)
        self.seen: dict[str, tuple[bytes, bytes]] = {}
        self.bos, self.eos = (np.array([i], "<u4").tobytes() for i in (self.sp.bos_id(), self.sp.eos_id()))

    # --- encoding -------------------------------------------------------------------------------
    def _chunks(self, text: str) -> list[tuple[bytes, bytes]]:
        """(ids, decoded bytes) of each chunk of the text with its dummy prefix."""
        chunks = _CHUNK(" " + text.replace(SPACE, " "))
        seen, long = self.seen, {}
        missing = [c for c in set(chunks) if c not in seen]
        if len(seen) + len(missing) > CACHE:
            seen = self.seen = {}
            missing = list(set(chunks))
        # a chunk that starts with a space gets it back as the dummy prefix; others follow a line end
        after = [c[0] != " " for c in missing]
        encoded = self.sp.encode([("\n" + c) if a else c[1:] for c, a in zip(missing, after, strict=True)], num_threads=1)
        for c, a, ids in zip(missing, after, encoded, strict=True):
            if c == " ":  # the dummy prefix alone, which the library leaves out of an empty text
                ids = [self.lone]
            ids = ids[2:] if a else ids
            (seen if len(c) <= CACHED_CHARS else long)[c] = struct.pack(f"<{len(ids)}I", *ids), b"".join([self.raw[i] for i in ids])
        return [seen[c] for c in chunks] if not long else [seen.get(c) or long[c] for c in chunks]

    def encode_bytes(self, text: str) -> tuple[bytes, bytes]:
        """(ids as little-endian unsigned 32-bit integers, without begin and end; the decoded text's UTF-8)."""
        if not text:
            return b"", b""
        if not self.cuts:
            ids = self.sp.encode(text)
            return np.array(ids, "<u4").tobytes(), self.sp.decode(ids).encode()
        entries = self._chunks(text)
        decoded = b"".join([e[1] for e in entries])
        return b"".join([e[0] for e in entries]), decoded[1:]

    def encode(self, text: str | None) -> list[int]:
        ids = self.encode_bytes(text or "")[0]
        return [self.sp.bos_id(), *np.frombuffer(ids, "<u4").tolist(), self.sp.eos_id()]

    # --- offsets --------------------------------------------------------------------------------
    def normalise(self, text: str) -> tuple[bytes, list[int]]:
        """(normalised UTF-8, the source byte of each normalised byte and the end)."""
        data, out, source = text.encode(), bytearray(), []
        if not data:
            return b"", [0]
        mark = SPACE.encode() if self.escape else b" "
        if not self.map.units and not self.squeeze:  # no key matches anywhere: only spaces change
            body, end, prefix_size = data.replace(b" ", mark), len(data), len(mark) * self.dummy
            if data.isascii() and b" " not in data:
                body_source = list(range(end))
            else:
                body_source, start = [], 0
                for k, c in enumerate(data):
                    start = start if c & 0xC0 == 0x80 else k
                    body_source += [start] * (len(mark) if c == 0x20 else 1)
            if self.suffix:
                return body + mark * self.dummy, [*body_source, *[end] * prefix_size, end]
            return mark * self.dummy + body, [0] * prefix_size + body_source + [end]

        def prefix(at: int) -> tuple[int, bytes]:
            hit = self.map.longest(data, at)
            if hit:
                return hit
            n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            return n, data[at : at + n]

        at = 0
        while self.squeeze and at < len(data):
            n, value = prefix(at)
            if value != b" ":
                break
            at += n
        if at == len(data):
            return b"", [at]

        def space(where: int) -> None:
            out.extend(mark)
            source.extend([where] * len(mark))

        if self.dummy and not self.suffix:
            space(at)
        was_space = self.squeeze
        while at < len(data):
            n, value = prefix(at)
            while was_space and value.startswith(b" "):
                value = value[1:]
            for c in value:
                if c == 0x20:
                    space(at)
                else:
                    out.append(c)
                    source.append(at)
            if value:
                was_space = self.squeeze and value.endswith(b" ")
            at += n
        while self.squeeze and out.endswith(mark):
            at = source[-1]
            del out[-len(mark) :], source[-len(mark) :]
        if self.dummy and self.suffix:
            space(at)
        return bytes(out), [*source, at]

    def _project(self, ids: list[int], normal: bytes, source: list[int]) -> list[tuple[int, int, int]]:
        """Pieces, laid side by side over the normalised text, as spans of its source."""
        at, out, types, encoded = 0, [], self.types, self.encoded
        for i in ids:
            if types[i] == BYTE:
                first = at
                while normal[first] & 0xC0 == 0x80:
                    first -= 1
                last = at + 1
                while last < len(normal) and normal[last] & 0xC0 == 0x80:
                    last += 1
                begin, end, n = source[first], source[last], 1
                if end - begin == last - first:  # an unchanged character: its own bytes
                    begin, end = begin + at - first, begin + at - first + 1
                if normal[at] != self.raw[i][0]:
                    raise ValueError(f"byte piece {i} does not stand at byte {at} of the normalised text")
                out.append((i, begin, end))
                at += 1
                continue
            if types[i] == 2:  # unknown: one character
                n = self._unknown(normal, at)
            else:
                n = len(encoded[i])
                if not normal.startswith(encoded[i], at):
                    raise ValueError(f"piece {i} does not stand at byte {at} of the normalised text")
            out.append((i, source[at], source[min(at + n, len(normal))]))
            at += n
        return out

    def encode_aligned(self, texts: list[str | None]) -> list[tuple[bytes, bytes, np.ndarray]]:
        """Of each text: ids, decoded bytes, and the first and end source byte of each piece."""
        sources = [(t or "").encode() for t in texts]
        coded = [self.encode_bytes(t or "") for t in texts]
        if not self.cuts:
            return [(*c, self._own_spans(t or "", c[0])) for t, c in zip(texts, coded, strict=True)]
        ids = np.frombuffer(b"".join([c[0] for c in coded]), "<u4")
        count, size = np.array([len(c[0]) // 4 for c in coded], np.int64), np.array([len(x) for x in sources], np.int64)
        # one entry for the dummy prefix of a text that isn't empty and one for each source byte
        entries = size + (size > 0)
        first = np.cumsum(entries) - entries
        wide = np.ones(int(entries.sum()), np.int64)
        wide[np.frombuffer(b"".join([b" " + x if x else b"" for x in sources]), np.uint8) == 0x20] = self.width[self.lone]
        total = np.concatenate([[0], np.cumsum(wide)])
        entry = np.repeat(np.arange(len(wide) + 1), np.append(wide, 1))  # of each normalised byte, and the end
        reached = np.concatenate([[0], np.cumsum(self.width[ids])])
        whole = (reached[np.cumsum(count)] - reached[np.cumsum(count) - count] == total[first + entries] - total[first]).tolist()
        out, at = [], 0
        fits = reached[-1] == total[-1]
        place = entry[reached] if fits else None
        for t, source, c, n, f, ok in zip(texts, sources, coded, count.tolist(), first.tolist(), whole, strict=True):
            if fits and ok and c[1] == source.replace(SPACE.encode(), b" "):
                spans = np.maximum(np.stack([place[at : at + n], place[at + 1 : at + n + 1]], 1) - f - 1, 0)
            else:
                spans = self._own_spans(t or "", c[0])
            out.append((*c, spans))
            at += n
        return out

    def _own_spans(self, text: str, ids: bytes) -> np.ndarray:
        return np.array([x[1:] for x in self._project(np.frombuffer(ids, "<u4").tolist(), *self.normalise(text))], np.int64).reshape(-1, 2)

    def encode_spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(id, first byte, end byte) of each piece in the original UTF-8; a byte piece has its own byte of an unchanged character."""
        ids, _, spans = self.encode_aligned([text])[0]
        return [(i, b, e) for i, (b, e) in zip(np.frombuffer(ids, "<u4").tolist(), spans.tolist(), strict=True)]

    @staticmethod
    def _unknown(normal: bytes, at: int) -> int:
        n = 1
        while at + n < len(normal) and normal[at + n] & 0xC0 == 0x80:
            n += 1
        return n

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def covered(spans: np.ndarray) -> int:
    """Bytes that lie in at least one span; spans begin in order."""
    if not len(spans):
        return 0
    reached = np.concatenate([[0], np.maximum.accumulate(spans[:, 1])[:-1]])
    return int(np.maximum(0, spans[:, 1] - np.maximum(spans[:, 0], reached)).sum())


_OUT = [("doc", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_bytes", pa.int64()), ("lossless", pa.bool_())]


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens with begin and end, digests of ids and of the decoded text, bytes covered by pieces, and whether decoding gave the text back."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            for first, last, _, _ in slices(batch.column(1)):
                n, a, b, size, same = [], [], [], [], []
                texts = batch.column(1).slice(first, last - first).to_pylist()
                for text, (ids, decoded, spans) in zip(texts, c.encode_aligned(texts), strict=True):
                    n.append(len(spans) + 2)
                    a.append(hashlib.sha256(c.bos + ids + c.eos).hexdigest())
                    b.append(hashlib.sha256(decoded).hexdigest())
                    size.append(covered(spans))
                    same.append(decoded == (text or "").encode())
                yield rows(_OUT, [batch.column(0).slice(first, last - first), n, a, b, size, same])
        c.seen.clear()

    out = id_and_text(docs, id_col, text_col).mapInArrow(released(run), "doc long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, lossless boolean")
    return out.withColumnRenamed("doc", id_col)


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and its pieces as array<struct<id, begin, end>> with byte spans of the original text, begin and end ids left out."""
    item = pa.struct([("piece_id", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())])

    def run(batches):
        c = codec(path)
        for batch in batches:
            spans = [[{"piece_id": i, "begin": s, "end": e} for i, s, e in c.encode_spans(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(item))], ["doc", "pieces"])

    out = id_and_text(docs, id_col, text_col).mapInArrow(run, "doc long, pieces array<struct<piece_id: int, begin: int, end: int>>")
    return out.withColumnRenamed("doc", id_col)
