"""SentencePiece encoding that keeps source offsets, and decoding.

A text is normalised here by the longest prefix found in the model's compiled character
map (a Darts double array), byte for byte with the place in the source that each byte
came from; pieces of the normalised text are then projected to byte spans of the original.
No piece of the vocabulary crosses the start of a run of white space, so such a model's
merges are decided within a segment (white space and the word after it); distinct segments
are encoded once by the library and remembered, within a bound, by each worker.  Models
where that does not hold (a piece with white space inside, a character map that is not
empty, no dummy prefix) are encoded text by text.  Either way every text is normalised and
its pieces are projected, also where only digests are asked for: the pieces must spell the
normalised text byte for byte, else the encoder stops.

Edge cases: null and empty texts have no pieces, only the end id; ids and other columns
pass through; very long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .wordkernel import lean, over_texts

SPACE = "▁"
REMEMBERED = 100_000  # segments a worker remembers


class CharMap:
    """A compiled character map: a Darts double array of prefixes and the strings they become."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int]:
        """What the longest known prefix of data[at:] becomes and its length; else one character as it is."""
        found = None
        if self.units:
            units, node = self.units, self._offset(self.units[0])
            for i in range(at, len(data)):
                node ^= data[i]
                if node >= len(units):
                    break
                unit = units[node]
                if unit & 0x800000FF != data[i]:
                    break
                node ^= self._offset(unit)
                if unit >> 8 & 1:
                    found = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if found:
            start = found[0]
            return self.strings[start : self.strings.index(b"\0", start)], found[1]
        lead = data[at]
        n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + n], n

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Normalizer:
    """Normalised bytes of a text and, for each and for the end, the place in the source."""

    def __init__(self, charsmap: bytes, dummy_prefix: bool = True, squeeze: bool = True, escape: bool = True):
        self.map, self.dummy, self.squeeze = CharMap(charsmap), dummy_prefix, squeeze
        self.space = SPACE.encode() if escape else b" "
        self.identity = not charsmap and not squeeze

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        data = text.encode()
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.identity:
            return self._identity(data)
        out, source, at = bytearray(), [], 0
        if self.squeeze:
            while at < len(data) and (p := self.map.longest(data, at))[0] == b" ":
                at += p[1]
            if at == len(data):
                return b"", np.array([at])

        def put(part: bytes) -> None:
            for i in range(len(part)):
                piece = self.space if part[i] == 0x20 else part[i : i + 1]
                out.extend(piece)
                source.extend([at] * len(piece))

        if self.dummy:
            put(b" ")
        after_space = self.squeeze
        while at < len(data):
            part, n = self.map.longest(data, at)
            if after_space:
                part = part.lstrip(b" ")
            if part:
                put(part)
                after_space = self.squeeze and part.endswith(b" ")
            at += n
        if self.squeeze:
            while out.endswith(self.space):
                del out[-len(self.space) :], source[-len(self.space) :]
        return bytes(out), np.array([*source, at])

    def _identity(self, data: bytes) -> tuple[bytes, np.ndarray]:
        raw = np.frombuffer(data, np.uint8)
        place = np.arange(len(raw))
        start = np.maximum.accumulate(np.where((raw & 0xC0) != 0x80, place, 0))
        source = np.repeat(start, np.where(raw == 0x20, len(self.space), 1))
        out = data.replace(b" ", self.space)
        if self.dummy:
            out, source = self.space + out, np.concatenate([np.zeros(len(self.space), np.int64), source])
        return out, np.append(source, len(raw))


class PieceEncoder:
    """Encodes texts with one model: ids, byte spans, and the library's decoding."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalize = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.spelled = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.encode() for p in proto.pieces]
        self.bytes_of = np.array([len(x) for x in self.spelled], np.int64)
        self.unknown, self.end = self.lib.unk_id(), self.lib.eos_id()
        inner = any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces)
        fallback = any(p.type == 6 for p in proto.pieces)
        own = any(p.type == 4 for p in proto.pieces)
        self.by_segment = self.normalize.identity and spec.add_dummy_prefix and spec.escape_whitespaces and fallback and not inner and not own and not proto.trainer_spec.treat_whitespace_as_suffix
        self.numbers = list(range(len(proto.pieces)))  # one object for each id, shared by all that is remembered
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}
        self.runs = re.compile(" *[^ ]+| +$")

    def segments(self, text: str) -> list[str]:
        """The text's segments, each without the first of its spaces (the library's dummy prefix puts it there)."""
        text = text.replace(SPACE, " ") if SPACE in text else text
        if "  " not in text and not text.startswith(" ") and not text.endswith(" "):
            return text.split(" ") if text else []
        return [s[1:] for s in self.runs.findall(" " + text)]

    def learn(self, split: list[list[str]]) -> None:
        new = list(set(chain.from_iterable(split)).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(set(chain.from_iterable(split)))
        # Of an empty segment the library makes nothing; it stands for one space, which is a segment's end of text.
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            for s, ids in zip(part, self.lib.encode(part, num_threads=1), strict=True):
                self.known[s] = (tuple([self.numbers[i] for i in ids]), " ".join(map(str, ids)))
        if "" in self.known and not self.known[""][0]:
            space = self.lib.piece_to_id(SPACE)
            self.known[""] = ((space,), str(space))

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """ids of each text and their decimal string, without the end id."""
        if not self.by_segment:
            return [(ids, " ".join(map(str, ids))) for ids in self.lib.encode(texts, num_threads=1)]
        split = [self.segments(t) for t in texts]
        self.learn(split)
        known, out = self.known, []
        for s in split:
            found = [known[x] for x in s]
            out.append(([i for ids, _ in found for i in ids], " ".join([x for _, x in found])))
        return out

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one source byte of each piece; a piece of white space that stands for nothing is empty."""
        norm, source = self.normalize(text)
        at = np.array(ids, np.int64)
        spelled, sizes = [self.spelled[i] for i in ids], self.bytes_of[at]
        if (at == self.unknown).any():
            spelled = [p.encode() if i == self.unknown else x for x, i, p in zip(spelled, ids, self.lib.encode(text, out_type=str), strict=True)]
            sizes = np.array([len(x) for x in spelled], np.int64)
        if (said := b"".join(spelled)) != norm:
            raise ValueError(f"pieces spell {len(said)} bytes that are not the {len(norm)} of the normalised text")
        ends = np.cumsum(sizes)
        return source[ends - sizes], source[ends]

    def pieces(self, texts: list[str]):
        """(ids, their decimal string, first and last-plus-one source bytes, decoded text) of each text, the end id in the decoding only."""
        for text, (ids, s) in zip(texts, self.encode(texts), strict=True):
            begin, end = self.spans(text, ids)
            yield ids, s, begin, end, self.lib.decode([*ids, self.end])


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(model: bytes) -> PieceEncoder:
    key = hashlib.sha256(model).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(model)
    return _ENCODERS[key]


def _chunks(batches, most: int = 500_000):
    """(ids, texts) of runs of rows with some bound on their characters."""
    for batch in batches:
        texts = batch.column(1).fill_null("").to_pylist()
        at = held = 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= most or i + 1 == len(texts):
                yield batch.column(0).slice(at, i + 1 - at), texts[at : i + 1]
                at, held = i + 1, 0


def _digests(model):
    def run(batches):
        enc = encoder(model.value)
        for keys, texts in _chunks(batches):
            tail = str(enc.end)
            n, ids, decoded, size, spans = [], [], [], [], []
            for i, s, begin, end, said in enc.pieces(texts):
                n.append(len(i) + 1)
                size.append(int(end[-1] - begin[0]) if len(end) else 0)
                spans.append(hashlib.sha256(np.stack([begin, end], axis=1).astype("<i8").tobytes()).hexdigest())
                ids.append(hashlib.sha256(f"{s} {tail}".encode() if s else tail.encode()).hexdigest())
                decoded.append(hashlib.sha256(said.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(size, pa.int64()), pa.array(spans, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "spans_sha256"])
        enc.known.clear()

    return lean(run)


def _pieces(model):
    kind = pa.list_(pa.int32())

    def run(batches):
        enc = encoder(model.value)
        for keys, texts in _chunks(batches, 200_000):
            ids, begin, end, decoded = [], [], [], []
            for i, _, a, b, said in enc.pieces(texts):
                ids.append([*i, enc.end])
                begin.append(a.tolist())
                end.append(b.tolist())
                decoded.append(said)
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, kind), pa.array(begin, kind), pa.array(end, kind), pa.array(decoded, pa.string())], names=["id", "ids", "begin", "end", "decoded"])
        enc.known.clear()

    return lean(run)


def encode_texts(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """A row per row of docs: ids with the end id, the source byte spans [begin, end) of the pieces before it and the
    decoded text; with ``digests`` instead n_tokens, ids_sha256, decoded_sha256, the source bytes that the spans cover
    (n_bytes) and spans_sha256, over begin and end of each piece as little-endian 64-bit numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary file, half a megabyte
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if digests:
        out = over_texts(rows, _digests(shared), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, spans_sha256 string")
    else:
        out = over_texts(rows, _pieces(shared), f"id {kind}, ids array<int>, begin array<int>, end array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)
