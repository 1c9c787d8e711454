"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the vocabulary's pieces drives a single-pass
Viterbi: at each place the automaton's output links give every piece that ends
there, and each relaxes the best score of its end.  The result is the
segmentation of the highest total score, earlier starts winning ties.  A
character that no piece covers is an unknown and is written as its UTF-8 bytes
where the vocabulary has byte pieces.

Spaces become U+2581 and one is put before a text; no piece of such a
vocabulary has U+2581 after another character (checked when it is loaded; if one
has, texts are encoded whole), so a best segmentation always cuts there and the
words between can be encoded one by one, each distinct word once per batch.

Defined results: a null text has null ids; an empty text has none, and decodes
to an empty text; decoding gives back any text without U+2581 exactly (that
character comes back as a space, as the format has it); null ids decode to
null; bytes that are no UTF-8 decode to U+FFFD, and count as that where a text
holds them; a very long text is encoded whole,
word by word; repeated rows give repeated results; an input column that has the
name of a result is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .frames import append
from .textops import flat, valid
from .vocab import Encoder

#: Types of pieces, the space mark, and what an unknown costs beyond the lowest score.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE, UNKNOWN_PENALTY = "▁", 10.0


def wire(data: bytes) -> list[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message, with their numbers."""
    out, at = [], 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            out.append((key >> 3, varint()))
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        out.append((key >> 3, data[at : at + size]))
        at += size
    return out


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        pieces, scores, kinds, prefix = [], [], [], True
        with open(path, "rb") as f:
            model = wire(f.read())
        for number, value in model:
            if number == 1:
                own = dict(wire(value))
                pieces.append(own.get(1, b"").decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif number == 3:
                spec = dict(wire(value))
                prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only vocabularies whose texts are not normalised are supported")
        return cls(pieces, scores, kinds, prefix)


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        self.lowest = min((s for s, k in zip(v.scores, v.kinds, strict=True) if k == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.unknown = v.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)) if k == BYTE}
        for i, (piece, score, kind) in enumerate(zip(v.pieces, v.scores, v.kinds, strict=True)):
            if kind in (NORMAL, USER_DEFINED) and piece:
                self.automaton.add_word(piece, (i, len(piece), score))
        self.automaton.make_automaton()
        self.singles = {p for p, k in zip(v.pieces, v.kinds, strict=True) if len(p) == 1 and k in (NORMAL, USER_DEFINED)}
        self.by_words = not any(SPACE in p.lstrip(SPACE) for p, k in zip(v.pieces, v.kinds, strict=True) if k in (NORMAL, USER_DEFINED))
        self.raw = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(v.pieces, v.kinds, strict=True)]
        self.encoder = Encoder(lambda words: [self.segment(w.decode().replace(" ", SPACE)) for w in words])

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation; an unknown is one character that is no piece by itself."""
        n = len(text)
        best, back = [None] * (n + 1), [(self.unknown, 1)] * (n + 1)
        best[0] = 0.0
        done, lowest, singles = 0, self.lowest, self.singles

        def settle(upto: int) -> None:
            """All pieces that end up to here are known: try an unknown where its character is no piece."""
            nonlocal done
            while done < upto:
                done += 1
                if text[done - 1] not in singles and (best[done] is None or best[done - 1] + lowest > best[done]):
                    best[done], back[done] = best[done - 1] + lowest, (self.unknown, 1)

        for last, (piece, size, score) in self.automaton.iter(text):
            end = last + 1
            if done < last:
                settle(last)
            total = best[end - size] + score
            if best[end] is None or total > best[end]:
                best[end], back[end] = total, (piece, size)
        settle(n)
        out, at = [], n
        while at:
            piece, size = back[at]
            if piece == self.unknown and self.bytes:
                out += [self.bytes[b] for b in reversed(text[at - size : at].encode())]
            else:
                out.append(piece)
            at -= size
        return out[::-1]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and n + 1 offsets."""
        if self.vocabulary.dummy_prefix:
            filled = offsets[:-1][np.diff(offsets) > 0]
            data = np.insert(data, filled, 32)
            offsets = offsets + np.append(0, np.cumsum(np.diff(offsets) > 0))
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        begin = np.zeros(len(data) + 1, bool)
        begin[offsets] = True
        if self.by_words:
            space = data == 32
            begin[1:-1] |= space[1:] & ~space[:-1]
        starts = np.flatnonzero(begin[:-1])
        ids, at = self.encoder.ids(data, starts)
        return ids, at[np.searchsorted(starts, offsets)]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        text = b"".join([self.raw[i] for i in ids])
        return (text[1:] if self.vocabulary.dummy_prefix and text[:1] == b" " else text).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a vocabulary file, built once in each process."""
    if path not in _codecs:
        _codecs[path] = Codec(Vocabulary.load(path))
    return _codecs[path]


def _lists(ids: np.ndarray, at: np.ndarray, nulls: pa.Array) -> pa.Array:
    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
    return pa.compute.if_else(nulls, pa.scalar(None, lists.type), lists) if nulls.true_count else lists


def encode(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``piece_ids``."""
    import pyarrow.compute  # noqa: F401

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        column = batch.column(batch.schema.get_field_index(text_col))
        return [_lists(*codec(path).encode(*valid(*flat(column))), column.is_null())]

    return append(df, text_col, T.StructType([T.StructField("piece_ids", T.ArrayType(T.IntegerType()))]), make, keep)


def decode(df: DataFrame, path: str, ids_col: str = "piece_ids", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``decoded``, the text of the ids."""
    carried = [c for c in (df.columns if keep is None else keep) if c != "decoded"]
    used = carried + [ids_col] * (ids_col not in carried)
    schema = T.StructType([df.schema[c] for c in carried] + [T.StructField("decoded", T.StringType())])

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array([None if x is None else codec(path).decode(x) for x in ids], pa.string())], names=schema.names)

    return df.select(*used).mapInArrow(run, schema)


DIGEST = T.StructType([T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())])


def digest(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Both ways for each text, as counts and hashes: ids (little-endian unsigned 32-bit) and decoded text, null for a null text."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        column = batch.column(batch.schema.get_field_index(text_col))
        own, rows = codec(path), []
        data, offsets = valid(*flat(column))
        ids, at = own.encode(data, offsets)
        texts = data.tobytes()
        for k, null in enumerate(column.is_null().to_pylist()):
            if null:
                rows.append((None, None, None, None))
                continue
            its = ids[at[k] : at[k + 1]]
            back = own.decode(its.tolist()).encode()
            rows.append((len(its), zlib.crc32(its.astype("<u4").tobytes()), hashlib.sha256(back).hexdigest(), back == texts[offsets[k] : offsets[k + 1]]))
        return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)]

    return append(df, text_col, DIGEST, make, keep)
