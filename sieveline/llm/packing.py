"""Packing: token sequences of equal capacity with balanced attention cost.

Every document is tokenised whole and ended by an end id.  What fills whole
sequences is cut off first; the rest of each document goes to a pool of its
task.  From a full pool, documents are assigned in descending length, each to
the sequence of the lowest estimated cost (linear plus quadratic in the length
of each piece) among those with room left; what no sequence has room for is cut
over the room that remains.  What does not fill sequences waits for the next
pool, so only the last sequence of a task is padded.  There is no shuffle, a
task holds one pool and one batch at a time, and a task that runs again on the
same rows gives the same sequences.

Pieces for the tokenizer are cut by array operations that follow its published
pattern; every distinct piece is encoded by the tokenizer itself.

Defined results: a null or empty text is the end id alone; a text longer than a
sequence is cut; of documents of one length the one that came first is placed
first, and of sequences of one cost the first takes it; bytes that are no UTF-8
count as U+FFFD; repeated rows are packed one by one, also under the same id;
an empty table gives an empty result; columns beside id and text are not looked
at, whatever their names; the id must be an integer (``pack`` says so before it
runs).  A text with the string of a special token is encoded whole by the
tokenizer, which makes that string one id, unless ``special_as_text``.
"""

from __future__ import annotations

import os
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import whole_number
from .textops import CHUNK_BYTES, flat, kept, released, slices, valid
from .vocab import Encoder

CAPACITY = 2048
END_ID = 1
#: Bytes of text that are tokenised at once; distinct pieces are encoded once in each.
CHUNK = 1 << 22
#: Pieces in one call of the tokenizer.
ENCODED = 4096
#: Sequences that one pool fills.
POOL = 512
#: Estimated cost of a piece: its length, and its length squared times this.
QUADRATIC = 1 / 512
LETTER, DIGIT, SPACE, OTHER = 1, 2, 3, 0
#: Code points with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Endings that the tokenizer's pattern splits off.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def classes() -> np.ndarray:
    """The class of each code point in the tokenizer's pattern."""
    by_category = {"L": LETTER, "N": DIGIT}
    out = np.fromiter((by_category.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[[ord(c) for c in WHITE_SPACE]] = SPACE
    return out


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The first byte of each piece that the pattern makes of the texts.

    Pieces are runs of letters, digits or other characters, each with one space
    before it; runs of white space without that one; and endings after an
    apostrophe.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    head = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = classes()[points]
    n = len(points)
    begin = np.zeros(n + 1, bool)
    begin[np.searchsorted(head, offsets)] = True
    begin[n] = True
    change = np.append(True, kind[1:] != kind[:-1]) | begin[:-1]
    blank, white = points == 32, kind == SPACE
    after_blank = np.append(False, blank[:-1]) & ~begin[:-1]
    # the last white space before something else stands alone or leads what follows
    last_white = white & ~begin[1:] & np.append(kind[1:] != SPACE, True)
    start = change & (white | ~after_blank) | last_white
    for i in np.flatnonzero((points == 39) & start & (kind == OTHER)):
        follows = points[i + 1 : i + 3].tobytes().decode("utf-32-le")
        ending = next((e for e in ENDINGS if follows.startswith(e)), None)
        if ending and not begin[i + 1 : i + 1 + len(ending)].any():
            start[i + 1] = False
            if i + 1 + len(ending) < n:
                start[i + 1 + len(ending)] = True
    return head[np.flatnonzero(start)]


class TextEncoder(Encoder):
    """Encodes pieces, and whole texts in which ``special`` strings stand."""

    def __init__(self, encode, tokenizer, special: list[bytes]):
        super().__init__(encode)
        self.tokenizer, self.special = tokenizer, special

    def whole(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, np.ndarray]:
        """The ids of the texts that hold a special string, by row."""
        found, text = set(), data.tobytes() if self.special else b""
        for token in self.special:
            at = text.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(token) <= offsets[row + 1]:
                    found.add(row)
                at = text.find(token, at + 1)
        return {r: np.array(self.tokenizer.encode(text[offsets[r] : offsets[r + 1]].decode(), add_special_tokens=False).ids, np.uint32) for r in sorted(found)}


def tokenizer_encoder(path: str, special_as_text: bool = False) -> TextEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = special_as_text
    special = [] if special_as_text else [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
    batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)

    def encode(pieces: list[bytes]) -> list[list[int]]:
        out = []
        for at in range(0, len(pieces), ENCODED):  # an encoding has much beside its ids
            out += [x.ids for x in batch([p.decode() for p in pieces[at : at + ENCODED]], add_special_tokens=False)]
        return out

    return TextEncoder(encode, tokenizer, special)


def document_ids(encoder: TextEncoder, data: np.ndarray, offsets: np.ndarray, end_id: int = END_ID) -> list[np.ndarray]:
    """The ids of each text, ended by ``end_id``."""
    parts, row = [], 0
    while row < len(offsets) - 1:  # code points take four times the room, so they are looked at in smaller parts
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES // 2, "right")) - 1)
        parts.append(offsets[row] + piece_starts(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]))
        row = end
    starts = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    ids, at = encoder.ids(data, starts) if len(starts) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
    bounds = at[np.searchsorted(starts, offsets)]
    ended = np.insert(ids, bounds[1:], end_id)
    ends = bounds[1:] + np.arange(1, len(offsets))
    out = np.split(ended, ends[:-1])
    for row, own in encoder.whole(data, offsets).items():
        out[row] = np.append(own, np.uint32(end_id))
    return out


Piece = tuple[int | None, int, np.ndarray, int]  # document, ids before it, ids, ids of the document


class Packer:
    """Fills sequences; ``full`` yields (piece, sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY, pool: int = POOL):
        self.capacity, self.pool = capacity, pool
        self.waiting: list[Piece] = []
        self.tokens = self.sequences = 0

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple[Piece, int, int]]:
        whole = len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            yield (doc, at, ids[at : at + self.capacity], len(ids)), self.sequences, 0
            self.sequences += 1
        if whole < len(ids):
            self.waiting.append((doc, whole, ids[whole:], len(ids)))
            self.tokens += len(ids) - whole
            if self.tokens >= self.pool * self.capacity:
                yield from self.pack(self.tokens // self.capacity)

    def end(self) -> Iterator[tuple[Piece, int, int]]:
        if self.tokens:
            yield from self.pack(-(-self.tokens // self.capacity))

    def pack(self, n: int) -> Iterator[tuple[Piece, int, int]]:
        """Fill ``n`` sequences; what is left over waits."""
        room, cost = np.full(n, self.capacity), np.zeros(n)
        at = np.zeros(n, np.int64)
        rest: list[Piece] = []

        def put(piece: Piece, k: int) -> tuple[Piece, int, int]:
            size = len(piece[2])
            offset = int(at[k])
            at[k] += size
            room[k] -= size
            cost[k] += size + QUADRATIC * size * size
            return piece, self.sequences + k, offset

        for piece in sorted(self.waiting, key=lambda p: -len(p[2])):
            fits = room >= len(piece[2])
            if fits.any():
                yield put(piece, int(np.where(fits, cost, np.inf).argmin()))
            else:
                rest.append(piece)
        self.waiting = []
        for doc, before, ids, total in rest:
            while len(ids) and (k := int(room.argmax())) >= 0 and room[k]:
                size = min(len(ids), int(room[k]))
                yield put((doc, before, ids[:size], total), k)
                before, ids = before + size, ids[size:]
            if len(ids):
                self.waiting.append((doc, before, ids, total))
        self.tokens = sum(len(p[2]) for p in self.waiting)
        self.sequences += n


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids themselves.  Sequence ids are unique over all tasks."""
    whole_number(docs, id_col)
    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["ids"] * with_ids
    name = f"packing {tokenizer_path} {special_as_text}"  # a worker's tokenizer and pieces serve its next tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, base = kept(name, lambda: tokenizer_encoder(tokenizer_path, special_as_text)), Packer(capacity), TaskContext.get().partitionId() << 33

        def batch_of(placed: list[tuple[Piece, int, int]]) -> pa.RecordBatch:
            rows = [(doc, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + k, offset) for (doc, before, ids, total), k, offset in placed]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            if with_ids:
                columns.append(pa.array([p[2].astype(np.int32) for p, _, _ in placed], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in slices(batches, limit=CHUNK):
            placed = []
            for doc, ids in zip(batch.column(0).to_pylist(), document_ids(encoder, *valid(*flat(batch.column(1))), end_id), strict=True):
                placed += packer.add(doc, ids)
            if placed:
                yield batch_of(placed)
        if placed := [*packer.end()]:
            yield batch_of(placed)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run, name), SCHEMA + ", ids array<int>" * with_ids)
