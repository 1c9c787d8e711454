"""Whole-batch text primitives in numpy and Arrow that the operators share.

A batch of texts is one byte array with offsets; words, lines and hashes are
computed for all texts of a batch at once, so that the cost per word is a few
array operations and not a Python loop.  A null text counts as an empty one.
Batches are cut by bytes (``slices``), so memory is bounded by ``CHUNK_BYTES``
or the longest single text, whichever is more.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one round of array operations handles.
CHUNK_BYTES = 1 << 20

#: The white space that ends a word, `[\x20\x09-\x0D]`.
WHITE_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(WHITE_SPACE)] = True


def release() -> None:
    """Give freed memory back to the system: a worker is used again by later stages, beside the JVM of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: What this worker keeps from one task of an operator to the next, by a name; tasks of others drop it.
_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What ``make`` has made in an earlier task of the operator on this worker, or makes now."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def released(run: Callable, keeps: str | None = None) -> Callable:
    """``run``, a function of a task's batches, with ``release`` at its end; of what is kept only ``keeps`` stays."""

    def whole(batches):
        if keeps not in _kept:
            _kept.clear()
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all values end to end, and n + 1 offsets into them."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def valid(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with U+FFFD for what is no UTF-8 (a Parquet file may hold such bytes in a string column)."""
    first = data[offsets[:-1][np.diff(offsets) > 0]]
    whole = data.tobytes()
    try:
        whole.decode("utf-8")
        if not ((first & 0xC0) == 0x80).any():  # else two texts make one character
            return data, offsets
    except UnicodeDecodeError:
        pass
    texts = [whole[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(texts), np.uint8), offsets_of(np.array([len(t) for t in texts], np.int64))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut between rows into pieces of at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def codes(values: pa.Array | np.ndarray) -> tuple[np.ndarray, int]:
    """Equal values get equal numbers from 0; also how many there are."""
    encoded = (pa.array(values) if isinstance(values, np.ndarray) else values).dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(encoded.dictionary)


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a batch of texts.

    ``starts``/``ends`` are byte positions in ``data``, ``doc`` the row of each
    word, ``first`` (n + 1 long) the first word of each row.  ``joined`` is the
    text with the words one space apart; word i is ``joined[at[i] : at[i] +
    lengths[i]]``, so that any run of words of a row is one slice of it.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.solid = solid = ~IS_SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        before = np.empty(len(data), bool)
        after = np.empty(len(data), bool)
        if len(data):
            before[0], after[-1] = False, False
            before[1:], after[:-1] = solid[:-1], solid[1:]
        self.starts = np.flatnonzero(solid & (~before | cut[:-1]))
        self.ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
        self.lengths = self.ends - self.starts
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    def packed(self) -> pa.LargeBinaryArray:
        """The words as an Arrow array."""
        return binary(self.data[self.solid], offsets_of(self.lengths))

    def join(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """``joined`` and ``at``; with ``lower`` A-Z are lower-cased."""
        n = len(self)
        bytes_ = self.data[self.solid]
        if lower:
            bytes_ = np.where((bytes_ >= 65) & (bytes_ <= 90), bytes_ + 32, bytes_)
        joined = np.full(len(bytes_) + n, 32, np.uint8)
        joined[np.arange(len(bytes_)) + np.repeat(np.arange(n), self.lengths)] = bytes_
        return joined, offsets_of(self.lengths)[:-1] + np.arange(n)


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of ``total`` places lie in some [start, start + length)."""
    steps = np.zeros(total + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + length, total), -1)
    return np.cumsum(steps[:-1]) > 0


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each [offsets[i], offsets[i + 1])."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i up to len(x) - w."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


#: Multiplier of the polynomial hashes (odd, so that it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15
_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; the longest so far is kept."""
    for kind, factor in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
        have = _powers[kind]
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(factor, len(have), 1 << 64))])
        _powers[kind] = have
    return _powers["up"][:n], _powers["down"][:n]


class Prefix:
    """Polynomial hashes, modulo 2**64, of any slices of a byte array or of an array of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        values = _TABLE[symbols] if symbols.dtype == np.uint8 else symbols
        up, self.down = powers(len(values) + 1)
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.total[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.total[ends] - self.total[starts]) * self.down[starts]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A mixed hash of each [start, end)."""
        return mixed(self.raw(starts, ends) + (ends - starts).astype(np.uint64))

    def windows(self, length: int) -> np.ndarray:
        """A mixed hash of each [i, i + length)."""
        if len(self.total) <= length:
            return np.zeros(0, np.uint64)
        out = self.total[length:] - self.total[:-length]
        out *= self.down[: len(out)]
        return mixed(out)


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word."""
    ends = np.cumsum(words.lengths)
    return Prefix(words.data[words.solid]).of(ends - words.lengths, ends)


def again(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more.  Sorting values alone is several times faster than sorting with places."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    return np.isin(keys, np.unique(twice)) if len(twice) else np.zeros(len(keys), bool)
