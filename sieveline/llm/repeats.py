"""Runs of windows that may occur elsewhere: the step that substring and suffix-array dedup share.

Every window of ``window`` symbols (words or bytes) has a smallest k-gram by
hash, its minimizer; equal windows have equal minimizers wherever they stand.  A
document becomes a chain of *segments*, runs of windows with the same minimizer,
about 2 / (window - k + 2) of them a symbol; a longer run than one minimizer can
reach is periodic and is cut, so no segment has more than window - k + 1 windows.
Only segments whose minimizer occurs again can hold a repeated window, so
everything after this step handles those alone.  A segment is (m, c, id, key,
loc): the minimizer's hash, a hash of the segment's whole content, the document's
id and a hash of its text (which tell apart rows with one id), and place, number
of windows and a flag in one long.

What is to be removed comes back as *spans* (start, n, digest) of a document: n
windows from a start, and the BLAKE2 digest of the text at the source coordinates
that the span is said to equal (null where the bytes themselves were compared).
``verified`` compares it with the document's own text before anything is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import Prefix, flat, offsets_of, released, slices, sliding_min

#: Windows that one round of array operations handles; longer texts go block by block.
BLOCK = 1 << 19
LOW = np.uint64(0xFFFFFFFF)
DIGEST_BYTES = 16
SPANS = "id long, key long, start long, n int, digest binary"
SEGMENTS = "m long, c long, id long, key long, loc long"


def pack(start: np.ndarray, n: np.ndarray, again: np.ndarray) -> np.ndarray:
    return start << 22 | n << 1 | again


def unpack(loc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows."""
    return loc >> 22, loc >> 1 & 0x1FFFFF


def minimizer_places(symbols: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each k-gram, and for each window the place of its minimizer.

    The order is by 32 bits of the hash, then by place: equal windows choose alike.
    """
    hashes = Prefix(symbols).windows(k)
    least = sliding_min(hashes & ~LOW | np.arange(len(hashes), dtype=np.uint64), window - k + 1) & LOW
    return hashes, least.astype(np.int64)


def segments(symbols: np.ndarray, offsets: np.ndarray, window: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, windows, minimizer, flag) of the segments of texts end to end; the flag says that the minimizer stands in it twice or more."""
    total = len(symbols) - window + 1
    if total < 1:
        return
    step = np.zeros(len(symbols) + 1, np.int32)  # starts whose window would leave their text
    np.add.at(step, np.maximum(offsets[:-1], offsets[1:] - window + 1), 1)
    np.add.at(step, offsets[1:], -1)
    inside = np.cumsum(step[:total]) == 0
    for at in range(0, total, BLOCK):
        end = min(at + BLOCK, total)
        valid = inside[at:end]
        if not valid.any():
            continue
        hashes, least = minimizer_places(symbols[at : end + window - 1], window, k)
        m = hashes[least]
        fresh = valid & np.append(True, (m[1:] != m[:-1]) | ~valid[:-1])
        starts = np.flatnonzero(fresh)
        last = np.flatnonzero(valid & np.append(fresh[1:] | ~valid[1:], True))
        reach = window - k + 1
        parts = -(-(last - starts + 1) // reach)
        if (parts > 1).any():
            first = offsets_of(parts)
            starts = np.repeat(starts, parts) + (np.arange(first[-1]) - np.repeat(first[:-1], parts)) * reach
            last = np.minimum(starts + reach - 1, np.repeat(last, parts))
        moves = np.append(0, np.cumsum(least[1:] != least[:-1]))
        yield at + starts, last - starts + 1, m[starts], (moves[last] > moves[starts]).astype(np.int64)


Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, bytes, Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray], np.ndarray]]]


def text_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    whole, at = data.tobytes(), offsets.tolist()
    return np.fromiter((xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)), np.uint64, len(at) - 1).view(np.int64)


def segment_table(docs: DataFrame, symbols_of: Symbols, window: int, k: int, seed: int = 0) -> DataFrame:
    """The segments of all documents (columns id, text); ``seed`` is that of the content hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            data, offsets = flat(batch.column(1))
            symbols, bounds, content, first, after = symbols_of(data, offsets)
            keys = text_keys(data, offsets)
            for start, n, m, twice in segments(symbols, bounds, window, k):
                row = np.searchsorted(bounds, start, "right") - 1
                c = np.fromiter((xxhash.xxh3_64_intdigest(content[a:b], seed) for a, b in zip(first(start).tolist(), after(start + n - 1 + window).tolist(), strict=True)), np.uint64, len(start))
                yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(c.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(keys[row]), pa.array(pack(start - bounds[row], n, twice))], names=["m", "c", "id", "key", "loc"])

    return docs.mapInArrow(released(run), SEGMENTS)


def compressed(docs: DataFrame) -> DataFrame:
    """(id, text, ...) as (id, key, body, ...), so that less text is shuffled."""
    rest = docs.columns[2:]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("body", T.BinaryType()), *(docs.schema[c] for c in rest)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1, write_content_size=True, write_checksum=False).compress
        for batch in slices(batches):
            data, offsets = flat(batch.column(1))
            whole, at = data.tobytes(), offsets.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text_keys(data, offsets)), pa.array([squeeze(whole[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), *batch.columns[2:]], names=schema.names)

    return docs.mapInArrow(released(run), schema)


def bodies(column: pa.Array) -> list[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    return [expand(b) for b in column.to_pylist()]


def with_documents(docs: DataFrame, per_document: DataFrame, how: str) -> DataFrame:
    """Compressed documents joined with a table that has one row per (id, key).

    Every join has the filter that Spark would infer for some, so that their shuffles of the documents are one.
    """
    body = compressed(docs).where("key is not null")
    other = per_document.withColumnsRenamed({"id": "_id", "key": "_key"})
    return body.join(other, body["id"].eqNullSafe(other["_id"]) & (body["key"] == other["_key"]), how).drop("_id", "_key")


def per_document(spans: DataFrame) -> DataFrame:
    """Spans gathered by document, which has no more of them than symbols."""
    return spans.distinct().groupBy("id", "key").agg(F.collect_list(F.struct("start", "n", "digest")).alias("spans"))


def lists(column: pa.ListArray) -> tuple[list[int], pa.StructArray]:
    """Where each row's structs start (one more entry), and all structs; a null list is an empty one."""
    return offsets_of(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist(), column.flatten()


class SpanLists:
    """The spans of a batch of documents, by row."""

    def __init__(self, column: pa.ListArray):
        self.bounds, rows = lists(column)
        self.start, self.n = (rows.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        self.digest = rows.field(2).to_pylist()

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
        a, b = self.bounds[i], self.bounds[i + 1]
        return self.start[a:b], self.n[a:b], self.digest[a:b]


def digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=DIGEST_BYTES).digest()


def verified(text: bytes, first: list[int], last: list[int], expected: list[bytes | None]) -> None:
    """Each text[first:last] must have the digest expected of it.

    Two different contents that share the 64-bit hashes of their minimizers and
    of themselves end the job here; another ``seed`` parts them.
    """
    for a, b, want in zip(first, last, expected, strict=True):
        if want is not None and digest(text[a:b]) != want:
            raise ValueError("different contents have equal hashes: run again with another seed")


def marked_windows(start: np.ndarray, n: np.ndarray, total: int) -> np.ndarray:
    """Which of the windows of a document lie in a span."""
    step = np.zeros(total + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, start + n, -1)
    return np.cumsum(step[:-1]) > 0


def widened(marked: np.ndarray, window: int, total: int) -> np.ndarray:
    """Which of ``total`` symbols lie in a marked window."""
    step = np.zeros(total + 1, np.int32)
    starts = np.flatnonzero(marked)
    step[starts] += 1
    step[starts + window] -= 1
    return np.cumsum(step[:-1]) > 0
