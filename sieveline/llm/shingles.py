"""Sets of word shingles: their hashes, the few of them that similar sets must share, and exact Jaccard similarity.

Two sets of sizes n and m with a similarity of at least NUMERATOR / DENOMINATOR
share, in any fixed order of shingles, one among the first n - ceil(n * similarity)
+ 1 of the one and as many of the other.  The order used here goes by a sketch of
how many texts have a shingle, counted over all texts in a table of fixed size, so
that what very many texts have in common comes last and deals out hardly any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import Prefix, Words, flat, mixed, offsets_of, released, slices

SHINGLE = 5
NUMERATOR, DENOMINATOR = 4, 5
#: Bits of a shingle's hash that choose its counter in the sketch.
SKETCH_BITS = 18
#: Bits of a shingle's hash; the rest of a word tells the texts of a batch apart while they are sorted.
HASH_BITS = 48
HASH_MASK = np.uint64((1 << HASH_BITS) - 1)
MAX_TEXTS = 1 << (64 - HASH_BITS)
#: Compressed bytes of text that are compared at once.
CHUNK = 1 << 18


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, lower-cased, and n + 1 offsets into them.  Fewer words than a shingle are one."""
    n = len(offsets) - 1
    if n > MAX_TEXTS:
        a, b = (shingle_sets(data, o, shingle) for o in (offsets[: n // 2 + 1], offsets[n // 2 :]))
        return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1][1:] + a[1][-1]])
    words = Words(data[offsets[0] : offsets[-1]], offsets - offsets[0])
    n_words = np.diff(words.first)
    counts = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    joined, at = words.join(lower=True)
    first = offsets_of(counts)
    begin = np.arange(first[-1]) + np.repeat(words.first[:-1] - first[:-1], counts)
    h = Prefix(Prefix(joined).of(at, at + words.lengths)).of(begin, begin + np.repeat(np.minimum(n_words, shingle), counts))
    h >>= np.uint64(64 - HASH_BITS)
    h |= np.repeat(np.arange(n, dtype=np.uint64), counts) << np.uint64(HASH_BITS)
    h.sort()
    h = h[np.append(True, h[1:] != h[:-1])] if len(h) else h
    bounds = offsets_of(np.bincount((h >> np.uint64(HASH_BITS)).astype(np.int64), minlength=n))
    return h & HASH_MASK, bounds


def set_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set, equal for equal sets."""
    total = np.append(np.uint64(0), np.cumsum(mixed(h ^ np.uint64(0xA0761D6478BD642F))))
    return mixed(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def shingle_counts(texts: DataFrame, shingle: int) -> np.ndarray:
    """For each value of the first bits of a shingle's hash, in how many texts such shingles are, of ``texts`` (text).

    Tasks send one table each, and tables are added up as a tree.
    """
    bits = SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in slices(batches):
            h, _ = shingle_sets(*flat(batch.column(0)), shingle)
            counts += np.bincount((h >> np.uint64(HASH_BITS - bits)).astype(np.int64), minlength=len(counts))
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], names=["counts"])

    tables = texts.mapInArrow(released(run), "counts binary").rdd.map(lambda row: np.frombuffer(row[0], np.int64))
    return tables.treeAggregate(np.zeros(1 << bits, np.int64), np.add, np.add, depth=3)


def prefixes(h: np.ndarray, bounds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of each set, in their order, and n + 1 offsets into them."""
    n = np.diff(bounds)
    rank = counts[(h >> np.uint64(HASH_BITS - int(len(counts)).bit_length() + 1)).astype(np.int64)]
    taken = np.where(n > 0, n - (n * NUMERATOR + DENOMINATOR - 1) // DENOMINATOR + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((rank, text))  # hashes are in order within a set already
    return h[order[np.arange(len(h)) - bounds[text] < taken[text]]], offsets_of(taken)


def near(n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the sizes of two sets, and the places of a shingle in both, allow for the similarity."""
    sizes = np.minimum(n, m) * DENOMINATOR >= np.maximum(n, m) * NUMERATOR
    return sizes & ((np.minimum(i, j) + np.minimum(n - i, m - j)) * (NUMERATOR + DENOMINATOR) >= (n + m) * NUMERATOR)


def similar(shingle: int):
    """Of batches (u, v, left, right) with compressed texts, the pairs (u, v) whose sets are similar."""

    def sets(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        expand = zstandard.ZstdDecompressor().decompress
        texts = [expand(b) for b in bodies]
        return shingle_sets(np.frombuffer(b"".join(texts), np.uint8), offsets_of(np.array([len(t) for t in texts], np.int64)), shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "right", CHUNK):
            _, first, which = np.unique(batch.column(0).to_numpy(), return_index=True, return_inverse=True)
            left, lb = sets(batch.column(2).take(pa.array(first)).to_pylist())
            right, rb = sets(batch.column(3).to_pylist())
            n, m = np.diff(lb)[which], np.diff(rb)
            pair = np.repeat(np.arange(len(n)), n)
            mine = left[np.arange(len(pair)) + np.repeat(lb[which] - offsets_of(n)[:-1], n)]
            same = np.zeros(len(n), np.int64)
            for low in range(0, len(n), MAX_TEXTS):
                own, other = (pair >= low) & (pair < low + MAX_TEXTS), np.repeat(np.arange(len(m)), m)
                other_own = (other >= low) & (other < low + MAX_TEXTS)
                theirs = (other[other_own] - low).astype(np.uint64) << np.uint64(HASH_BITS) | right[other_own]
                keys = (pair[own] - low).astype(np.uint64) << np.uint64(HASH_BITS) | mine[own]
                at = np.minimum(np.searchsorted(theirs, keys), max(len(theirs) - 1, 0))
                hit = theirs[at] == keys if len(theirs) else np.zeros(len(keys), bool)
                same += np.bincount(pair[own][hit], minlength=len(n))
            yield batch.select([0, 1]).filter(pa.array(same * DENOMINATOR >= (n + m - same) * NUMERATOR))

    return released(run)
