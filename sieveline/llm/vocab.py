"""Texts to ids through a vocabulary of pieces of text: every distinct piece of a batch is encoded once.

A batch is cut into pieces whose encodings do not depend on each other; the
distinct ones are looked up in a bounded cache (ids as 32-bit bytes), the missing ones encoded, and
the ids of the whole batch gathered with array operations.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable
from itertools import islice

import numpy as np

from .textops import binary, offsets_of

#: Pieces that a worker keeps.
CACHE_ENTRIES = 200_000
#: Longer pieces are not kept.
CACHE_BYTES = 64


class Encoder:
    """``encode`` takes a list of distinct pieces (bytes) and returns a list of id lists."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]]):
        self.encode, self.cache = encode, {}

    def ids(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and where each piece's ids start (one more entry).

        The pieces tile ``data``; ``starts`` are their first bytes.
        """
        encoded = binary(data, np.append(starts, len(data))).dictionary_encode()
        index = encoded.indices.to_numpy(zero_copy_only=False)
        pieces = encoded.dictionary.to_pylist()
        cache = self.cache
        missing = [p for p in pieces if p not in cache]
        fresh = {p: array("I", ids).tobytes() for p, ids in zip(missing, self.encode(missing), strict=True)} if missing else {}
        found = [cache[p] if p in cache else fresh[p] for p in pieces]
        if room := CACHE_ENTRIES - len(cache):  # common pieces come early, so a full cache stays as it is
            cache.update((p, x) for p, x in islice(fresh.items(), room) if len(p) <= CACHE_BYTES)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        own = offsets_of(lengths)
        flat = np.frombuffer(b"".join(found), np.uint32)
        offsets = offsets_of(lengths[index])
        return flat[np.arange(offsets[-1]) + np.repeat(own[index] - offsets[:-1], lengths[index])], offsets
