"""What each of five text filters removes, alone and after others, in every order in which they can be applied.

Rows are routed as an RDD by the XXH64 fingerprint of their text, each partition
sorted by fingerprint and id (a sort that spills).  A fingerprint's collision
chain holds every different text of it, whole, with its smallest id; a row whose
id is above that one is a non-minimum and fails the duplicate filter.  A row then
is a mask of the filters that it fails.  ``combineByKey`` merges the mask count
vectors of each part (three counts for each of 32 masks); all orders and steps
are sums over such a vector.

Before rows are routed, a task combines them: of the texts in a bounded cache
only the row with the smallest id is routed with its text, the others are known
to be non-minimum and go wherever their id hashes to.  So a text that a third of
all rows share comes to its chain about once a task.

Defined results: a null text is an empty one; a null part is the part ''; a row
with a null id fails no duplicate filter and makes no other row fail it; a
repeated row (same id, same text) is counted again and is no duplicate of itself;
labels of one id in several rows count once, if any says so; an empty table gives
no rows; a text of any length is held whole, one chain at a time; bytes that are
no UTF-8 are compared as they are and continuation bytes are no code points;
columns of other names, or of names used here, are not looked at.
"""

from __future__ import annotations

from collections import Counter, OrderedDict
from collections.abc import Iterator
from functools import partial
from itertools import permutations

import numpy as np
import xxhash
import zstandard
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut, whole_number

FILTERS = "ABCDE"
#: The limits of filters A to C and the characters of D.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
CONTINUATION = bytes(range(0x80, 0xC0))
DUPLICATE = 1 << FILTERS.index("E")
#: Bytes of text that a task keeps to combine rows before they are routed.
CACHE_BYTES = 16 << 20
N_MASKS = 1 << len(FILTERS)
ROWS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(body: bytes) -> int:
    """Which of A to D a text fails, as bits.  ``bytes.split`` parts words at the white space of `[\\x20\\x09-\\x0D]`."""
    words = body.split()
    without = lambda some: len(body.translate(None, some))
    fails = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < DISTINCT_PERCENT * len(words),
        100 * (len(body) - without(CAPITALS)) > CAPITAL_PERCENT * without(CONTINUATION),
        without(SYMBOLS) < len(body),
    )
    return sum(fail << k for k, fail in enumerate(fails))


def spread(n: int | None) -> int:
    return xxhash.xxh64_intdigest(str(n).encode())


def combined(rows: Iterator[tuple], cache_bytes: int = CACHE_BYTES) -> Iterator[tuple]:
    """From (id, text, part) to ((route, id or 0), (text or None, id, mask, counts by part)).

    A record with a text is to be decided by its chain, one without is decided.
    """
    cache: OrderedDict[bytes, list] = OrderedDict()  # text: smallest id, mask, counts of the rows with that id
    held, pack = 0, zstandard.ZstdCompressor(level=1).compress

    def chained(body: bytes, entry: list) -> tuple:
        return (xxhash.xxh64_intdigest(body), entry[0]), (pack(body), *entry)

    def known(i: int | None, mask: int, counts: Counter) -> tuple:
        return (spread(i), i or 0), (None, i, mask, counts)

    for i, text, part in rows:
        body, part = bytes(text or b""), part or ""
        entry = cache.get(body)
        if i is None:
            yield known(None, text_mask(body), Counter({part: 1}))
        elif entry is None:
            cache[body] = [i, text_mask(body), Counter({part: 1})]
            held += len(body)
            while held > cache_bytes and len(cache) > 1:
                old, gone = cache.popitem(last=False)
                held -= len(old)
                yield chained(old, gone)
        else:
            cache.move_to_end(body)
            least, mask, counts = entry
            if i == least:
                counts[part] += 1
            elif i > least:
                yield known(i, mask | DUPLICATE, Counter({part: 1}))
            else:
                yield known(least, mask | DUPLICATE, counts)
                cache[body] = [i, mask, Counter({part: 1})]
    for body, entry in cache.items():
        yield chained(body, entry)


def decided(records: Iterator[tuple]) -> Iterator[tuple]:
    """From records in the order of (fingerprint, id) to (id, part, mask, rows)."""
    unpack = zstandard.ZstdDecompressor().decompress
    fingerprint, chain = None, []  # of the fingerprint: (text, smallest id)
    for (route, _), (packed, i, mask, counts) in records:
        if packed is not None:
            if route != fingerprint:
                fingerprint, chain = route, []
            body = unpack(packed)
            for text, least in chain:
                if text == body:
                    mask |= DUPLICATE * (i > least)
                    break
            else:
                chain.append((body, i))
        for part, n in counts.items():
            yield i, part, mask, n


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> RDD:
    """(id, part, mask, rows): the filters that rows fail, bit k for the k-th of FILTERS."""
    whole_number(docs, id_col)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"), F.col(part_col).cast("string")).rdd
    n = max(rows.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.mapPartitions(partial(combined, cache_bytes=CACHE_BYTES)).repartitionAndSortWithinPartitions(n, partitionFunc=lambda key: key[0]).mapPartitions(decided)


def non_minimum_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of the documents whose text a smaller id has."""
    found = masks(docs.withColumn("_part", F.lit("")), id_col, text_col, "_part")
    return docs.sparkSession.createDataFrame(found.filter(lambda r: r[2] & DUPLICATE).map(lambda r: (r[0],)), f"`{id_col}` long", verifySchema=False)


def labelled(labels: DataFrame, id_col: str) -> DataFrame:
    """One row an id: whether any of its labels says good, or toxic.  Written, so that a join can split what it meets."""
    says = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    return cut(labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(says("quality").alias("good"), says("toxic").alias("toxic")))


def one_vector(value: tuple) -> np.ndarray:
    return with_value(np.zeros((3, N_MASKS), np.int64), value)


def with_value(vector: np.ndarray, value: tuple) -> np.ndarray:
    mask, n, good, toxic = value
    vector[:, mask] += (n, n * good, n * toxic)
    return vector


def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a += b
    return a


def steps(part: str, vector: np.ndarray) -> Iterator[tuple]:
    """The rows of a part: each step of each order."""
    mask = np.arange(N_MASKS)
    count = lambda which, k=0: int(vector[k, which].sum())
    orders, shapley = [], Counter()
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            own = 1 << FILTERS.index(name)
            fails, removed_earlier = mask & own > 0, mask & before > 0
            here = fails & ~removed_earlier
            removed = count(here)
            shapley[name] += removed
            orders.append((name, "".join(order), step, count(~fails & ~removed_earlier), removed, count(fails & removed_earlier), count(mask == own), count(here, 1), count(here, 2)))
            before |= own
    for name, *values in orders:
        yield part, *values, shapley[name]


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step."""
    spark = docs.sparkSession
    rows = spark.createDataFrame(masks(docs, id_col, text_col, part_col), "id long, part string, mask int, n long", verifySchema=False)
    rows = rows.join(labelled(labels, id_col), "id", "left").na.fill(0, ["good", "toxic"])
    counts = rows.rdd.map(lambda r: (r.part, (r.mask, r.n, r.good, r.toxic))).combineByKey(one_vector, with_value, both)
    return spark.createDataFrame(counts.flatMap(lambda kv: steps(*kv)), ROWS, verifySchema=False)
