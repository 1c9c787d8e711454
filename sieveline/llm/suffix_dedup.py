"""Suffix-array dedup: windows of bytes that start anywhere else are removed everywhere.

Segments (see ``repeats``) meet by minimizer; equal windows share it, so no group
needs another one's suffixes.  Equal contents of a group are taken once, and all
different ones have their suffixes sorted: prefix polynomial hashes and binary
search find the common extension of two suffixes, so that a comparison takes
logarithmic time; runs are merged bottom-up, all merges of a level in one round
of array operations; the finished order and every claimed match are verified byte
by byte, and an order that a hash collision has spoilt is sorted again by the
bytes themselves.  A window that equals its neighbour in this order is repeated.
A content that occurs again as a whole is repeated; each occurrence is verified
against a digest of the bytes at the source coordinates.

No task sorts more than ``BOUND`` windows of one group.  A larger group is parted
by where the minimizer stands in a window and by the bytes that all windows of
such a part have in common, which equal windows share as well; equal contents of
a part are taken once again (compared as bytes), and what is still too large is
parted more finely, at last by whole windows.

Defined results: a null text is empty; texts shorter than a window stay whole; a
very long text is cut into segments block by block and shortened as a whole, with
about 20 bytes of arrays a byte; rows with null or equal ids count as separate
documents; columns beside id and text, whatever their names, are carried by
``deduplicated`` and not looked at by ``shorten``; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import repeats
from .frames import cut, whole_number
from .textops import Prefix, offsets_of, released

WINDOW = 200
#: Bytes of the k-gram that places a window.
MINIMIZER = 48
#: Windows of one group that are sorted in one task, at most, and windows a task should have.
BOUND, TASK_WINDOWS = 1 << 15, 1 << 19
#: Places of the minimizer in a window that a part has, round by round.
WIDTHS = (64, 16, 4, 1)
#: Bytes of content that are sorted, or handed on, at once.
CHUNK = 1 << 19
#: Bytes that order suffixes before merging, and rows that are verified at once.
LEAD, VERIFY = 16, 1 << 13


def symbols(data: np.ndarray, offsets: np.ndarray):
    return data, offsets, data.tobytes(), lambda i: i, lambda i: i


class SuffixOrder:
    """The suffixes at ``starts``, compared over ``length`` bytes, in order; ``same`` says which equal the one before."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, length: int):
        self.data, self.length = data, length
        self.prefix = Prefix(data)
        keys = np.zeros((2, len(starts)), np.uint64)
        lead = min(LEAD, length)
        for j in range(lead):
            keys[j // 8] = keys[j // 8] << np.uint64(8) | data[starts + j]
        self.lead = lead
        order = np.lexsort(keys[::-1])
        self.starts = starts[order]
        fresh = np.append(True, (keys[:, order][:, 1:] != keys[:, order][:, :-1]).any(0)) if len(starts) else np.zeros(0, bool)
        self.order = order
        self.merge(np.flatnonzero(fresh))
        self.same = self.verify(fresh)

    def alike(self, x: np.ndarray, y: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Whether suffixes agree, by their hashes, in their first n bytes."""
        total, down = self.prefix.total, self.prefix.down
        return (total[x + n] - total[x]) * down[x] == (total[y + n] - total[y]) * down[y]

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The common length of suffixes, by binary search over prefix hashes; whole suffixes are compared first."""
        out = np.full(len(x), self.length)
        differ = np.flatnonzero(~self.alike(x, y, self.length))
        x, y = x[differ], y[differ]
        low, high = np.full(len(x), self.lead), np.full(len(x), self.length)
        for _ in range((self.length - self.lead).bit_length()):
            middle = (low + high + 1) >> 1
            equal = self.alike(x, y, middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        out[differ] = low
        return out

    def before(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before y, or is equal where ``or_equal``."""
        at = self.extension(x, y)
        equal = at >= self.length
        at = np.minimum(at, self.length - 1)
        return np.where(equal, or_equal, self.data[x + at] < self.data[y + at])

    def merge(self, heads: np.ndarray) -> None:
        """Bottom-up mergesort inside each group of equal leading bytes, all groups at once."""
        n = len(self.starts)
        sizes = np.diff(np.append(heads, n))
        live = np.repeat(sizes > 1, sizes)
        where = np.flatnonzero(live)
        head = np.repeat(heads, sizes)[where]
        end = head + np.repeat(sizes, sizes)[where]
        place = where - head
        width, largest = 1, int(sizes.max(initial=0))
        while width < largest:
            run = place // width
            left = run & 1 == 0
            low = np.minimum(head + (run ^ 1) * width, end)
            high = np.minimum(low + width, end)
            begin = low.copy()
            own = self.starts[where]
            open_ = np.flatnonzero(low < high)
            while len(open_):
                middle = (low[open_] + high[open_]) >> 1
                # a suffix of the left run goes before equal ones of the right run
                passed = self.before(self.starts[middle], own[open_], ~left[open_])
                low[open_] = np.where(passed, middle + 1, low[open_])
                high[open_] = np.where(passed, high[open_], middle)
                open_ = open_[low[open_] < high[open_]]
            target = head + (run & ~1) * width + place - run * width + low - begin
            order = self.order[where]
            self.starts[target] = own
            self.order[target] = order
            # places are positions, so they stay; groups that are one run are done
            width *= 2
            keep = end - head > width
            if not keep.all():
                where, head, end, place = where[keep], head[keep], end[keep], place[keep]

    def verify(self, fresh: np.ndarray) -> np.ndarray:
        """Compare neighbours byte by byte; which equal the one before."""
        same = np.zeros(len(self.starts), bool)
        pairs = np.flatnonzero(~fresh)
        span = np.arange(self.length)
        for at in range(0, len(pairs), VERIFY):
            i = pairs[at : at + VERIFY]
            a, b = self.data[self.starts[i - 1][:, None] + span], self.data[self.starts[i][:, None] + span]
            unequal = a != b
            first = unequal.argmax(1)
            rows = np.arange(len(i))
            same[i] = ~unequal[rows, first]
            if (a[rows, first] > b[rows, first]).any():
                return self.by_bytes()
        return same

    def by_bytes(self) -> np.ndarray:
        """After a hash collision: the order by the bytes themselves."""
        held = [self.data[s : s + self.length].tobytes() for s in self.starts.tolist()]
        order = np.array(sorted(range(len(held)), key=held.__getitem__))
        self.starts, self.order = self.starts[order], self.order[order]
        return np.array([False] + [held[a] == held[b] for a, b in zip(order[:-1], order[1:], strict=True)])


def repeated_windows(contents: list[bytes], counts: np.ndarray, window: int) -> np.ndarray:
    """Which windows of contents (content i has counts[i]), one after the other, equal another one."""
    data = np.frombuffer(b"".join(contents), np.uint8)
    base = offsets_of(np.array([len(c) for c in contents]))[:-1]
    first = offsets_of(counts)
    starts = np.repeat(base - first[:-1], counts) + np.arange(first[-1])
    order = SuffixOrder(data, starts, window)
    twice = order.same.copy()
    twice[:-1] |= order.same[1:]
    out = np.zeros(len(starts), bool)
    out[order.order] = twice
    return out


PIECES = "part long, c long, id long, key long, start long, windows int, single boolean, large boolean, content binary, digest binary"
PARTS = "part long, id long, key long, start long, windows int, single boolean, content binary"


def _pieces(window: int):
    """From documents with segments: the contents that are to be sorted, and the digests of those that occur again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PIECES.split(", ")]
        for batch in batches:
            bounds, wanted = repeats.lists(batch.column(3))
            m, c, loc, times, mixed, large = (wanted.field(i).to_pylist() for i in range(6))
            held: list[tuple] = []
            size = 0

            def rows(held: list[tuple]) -> pa.RecordBatch:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

            for row, (doc, key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), repeats.bodies(batch.column(2)), strict=True)):
                for i in range(bounds[row], bounds[row + 1]):
                    start, n = loc[i] >> 22, loc[i] >> 1 & 0x1FFFFF
                    content = text[start : start + n - 1 + window]
                    held.append((m[i], c[i], doc, key, start, n, times[i] == 1, large[i], content if mixed[i] else None, repeats.digest(content) if times[i] > 1 else None))
                    size += len(content)
                    if size >= CHUNK:
                        yield rows(held)
                        held, size = [], 0
            if held:
                yield rows(held)

    return released(run)


def _parted(window: int, k: int, width: int):
    """Contents cut by the place of the minimizer in their windows, ``width`` places to a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part, contents = batch.column(0).to_pylist(), batch.column(5).to_pylist()
            whole = b"".join(contents)
            offsets = offsets_of(np.array([len(c) for c in contents]))
            _, place = repeats.minimizer_places(np.frombuffer(whole, np.uint8), window, k)
            n = np.diff(offsets) - window + 1
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(row)) + np.repeat(offsets[:-1] - offsets_of(n)[:-1], n)
            node = (place[at] - at) // width
            fresh = np.append(True, (row[1:] != row[:-1]) | (node[1:] != node[:-1]) | (place[at][1:] != place[at][:-1]))
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(row)) - 1
            row, begin, end = row[first], at[first], at[last]
            low = node[first] * width
            high = np.minimum(low + width, window - k + 1)
            common = zip(row.tolist(), node[first].tolist(), (place[begin] - low).tolist(), (place[begin] + window + 1 - high).tolist(), strict=True)
            named = [xxhash.xxh3_64_intdigest(b"%d %d " % (part[r], x) + whole[a:b]) for r, x, a, b in common]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.array(named, np.uint64).view(np.int64)), batch.column(1).take(take), batch.column(2).take(take),
                pa.array(np.asarray(batch.column(3))[row] + begin - offsets[row]), pa.array((end - begin + 1).astype(np.int32)), batch.column(4).take(take),
                pa.array([whole[a:b] for a, b in zip(begin.tolist(), (end + window).tolist(), strict=True)], pa.binary()),
            ], names=[f.split()[0] for f in PARTS.split(", ")])

    return released(run)


def _sorted(window: int):
    """From contents in order of their part: the runs of repeated windows of single ones."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        counts = np.array([r[4] for r in rows], np.int64)
        twice = repeated_windows([r[6] for r in rows], counts, window) & np.repeat(np.array([r[5] for r in rows]), counts)
        row = np.repeat(np.arange(len(rows)), counts)
        at = np.arange(len(row)) - np.repeat(offsets_of(counts)[:-1], counts)
        first = np.flatnonzero(twice & np.append(True, ~twice[:-1] | (row[1:] != row[:-1])))
        last = np.flatnonzero(twice & np.append(~twice[1:] | (row[1:] != row[:-1]), True))
        own = [rows[i] for i in row[first].tolist()]
        start = np.array([r[3] for r in own], np.int64) + at[first]
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in own], pa.int64()), pa.array([r[2] for r in own], pa.int64()), pa.array(start), pa.array((last - first + 1).astype(np.int32)), pa.nulls(len(own), pa.binary())], names=["id", "key", "start", "n", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= CHUNK and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield solve(held)

    return released(run)


def sortable(pieces: DataFrame, window: int, k: int, bound: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Contents in parts of at most ``bound`` windows, and the spans that parting has already found to be repeated."""
    names = [f.split()[0] for f in PARTS.split(", ")]
    usual, found = [pieces.where("not large").select(*names)], []
    large = pieces.where("large")
    for width in WIDTHS:
        if large.isEmpty():
            break
        runs = cut(large.select("part", "id", "key", "start", "single", "content").mapInArrow(_parted(window, k, width), PARTS))
        contents = cut(runs.groupBy("part", "content").agg(F.count("*").alias("times"), F.min(F.struct("id", "key", "start", "windows", "single")).alias("one")))
        found.append(runs.where("single").join(contents.where("times > 1").select("part", "content"), ["part", "content"]).select("id", "key", "start", F.col("windows").alias("n"), F.lit(None).cast("binary").alias("digest")))
        different = contents.select("part", "content", "one.id", "one.key", "one.start", "one.windows", (F.col("one.single") & (F.col("times") == 1)).alias("single"))
        groups = cut(different.groupBy("part").agg(F.count("*").alias("kinds"), F.max("single").alias("some"), F.sum("windows").alias("all")).where("kinds > 1 and some").select("part", (F.col("all") > bound).alias("large")))
        parted = cut(different.join(groups, "part"))
        usual.append(parted.where("not large").select(*names))
        large = parted.where("large")
    return usual, found


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = MINIMIZER, bound: int = BOUND, seed: int = 0) -> DataFrame:
    """(id, key, spans) of the documents (id, text) that have repeated windows."""
    table = repeats.segment_table(docs, symbols, window, k, seed)
    # small sides are cut before they are joined, so that the shuffles that meet can be split where a key is hot
    met = cut(table.groupBy("m").agg(F.count("*").alias("n"), F.max(F.col("loc").bitwiseAND(1)).alias("twice")).where("n > 1 or twice = 1").select("m"))
    met = cut(table.join(met, "m"))
    contents = cut(met.groupBy("m", "c").agg(F.count("*").alias("n"), F.min(F.struct("id", "key", "loc")).alias("source")))

    windows = F.shiftright("source.loc", 1).bitwiseAND(0x1FFFFF)
    mixed = contents.groupBy("m").agg(F.count("*").alias("kinds"), F.sum((F.col("n") == 1).cast("int")).alias("singles"), F.max(F.col("source.loc").bitwiseAND(1)).alias("twice"), F.sum(windows).alias("windows"))
    mixed = cut(mixed.where("singles > 0 and (kinds > 1 or twice = 1)").select("m", (F.col("windows") > bound).alias("large")))
    wanted = contents.join(mixed, "m", "left").where("n > 1 or large is not null")
    wanted = wanted.groupBy("source.id", "source.key").agg(F.collect_list(F.struct("m", "c", F.col("source.loc").alias("loc"), "n", F.col("large").isNotNull().alias("mixed"), F.coalesce("large", F.lit(False)).alias("large"))).alias("wanted"))
    pieces = cut(repeats.with_documents(docs, wanted, "inner").select("id", "key", "body", "wanted").mapInArrow(_pieces(window), PIECES))

    again = pieces.where("digest is not null").select(F.col("part").alias("m"), "c", "digest")
    whole = met.join(again, ["m", "c"]).select("id", "key", F.shiftright("loc", 22).alias("start"), F.shiftright("loc", 1).bitwiseAND(0x1FFFFF).cast("int").alias("n"), "digest")
    usual, spans = sortable(pieces.where("content is not null"), window, k, bound)
    meeting = usual[0]
    for more in usual[1:]:
        meeting = meeting.union(more)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (meeting.agg(F.sum("windows")).first()[0] or 0) // TASK_WINDOWS)
    spans = [whole, meeting.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_sorted(window), repeats.SPANS), *spans]
    union = spans[0]
    for more in spans[1:]:
        union = union.union(more)
    return repeats.per_document(union)


FIELDS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _shorten(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans = [], repeats.SpanLists(batch.column(2))
            for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), repeats.bodies(batch.column(1)), strict=True)):
                kept, removed, runs = text, 0, 0
                start, n, digests = spans.row(i)
                if len(start):
                    repeats.verified(text, start.tolist(), (start + n - 1 + window).tolist(), digests)
                    gone = repeats.widened(repeats.marked_windows(start, n, len(text) - window + 1), window, len(text))
                    removed, runs = int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum())
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((doc, len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            arrays = [pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_text], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    return released(run)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, bound: int = BOUND, seed: int = 0) -> DataFrame:
    """``docs`` with the kept text; what is left of a character that lost a byte is dropped.  Ids may be of any type."""
    own_id = F.col(id_col).cast("long") if isinstance(docs.schema[id_col].dataType, T.IntegralType) else F.xxhash64(id_col)
    own = docs.select(own_id.alias("id"), F.col(text_col).alias("text"), F.struct(*docs.columns).dropFields(text_col).alias("rest") if len(docs.columns) > 1 else F.struct(F.lit(1).alias("_")).alias("rest"))
    joined = repeats.with_documents(own, repeated_spans(own.select("id", "text"), window, min(MINIMIZER, window), bound, seed), "left").select("id", "body", "spans", "rest")
    schema = T.StructType([T.StructField("text", T.StringType()), joined.schema["rest"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (kept,) = _shorten(window, True)(iter([batch]))
            texts = [b.decode("utf-8", "ignore") for b in kept.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(3)], names=["text", "rest"])

    return joined.mapInArrow(run, schema).select(*(F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns))


def shorten(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False, bound: int = BOUND, seed: int = 0) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs and the hash of the kept bytes; ``with_text`` adds those bytes."""
    whole_number(docs, id_col)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    joined = repeats.with_documents(own, repeated_spans(own, window, min(MINIMIZER, window), bound, seed), "left")
    return joined.select("id", "body", "spans").mapInArrow(_shorten(window, with_text), FIELDS + ", kept binary" * with_text)
