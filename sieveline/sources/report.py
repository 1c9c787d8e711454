"""Reads reports of earlier runs, of any size, on any store.

A report is one JSON document, an object with one array of objects (``files``).  It
is cut into splits of equal size.  A first pass counts in each split the quotes that
are not escaped, and how much brackets open more than they close, outside strings
and inside of them, as it is not known yet which of the two a split begins in.  Sums
over the splits before tell that and the depth at which each begins; a second pass
takes every object that begins in a split at the depth of the array's elements, to
its end in a later split if need be.  A task holds a split and one element.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import REPORT, RESULT
from .files import Mounted, Store, files_of
from .tree import list_files

#: Bytes of a split.
SPLIT = 8 << 20
#: The depth of an element: inside the document's object and its array.
ELEMENT = 2
QUOTE, ESCAPE = ord('"'), ord("\\")
STEP = np.zeros(256, np.int8)
STEP[[ord("{"), ord("[")]], STEP[[ord("}"), ord("]")]] = 1, -1


def files_in(report: Column) -> Column:
    """The files of a report's text, one result each; null for what is no report."""
    return F.from_json(report, REPORT)["files"]


def taken(files: Mounted | Store, path: str, begin: int, size: int) -> tuple[np.ndarray, int]:
    """Bytes of a file, and how many escapes stand right before them."""
    with files.seekable(path) as f:
        escapes, back = 0, begin
        while back:
            n = min(back, 64)
            f.seek(back - n)
            before = f.read(n)
            own = n - len(before.rstrip(b"\\"))
            escapes, back = escapes + own, back - n
            if own < n:
                break
        f.seek(begin)
        return np.frombuffer(f.read(size), np.uint8), escapes


def quoted(data: np.ndarray, escapes: int) -> np.ndarray:
    """Where quotes are that begin or end a string."""
    at = np.flatnonzero(data == QUOTE)
    if not len(at):
        return at
    last = np.maximum.accumulate(np.where(data != ESCAPE, np.arange(len(data)), -1))  # the last byte so far that is no escape
    before = np.where(at > 0, last[at - 1], -1)
    run = at - 1 - before + np.where(before < 0, escapes, 0)
    return at[run % 2 == 0]


def steps(data: np.ndarray, escapes: int, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the brackets outside strings, by how much each changes the depth, and whether a string is open at the end."""
    quotes = quoted(data, escapes)
    at = np.flatnonzero(STEP[data])
    open_ = (np.searchsorted(quotes, at) + inside) % 2 == 0
    return at[open_], STEP[data[at[open_]]].astype(np.int64), bool((len(quotes) + inside) % 2)


def _summary(files: Mounted | Store):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, begin, end in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data, escapes = taken(files, path, begin, end - begin)
                (_, out, odd), (_, in_, _) = (steps(data, escapes, inside) for inside in (False, True))
                rows.append((path, begin, end, int(odd), int(out.sum()), int(in_.sum())))
            kinds = (pa.string(), *[pa.int64()] * 5)
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "begin", "end", "odd", "outside", "inside"])

    return run


def elements(files: Mounted | Store, path: str, begin: int, end: int, inside: bool, depth: int, split: int) -> Iterator[bytes]:
    """The elements that begin in a split."""
    data, escapes = taken(files, path, begin, end - begin)
    at, change, inside = steps(data, escapes, inside)
    after = depth + np.cumsum(change)
    first, last = at[(change > 0) & (after == ELEMENT + 1) & (data[at] == ord("{"))], at[(change < 0) & (after == ELEMENT) & (data[at] == ord("}"))]
    if not len(first):
        return
    last = last[np.searchsorted(last, first[0]) :]  # what is before ends an element of an earlier split
    for a, b in zip(first, last, strict=False):
        yield data[a : b + 1].tobytes()
    if len(first) > len(last):
        parts, depth = [data[first[-1] :].tobytes()], int(after[-1])
        while True:
            begin += len(data)
            data, escapes = taken(files, path, begin, split)
            if not len(data):
                return  # the document ends before the element does
            at, change, inside = steps(data, escapes, inside)
            closed = at[depth + np.cumsum(change) == ELEMENT]
            if len(closed):
                yield b"".join([*parts, data[: closed[0] + 1].tobytes()])
                return
            parts.append(data.tobytes())
            depth += int(change.sum())


def _elements(files: Mounted | Store, split: int):
    shape = pa.schema([("path", pa.string()), ("begin", pa.int64()), ("k", pa.int64()), ("element", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin, end, odd, depth in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                held, size = [], 0
                for k, e in enumerate(elements(files, path, begin, end, bool(odd), depth, split)):
                    held.append({"path": path, "begin": begin, "k": k, "element": e.decode("utf-8", "replace")})
                    size += len(e)
                    if size > split:
                        yield pa.RecordBatch.from_pylist(held, shape)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, shape)

    return run


def read_report(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """One row per file of a JSON report (or of the reports in a folder); in its order; fields that it lacks are null, and a report without files has no rows."""
    files, _ = files_of(spark, path)
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("begin")
    splits = list_files(spark, path).where("length > 0").select("path", "length", begin).select("path", "begin", F.least(F.col("begin") + split, "length").alias("end"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = splits.repartition(tasks, "path", "begin").mapInArrow(_summary(files), "path string, begin long, end long, odd long, outside long, inside long")
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    at = found.withColumn("in_string", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    at = at.withColumn("depth", F.coalesce(F.sum(F.when(F.col("in_string") == 1, F.col("inside")).otherwise(F.col("outside"))).over(before), F.lit(0)))
    rows = at.select("path", "begin", "end", "in_string", "depth").repartition(tasks, "path", "begin").mapInArrow(_elements(files, split), "path string, begin long, k long, element string")
    return rows.orderBy("path", "begin", "k").select(F.from_json("element", RESULT).alias("f")).where("f is not null").select("f.*")
