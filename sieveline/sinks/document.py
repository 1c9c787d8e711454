"""One document made of rows: tasks write its parts, a commit joins them.

Each attempt of a task writes a part of its own name, and only the parts of
attempts that Spark took are joined, so attempts that run twice or end half-way
leave nothing in the document.  The join is one task that copies blocks, and the
document gets its name when it is whole.  Neither rows nor parts pass through the
driver; it knows their names and counts.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import Mounted, Store, files_of

PARTS = "part int, place string, rows long, counts string"


def write_part(files: Mounted | Store, folder: str, rows: Iterator[dict], render: Callable[[dict], str], between: str, count_of: Callable[[dict], str]) -> tuple[str, int, Counter]:
    """Write rows, rendered, to a part of a name that no other attempt has; its place, its rows, and how many of each kind."""
    place, counts, n = f"{folder}/{uuid.uuid4().hex}", Counter(), 0
    with files.create(place) as f:
        for row in rows:
            f.write(((between if n else "") + render(row)).encode("utf-8", "surrogatepass"))
            counts[count_of(row)] += 1
            n += 1
    return place, n, counts


def join_parts(files: Mounted | Store, folder: str, head: str, parts: list[str], between: str, tail: str) -> str:
    """Copy parts end to end, in order; the place of the whole."""
    place = f"{folder}/{uuid.uuid4().hex}"
    with files.create(place) as f:
        f.write(head.encode())
        for k, part in enumerate(parts):
            f.write(between.encode() if k else b"")
            for block in files.blocks(part):
                f.write(block)
        f.write(tail.encode())
    return place


def write_document(rows: DataFrame, path: str, head: str, render: Callable[[dict], str], between: str, tail: Callable[[Counter], str], count_of: Callable[[dict], str] = lambda row: "") -> None:
    """Write ``rows``, in their order, as one document: head, rendered rows, tail (of the counts by ``count_of``)."""
    spark = rows.sparkSession
    files, target = files_of(spark, path)
    folder = f"{target}.parts-{uuid.uuid4().hex}"

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (t for b in batches for t in b.column(0).to_pylist())
        place, n, counts = write_part(files, folder, map(json.loads, texts), render, between, count_of)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([place]), pa.array([n]), pa.array([json.dumps(counts)])], names=["part", "place", "rows", "counts"])

    try:
        written = rows.select(F.to_json(F.struct(*rows.columns))).mapInArrow(parts, PARTS).collect()  # a row a task
        written = sorted(r for r in written if r["rows"])
        total: Counter[str] = Counter()
        for r in written:
            total.update(json.loads(r["counts"]))
        places, end = [r["place"] for r in written], tail(total)

        def join(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([join_parts(files, folder, head, places, between, end)])], names=["place"])

        whole = spark.range(1).coalesce(1).mapInArrow(join, "place string").first()["place"]
        files.rename(whole, target)
    finally:
        files.remove(folder)
