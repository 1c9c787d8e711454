"""Sources of files under a folder of any store.

``list_files`` finds them as a Spark job a level: folders are a table, tasks list
them and write what they find, and the folders found are dealt out anew for the
next level.  ``read_listed`` reads the files of a listing, and no others, in tasks
cut by bytes; neither passes paths through the driver.  ``read_files`` is the one
after the other.

``file_tree`` is the same for a mounted folder as a data source, listed by the
driver: filters on length, time and path go to the listing, and where a schema
without ``content`` is given (or a limit of -1) no file is opened.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from ..schemas import FILE
from .files import Entry, Mounted, Store, exists, files_of, is_mounted, local_path, shared_folder

__all__ = ["LIST_ONLY", "dealt", "exists", "is_mounted", "list_files", "local_path", "read_files", "read_listed", "read_tree"]

#: Files and bytes of one task, at most (a larger file has a task of its own).
FILES_A_TASK, BYTES_A_TASK = 4096, 128 << 20
#: Folders that a task lists, with those below them, before it hands the rest on to the next level.
FOLDERS_A_TASK = 256
#: A limit under every size: files are listed and none is read.
LIST_ONLY = -1
LISTED = T.StructType([FILE["path"], FILE["modificationTime"], FILE["length"], T.StructField("folder", T.BooleanType())])
TYPES = {"path": pa.string(), "modificationTime": pa.timestamp("us", tz="UTC"), "length": pa.int64(), "content": pa.binary(), "error": pa.string(), "folder": pa.bool_()}


def batch_of(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(v, TYPES[n]) for v, n in zip(columns, names, strict=True)], names=names)


def time_of(e: Entry) -> datetime | None:
    return datetime.fromtimestamp(e.changed, UTC) if e.changed else None


def file_row(files: Mounted | Store, path: str, limit: int) -> tuple:
    """One file's row; over the limit it is not opened, and what fails is told in ``error``."""
    changed = None
    try:
        own = files.stat(path)
        changed = time_of(own)
        content = files.read(path) if own.length <= limit else None
        return path, changed, own.length, content, None
    except OSError as e:
        return path, changed, 0, None, str(e)


# The listing as Spark jobs.


def _lister(files: Mounted | Store, at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[str] = []
        for batch in batches:
            waiting += batch.column(0).to_pylist()
        listed, rows = 0, []
        for folder in waiting:  # grows meanwhile
            if listed >= at_once:
                rows.append((folder, None, 0, True))
            else:
                listed += 1
                try:
                    for e in files.entries(folder):
                        if e.is_folder:
                            waiting.append(e.path)
                        else:
                            rows.append((e.path, time_of(e), e.length, False))
                except OSError:  # an unreadable folder is skipped
                    pass
            if len(rows) >= FILES_A_TASK:
                yield batch_of(LISTED.names, rows)
                rows = []
        yield batch_of(LISTED.names, rows)

    return run


def list_files(spark: SparkSession, path: str, at_once: int = FOLDERS_A_TASK) -> DataFrame:
    """(path, modificationTime, length) of all files under a folder, hidden ones too.  A file is itself.

    What the levels found is kept in tables of the shared folder.
    """
    files, root = files_of(spark, path)
    try:
        own = files.stat(root)
    except OSError:
        own = None
    if own is None or not own.is_folder:
        rows = [] if own is None else [(root, time_of(own), own.length)]
        return spark.createDataFrame(rows, T.StructType(LISTED.fields[:3]))
    folder, tables = f"{shared_folder(spark)}/listing-{uuid.uuid4().hex}", []
    # the top is one folder: until there are more, it goes down by itself
    level = spark.createDataFrame([(root,)], "path string").coalesce(1)
    while True:
        tables.append(f"{folder}/{len(tables)}")
        level.mapInArrow(_lister(files, at_once), LISTED).write.parquet(tables[-1])
        below = spark.read.schema(LISTED).parquet(tables[-1]).where("folder").select("path")
        n = below.count()
        if not n:
            break
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        level = below.repartition(min(n, tasks), "path")
    return spark.read.schema(LISTED).parquet(*tables).where("not folder").drop("folder")


def dealt(listing: DataFrame, max_file_size: int) -> DataFrame:
    """The paths of a listing (path, length), dealt out to tasks by the bytes that are to be read."""
    sizes = F.when(F.col("length") <= max_file_size, F.col("length")).otherwise(0)
    n, size = listing.agg(F.count("*"), F.coalesce(F.sum(sizes), F.lit(0))).first()
    tasks = max(1, -(-n // FILES_A_TASK), -(-size // BYTES_A_TASK), min(n, listing.sparkSession.sparkContext.defaultParallelism))
    return listing.select("path").repartition(tasks, "path")


def read_listed(listing: DataFrame, path: str, max_file_size: int) -> DataFrame:
    """(path, modificationTime, length, content, error) of the files of a listing (path, length) of ``path``; contents over the limit are not read."""
    files, _ = files_of(listing.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():  # a batch a file: contents may be large
                yield batch_of(FILE.names, [file_row(files, name, max_file_size)])

    return dealt(listing, max_file_size).mapInArrow(run, FILE)


def read_files(spark: SparkSession, path: str, max_file_size: int) -> DataFrame:
    """(path, modificationTime, length, content, error) of the files under a path of any scheme."""
    listing = list_files(spark, path)
    if max_file_size == LIST_ONLY:
        return listing.select("*", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))
    return read_listed(listing, path, max_file_size)


# The data source.


class Bounds:
    """What the filters that were pushed ask of an entry."""

    def __init__(self) -> None:
        self.prefixes: list[str] = []
        self.names: set[str] | None = None
        self.tests: list[tuple[str, str, object]] = []

    def take(self, f: Filter) -> bool:
        """Whether a filter is taken over."""
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if isinstance(f, IsNotNull) and column in ("path", "length"):
            return True  # they never are
        if column == "path":
            if isinstance(f, StringStartsWith):
                self.prefixes.append(f.value)
                return True
            if isinstance(f, (EqualTo, In)):
                own = set(f.value if isinstance(f, In) else [f.value])
                self.names = own if self.names is None else self.names & own
                return True
        for kind, name in ((EqualTo, "__eq__"), (LessThan, "__lt__"), (LessThanOrEqual, "__le__"), (GreaterThan, "__gt__"), (GreaterThanOrEqual, "__ge__")):
            if isinstance(f, kind) and column in ("length", "modificationTime"):
                self.tests.append((column, name, f.value))
                return True
        return False

    def reach(self, folder: str) -> bool:
        """Whether a folder can hold what is asked for."""
        inside = folder.rstrip("/") + "/"
        under = lambda wanted: wanted.startswith(inside) or inside.startswith(wanted)
        return all(map(under, self.prefixes)) and (self.names is None or any(n.startswith(inside) for n in self.names))

    def fit(self, e: Entry) -> bool:
        values = {"length": e.length, "modificationTime": time_of(e)}
        named = all(map(e.path.startswith, self.prefixes)) and (self.names is None or e.path in self.names)
        return named and all(values[column] is not None and getattr(values[column], test)(comparable(value)) is True for column, test, value in self.tests)


def comparable(value: object) -> object:
    """Times of a filter without a zone are of the session that is read in, as Spark's are."""
    return value.astimezone(UTC) if isinstance(value, datetime) else value


class Paths(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.root, self.names, self.bounds = options["path"], schema.names, Bounds()
        self.limit = int(options.get("maxfilesize", str(1 << 62))) if "content" in schema.names else LIST_ONLY

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.bounds.take(f)]

    def listed(self) -> Iterator[Entry]:
        files = Mounted()
        if os.path.isfile(self.root):
            yield files.stat(self.root)
            return
        waiting = [self.root]
        while waiting:
            try:
                for e in files.entries(waiting.pop()):
                    if not e.is_folder:
                        yield e
                    elif self.bounds.reach(e.path):
                        waiting.append(e.path)
            except OSError:  # an unreadable folder is skipped
                pass

    def partitions(self) -> list[Paths]:
        out: list[list[str]] = []
        size = 0
        for e in filter(self.bounds.fit, self.listed()):
            own = e.length if self.limit == LIST_ONLY or e.length <= self.limit else 0
            if not out or size + own > BYTES_A_TASK or len(out[-1]) >= FILES_A_TASK:
                out.append([])
                size = 0
            out[-1].append(e.path)
            size += own
        return [Paths(p) for p in out] or [Paths([])]

    def read(self, partition: Paths) -> Iterator[pa.RecordBatch]:
        files, at = Mounted(), [FILE.names.index(n) for n in self.names]
        for path in partition.paths:  # a batch a file: contents may be large
            row = file_row(files, path, self.limit)
            yield batch_of(self.names, [tuple(row[k] for k in at)])


class TreeSource(DataSource):
    """``spark.read.format("file_tree").option("maxFileSize", n).load(folder)``; a given schema may name some of the columns."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> T.StructType:
        return FILE

    def reader(self, schema: T.StructType) -> TreeReader:
        unknown = set(schema.names) - set(FILE.names)
        if unknown:
            raise ValueError(f"file_tree has no column {', '.join(sorted(unknown))}")
        return TreeReader({k.lower(): v for k, v in self.options.items()}, schema)


def read_tree(spark: SparkSession, path: str, max_file_size: int = 1 << 62, columns: list[str] | None = None) -> DataFrame:
    """(path, modificationTime, length, content, error), or some of them, of every file; the folder must be reachable by all executors.

    Turns on Spark's filter pushdown for Python sources in the session.
    """
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    schema = FILE if columns is None else T.StructType([FILE[c] for c in columns])
    return spark.read.format("file_tree").schema(schema).option("maxFileSize", str(max_file_size)).load(local_path(path))
