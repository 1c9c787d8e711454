"""What changed under a folder, as a log of generations, and the log as a streaming source.

``ChangeLog.record`` compares a listing with what is known and appends what is new
or changed as the next generation.  The known files are runs of (path,
modificationTime, generation), of which the newest row of a path counts; a run is
merged with the one before it when it has grown to half its size, so a generation
of few changes writes few rows, and each row is rewritten a logarithmic number of
times.  A generation exists once its manifest is there, which is written last and
at once; what a torn one has written is not looked at, and goes later.

``file_changes`` reads the log as a stream: an offset is the number of a generation,
a batch all generations between two offsets.  Generations are kept until the stream
has committed them, so any batch can be read again, the same rows each time.

One writer and one stream a log.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..schemas import FILE
from ..sources.files import Mounted, Store, drop, files_of

CHANGES = T.StructType([FILE["path"], FILE["modificationTime"], FILE["length"], T.StructField("generation", T.LongType())])
#: A run is merged with the one before it from this part of its rows on.
MERGE_FROM = 0.5


def changed(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of a listing whose (path, modificationTime) the state does not have."""
    same = ["path", "modificationTime"]
    return listing.join(state.select(*same), [listing[c].eqNullSafe(state[c]) for c in same], "left_anti")


def merged(state: DataFrame, seen: DataFrame) -> DataFrame:
    """The state with the newest time of each path; paths that are gone stay."""
    return state.unionByName(seen.select("path", "modificationTime")).groupBy("path").agg(F.max("modificationTime").alias("modificationTime"))


def latest(rows: DataFrame) -> DataFrame:
    """The newest row of each path."""
    newest = F.max(F.struct("generation", "modificationTime")).alias("newest")
    return rows.groupBy("path").agg(newest).select("path", "newest.modificationTime", "newest.generation")


def manifests(files: Mounted | Store, folder: str) -> list[str]:
    """The manifests of a log, in the order of their generations."""
    try:
        return sorted(e.path for e in files.entries(f"{folder}/manifests") if e.path.endswith(".json"))
    except OSError:
        return []


def last_manifest(files: Mounted | Store, folder: str) -> dict:
    found = manifests(files, folder)
    return json.loads(files.read(found[-1])) if found else {"generation": 0, "runs": [], "changes": {}}


def committed(files: Mounted | Store, folder: str) -> int:
    """The generation up to which the stream needs nothing any more."""
    try:
        return json.loads(files.read(f"{folder}/committed.json"))["generation"]
    except OSError:
        return 0


class ChangeLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.files, self.folder = files_of(spark, folder)

    def _rows(self, runs: list) -> DataFrame:
        schema = CHANGES
        return self.spark.read.schema(schema).parquet(*(r[0] for r in runs)) if runs else self.spark.createDataFrame([], schema)

    def state(self) -> DataFrame:
        """(path, modificationTime, generation): what is known of each path, also of paths that are gone."""
        runs = last_manifest(self.files, self.folder)["runs"]
        return latest(self._rows(runs)) if len(runs) != 1 else self._rows(runs).select("path", "modificationTime", "generation")

    def changes(self, generation: int) -> DataFrame:
        return self._rows([[last_manifest(self.files, self.folder)["changes"][str(generation)]]])

    def _write(self, rows: DataFrame, kind: str) -> list:
        """A new run: its place and its rows."""
        place = f"{self.folder}/{kind}/{uuid.uuid4().hex}"
        rows.write.parquet(place)
        return [place, self.spark.read.parquet(place).count()]

    def record(self, listing: DataFrame) -> int:
        """Append what is new or changed in a listing (path, modificationTime, length); how many files that is."""
        m = last_manifest(self.files, self.folder)
        generation = m["generation"] + 1
        new = self._write(changed(listing, self.state()).select("path", "modificationTime", "length", F.lit(generation).cast("long").alias("generation")), "changes")
        if not new[1]:
            drop(self.spark, new[0])
            return 0
        runs, unused = [*m["runs"], new], []
        while len(runs) > 1 and runs[-1][1] >= MERGE_FROM * runs[-2][1]:
            pair = runs[-2:]
            unused += [r[0] for r in pair]
            # nothing asks the length of a known file
            runs[-2:] = [self._write(latest(self._rows(pair)).select("path", "modificationTime", F.lit(None).cast("long").alias("length"), "generation"), "runs")]
        done = committed(self.files, self.folder)
        kept = {g: p for g, p in [*m["changes"].items(), (str(generation), new[0])] if int(g) > done}
        unused += [p for g, p in m["changes"].items() if g not in kept]
        self.files.write(f"{self.folder}/manifests/{generation:012d}.json", json.dumps({"generation": generation, "runs": runs, "changes": kept}).encode())
        for old in manifests(self.files, self.folder)[:-1]:
            self.files.remove(old)
        needed = {r[0] for r in runs} | set(kept.values())
        for place in set(unused) - needed:
            drop(self.spark, place)
        return new[1]

    def stream(self) -> DataFrame:
        """The changes as a stream: (path, modificationTime, length, generation)."""
        self.spark.dataSource.register(ChangeSource)
        settings = self.files.settings if isinstance(self.files, Store) else ""
        return self.spark.readStream.format("file_changes").option("settings", settings).load(self.folder)


class Part(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.files = Store(options["settings"]) if options.get("settings") else Mounted()

    def initialOffset(self) -> dict:
        return {"generation": 0}

    def latestOffset(self) -> dict:
        return {"generation": last_manifest(self.files, self.folder)["generation"]}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        """The files of all generations after ``start`` up to ``end``."""
        places = last_manifest(self.files, self.folder)["changes"]
        out = []
        for g in range(start["generation"] + 1, end["generation"] + 1):
            if str(g) not in places:
                raise ValueError(f"generation {g} of {self.folder} has been committed by a stream before")
            out += [Part(e.path) for e in self.files.entries(places[str(g)]) if e.path.endswith(".parquet")]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        table = pq.read_table(io.BytesIO(self.files.read(partition.path)), columns=CHANGES.names)
        times = table.column("modificationTime").cast(pa.timestamp("us"), safe=False).cast(pa.timestamp("us", tz="UTC"))
        yield from table.set_column(1, "modificationTime", times).combine_chunks().to_batches()

    def commit(self, end: dict) -> None:
        self.files.write(f"{self.folder}/committed.json", json.dumps(end).encode())


class ChangeSource(DataSource):
    """``spark.readStream.format("file_changes").load(log_folder)``"""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> T.StructType:
        return CHANGES

    def streamReader(self, schema: T.StructType) -> ChangeReader:
        return ChangeReader({k.lower(): v for k, v in self.options.items()})
