"""Quarantine: files leave their place for a folder that keeps them, each beside a note of its origin; on any store.

``quarantine_results`` first writes down what is to be moved where, as a table of
intents in which every file has a place of its own.  Tasks then carry the intents
out: a file is copied under a name of the attempt, and only when the copy has the
hash that the scan found does it get its place, does its note, and does the source
go.  Each step may be done again, or by two attempts at once, with the same end:
what is at a place always has the content that was planned for it.  What happened is
a table too, and once that is committed the intent is closed; ``resume`` carries out
those that are not.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..sources.files import Mounted, Store, drop, files_of, is_mounted, local_path
from .reports import utc_now

READ_ONLY = 0o444
BANDS = ("High",)
INTENT = T.StructType([T.StructField(c, T.StringType()) for c in ("path", "stored", "sha256")])
MOVED = T.StructType([*INTENT.fields, T.StructField("error", T.StringType())])
#: Where intents and what became of them are, below the folder.
INTENTS = ".intents"
#: Files that one task moves, at most.
MOVES_A_TASK = 1024


def fingerprint(files: Mounted | Store, path: str) -> str:
    digest = hashlib.sha256()
    for block in files.blocks(path):
        digest.update(block)
    return digest.hexdigest()


def note_of(place: str) -> str:
    return f"{place}.meta.json"


def move(source_files: Mounted | Store, source: str, files: Mounted | Store, place: str, sha256: str) -> None:
    """Move a file to its place, unless that has been done."""
    incoming, digest = f"{place}.incoming-{uuid.uuid4().hex}", hashlib.sha256()
    try:
        with files.create(incoming) as copy:
            for block in source_files.blocks(source):
                digest.update(block)
                copy.write(block)
            if isinstance(files, Mounted):
                copy.flush()
                os.fsync(copy.fileno())
        if digest.hexdigest() != sha256:
            raise ValueError(f"{source} has changed since it was scanned")
        if fingerprint(files, incoming) != sha256:
            raise OSError(f"the copy of {source} differs from it")
        if isinstance(files, Mounted):
            os.chmod(incoming, READ_ONLY)
        if not files.exists(note_of(place)):
            files.write(note_of(place), json.dumps({"original_path": source, "quarantined_at": utc_now(), "sha256": sha256}, indent=2).encode())
        files.rename(incoming, place)
    except FileNotFoundError:
        if source_files.exists(source) or not files.exists(place) or fingerprint(files, place) != sha256:
            raise
        return  # another attempt has moved it
    finally:
        with contextlib.suppress(OSError):
            if files.exists(incoming):
                files.remove(incoming)
    source_files.remove(source)


def other_name(name: str, mark: str) -> str:
    """A name with a mark before its endings."""
    stem, dot, ending = name.partition(".")
    return f"{stem}-{mark}{dot}{ending}"


def isolate(source: str, folder: str) -> str:
    """Move one file of the local tree; its new place."""
    files, name = Mounted(), os.path.basename(source)
    sha256 = fingerprint(files, source)
    own = name
    while os.path.exists(os.path.join(folder, own)) or os.path.exists(note_of(os.path.join(folder, own))):
        own = other_name(name, sha256[:12] if own == name else uuid.uuid4().hex[:12])
    move(files, source, files, os.path.join(folder, own), sha256)
    return os.path.join(folder, own)


def quarantine(path: str, folder: str) -> list[str]:
    """One file, or the files directly in a folder; their new places."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    sources = sorted(e.path for e in os.scandir(path) if e.is_file()) if os.path.isdir(path) else [path]
    return [isolate(s, folder) for s in sources]


def intents(results: DataFrame, folder: str, bands: Sequence[str], mark: str) -> DataFrame:
    """(path, stored, sha256): of the files of one name, the first keeps it, unless one in the folder has it; the others get a mark of their own."""
    spark = results.sparkSession
    files, place = files_of(spark, folder)
    chosen = results.where(F.col("severity").isin(*bands) & (F.col("sha256") != "")).groupBy("path").agg(F.min("sha256").alias("sha256")).withColumn("name", C.file_name(F.col("path")))
    # it is read twice below, and results may be a scan of all files
    found = f"{place.rstrip('/')}/{INTENTS}/{mark}/chosen"
    chosen.write.parquet(found)
    chosen = spark.read.schema(chosen.schema).parquet(found)
    first = chosen.groupBy("name").agg(F.min("path").alias("first"))

    def names() -> Iterator[str]:
        with contextlib.suppress(OSError):
            for e in files.entries(place):
                yield e.path.rpartition("/")[2].removesuffix(".meta.json")

    def held(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(list(names()), pa.string())], names=["name"])

    taken = spark.range(1).coalesce(1).mapInArrow(held, "name string").distinct().withColumn("taken", F.lit(True))
    own = F.substring(F.sha2(F.concat(F.lit(mark), "path"), 256), 1, 12)
    marked = F.regexp_replace("name", r"(?s)\A([^.]*)(.*)\z", F.concat(F.lit("$1-"), own, F.lit("$2")))
    rows = chosen.join(first, "name").join(taken, "name", "left")
    keeps = (F.col("path") == F.col("first")) & F.col("taken").isNull()
    return rows.select("path", F.concat(F.lit(f"{place.rstrip('/')}/"), F.when(keeps, F.col("name")).otherwise(marked)).alias("stored"), "sha256")


def carry_out(spark: SparkSession, folder: str, mark: str) -> DataFrame:
    """Move what an intent lists; a row per file with its place, or why it stayed."""
    files, place = files_of(spark, folder)
    work = f"{place.rstrip('/')}/{INTENTS}/{mark}"
    plan = spark.read.schema(INTENT).parquet(f"{work}/plan")
    stores: dict[bool, Mounted | Store] = {True: Mounted()}
    if remote := plan.where(r"path rlike '^[A-Za-z][A-Za-z0-9+.-]+:' and not startswith(path, 'file:/')").select("path").first():
        stores[False] = files_of(spark, remote["path"])[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, stored, sha256 in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    mounted = is_mounted(path)
                    move(stores[mounted], local_path(path) if mounted else path, files, stored, sha256)
                    rows.append((path, stored, sha256, None))
                except (OSError, ValueError) as e:
                    rows.append((path, None, sha256, str(e)))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=MOVED.names)

    n = plan.count()
    # a plan is small beside what it moves: its few splits would leave all moves to as few tasks
    tasks = max(1, -(-n // MOVES_A_TASK), min(n, spark.sparkContext.defaultParallelism))
    plan.repartition(tasks, "path").mapInArrow(run, MOVED).write.mode("overwrite").parquet(f"{work}/done")
    return spark.read.schema(MOVED).parquet(f"{work}/done")


def quarantine_results(results: DataFrame, folder: str, bands: Sequence[str] = BANDS) -> DataFrame:
    """Move the files of results that have one of the bands; a row per file with its place, or why it stayed.

    Sources and folder must be reachable by all executors.
    """
    spark, mark = results.sparkSession, uuid.uuid4().hex
    _, place = files_of(spark, folder)
    work = f"{place.rstrip('/')}/{INTENTS}/{mark}"
    intents(results, folder, bands, mark).write.parquet(f"{work}/plan")
    drop(spark, f"{work}/chosen")
    return carry_out(spark, folder, mark)


def unfinished(spark: SparkSession, folder: str) -> list[str]:
    """Intents that were written and not carried out to their end."""
    files, place = files_of(spark, folder)
    try:
        found = [e.path.rpartition("/")[2] for e in files.entries(f"{place.rstrip('/')}/{INTENTS}")]
    except OSError:
        return []
    work = f"{place.rstrip('/')}/{INTENTS}"
    return sorted(m for m in found if files.exists(f"{work}/{m}/plan/_SUCCESS") and not files.exists(f"{work}/{m}/done/_SUCCESS"))


def resume(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Carry out what earlier runs have left undone."""
    return [carry_out(spark, folder, m) for m in unfinished(spark, folder)]
