"""How operators meet DataFrames: append columns by batch, sample labelled rows, cut lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import released, slices


def append(df: DataFrame, text_col: str, fields: T.StructType, make: Callable[[pa.RecordBatch], list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``fields``, which ``make`` gets from a batch with the text column.

    ``keep`` names the input columns to carry (default: all).  An input column
    that has the name of a field is replaced by it.
    """
    own = {f.name for f in fields}
    carried = [c for c in (df.columns if keep is None else keep) if c not in own]
    used = carried + [text_col] * (text_col not in carried)
    schema = T.StructType([df.schema[c] for c in carried] + list(fields))
    n = len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *make(batch)], names=schema.names)

    return df.select(*used).mapInArrow(released(run), schema)


def filtered(df: DataFrame, text_col: str, mark: Callable[[DataFrame, str], DataFrame], condition: str) -> DataFrame:
    """The rows of ``df`` that meet a condition on the columns that ``mark`` appends; no name of ``df`` can clash with those."""
    names = [f"_column{i}" for i in range(len(df.columns))]
    marked = mark(df.toDF(*names), names[df.columns.index(text_col)])
    return marked.where(condition).select(*names).toDF(*df.columns)


def whole_number(df: DataFrame, column: str) -> None:
    """Ids that are compared and returned as long must be integers."""
    if not isinstance(df.schema[column].dataType, T.IntegralType):
        raise TypeError(f"{column} must be an integer column, not {df.schema[column].dataType.simpleString()}")


def fold(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 5; 0 marks the rows held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def sample_ids(df: DataFrame, id_col: str, columns: list[str], bound: int) -> DataFrame:
    """At most ``bound`` rows of the ids that are not held out, chosen by a hash of the id."""
    return df.where(fold(id_col) != 0).select(id_col, *columns).orderBy(F.xxhash64(id_col), id_col).limit(bound)


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared checkpoint folder, so later stages and lost executors restart from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that ``spark.checkpoint.dir`` names; choose one only where it is unset, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="checkpoints-")
    context.setCheckpointDir(named)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of this application."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
