"""Files made from the given tables, so that detectors can be run over them: the same definition that the SQL in ``plans.oracles`` has."""

from __future__ import annotations

import io
import itertools
import operator
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import files_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text, PDF, program and macro files, by doc_id modulo 8."""
    k = F.col("doc_id") % 8
    linked = F.regexp_replace("text", r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})", "http://$1/x")
    body = (
        F.when(k == 2, linked)
        .when(k == 3, F.concat(F.lit("%PDF-1.4 /OpenAction /JavaScript "), F.col("text")))
        .when(k == 4, F.concat(F.lit("%PDF-1.4 /js /EmbeddedFile http://a.example/ "), F.col("text")))
        .when(k == 5, F.concat(F.lit("MZ"), F.col("text")))
        .when(k == 1, F.concat(F.col("text"), F.lit(" powershell")))
        .otherwise(F.col("text"))
    )
    ending = F.when(k <= 2, ".txt").when(k <= 4, ".pdf").when(k == 5, ".pdf.exe").when(k == 6, ".v2.exe").otherwise(".docm")
    name = F.concat("source", F.lit("/doc_"), "doc_id", ending)
    return _files(_table(spark, sf_dir, "documents").select(name.alias("path"), body.alias("body")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages with their address in the first line."""
    rows = _table(spark, sf_dir, "pages")
    return _files(rows.select(F.concat(F.lit("pages/"), "page_id", F.lit(".html")).alias("path"), F.concat("url", F.lit("\n"), "html").alias("body")))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations."""
    rows = _table(spark, sf_dir, "conversations")
    return _files(rows.select(F.concat(F.lit("conv/"), "conv_id", F.lit("/"), "turn", F.lit(".txt")).alias("path"), F.col("text").alias("body")))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents inside PNG and JPEG frames, with what follows the end by doc_id modulo 5."""
    k, text = F.col("doc_id") % 5, F.encode("text", "UTF-8")
    after = F.when(k == 0, F.unhex(F.lit("AE426082"))).when(k == 1, F.unhex(F.lit("00" * 9))).when(k == 2, F.unhex(F.lit("78" * 20))).when(k == 3, F.unhex(F.lit("")))
    rows = _table(spark, sf_dir, "documents")
    png = rows.where(F.col("doc_id") % 2 == 0).select(F.concat(F.lit("img/"), "doc_id", F.lit(".png")).alias("path"), F.concat(F.unhex(F.lit("89504E470D0A1A0A")), text, F.encode(F.lit("IEND"), "UTF-8"), F.coalesce(after, F.unhex(F.lit("00000001")))).alias("content"))
    jpeg = rows.where(F.col("doc_id") % 2 == 1).select(F.concat(F.lit("img/"), "doc_id", F.lit(".jpg")).alias("path"), F.concat(F.unhex(F.lit("FFD8FF")), text, F.unhex(F.lit("FFD9")), F.coalesce(after, F.unhex(F.lit("00000001")))).alias("content"))
    both = png.union(jpeg)
    return both.select("path", F.length("content").cast("long").alias("length"), "content")


def _member_names(spark: SparkSession, sf_dir: str, ending: str) -> DataFrame:
    """(path, p_partkey, name): archives by brand of part, with a member for each part."""
    k = F.col("p_partkey") % 9
    base = F.replace("p_name", F.lit(" "), F.lit("_"))
    name = (
        F.when(k == 0, F.concat(base, F.lit(".pdf.exe"))).when(k == 1, F.concat(base, F.lit(".jar"))).when(k == 2, F.concat(base, F.lit(".VBS"))).when(k == 3, F.concat(base, F.lit(".pdf.txt"))).when(k == 4, F.concat(base, F.lit("/vbaProject.bin")))
        .when(k == 5, F.concat(base, F.lit("/settings.xml"))).when(k == 6, F.concat(base, F.lit(".ZIP"))).when(k == 7, F.concat(base, F.repeat(F.lit("x"), 190), F.lit(".txt"))).otherwise(F.concat(base, F.lit(".txt")))
    )
    return _table(spark, sf_dir, "part").select(F.concat(F.lit("archives/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(ending)).alias("path"), "p_partkey", name.alias("name"))


def members(spark: SparkSession, sf_dir: str, ending: str = ".zip") -> DataFrame:
    """Archives by brand of part, with a member for each part; only names, as of a listed archive."""
    rows = _member_names(spark, sf_dir, ending).select("path", F.struct("p_partkey", "name").alias("m"))
    listed = rows.groupBy("path").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    return listed.select("path", F.lit(0).cast("long").alias("length"), F.unhex(F.lit("504B0304")).alias("content"), F.transform("ms", lambda m: F.struct(m["name"].alias("name"), m["name"].alias("stored_name"))).alias("members"))


def _archive(names: Iterable[str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in names:
            z.writestr(zipfile.ZipInfo(name), b"x")
    return out.getvalue()


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An archive for each run of rows (path, name) of one path; one archive is held at a time."""
    rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    for path, own in itertools.groupby(rows, operator.itemgetter(0)):
        content = pa.array([_archive(name for _, name in own)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pc.binary_length(content).cast("int64"), content], names=["path", "length", "content"])
        del content


def archives(spark: SparkSession, sf_dir: str, ending: str = ".zip") -> DataFrame:
    """The archives of ``members`` as real ZIP files.

    They are made by a step over rows, not by a function in a column: what stands
    above names the content many times, and a column's function would run for each.
    """
    rows = _member_names(spark, sf_dir, ending).repartition(spark.sparkContext.defaultParallelism, "path").sortWithinPartitions("path", "p_partkey", "name")
    return rows.select("path", "name").mapInArrow(_zipped, "path string, length long, content binary")


def unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document files, of which every one whose name ends in 5 could not be read."""
    lost = F.col("path").rlike("5[.][^/]*$")
    files = documents(spark, sf_dir)
    return files.select("path", F.when(lost, F.lit(0).cast("long")).otherwise(F.col("length")).alias("length"), F.when(~lost, F.col("content")).alias("content"), F.when(lost, "unreadable").alias("error"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report in JSON for each customer's orders, with a file for each order; older ones have no reasons."""
    orders = _table(spark, sf_dir, "orders")
    issue = F.struct(F.col("o_orderpriority").alias("code"), F.lit("d").alias("description"))
    file = F.struct(F.concat(F.lit("order/"), "o_orderkey").alias("path"), F.col("o_orderkey").alias("size"), F.array(issue).alias("issues"), (F.col("o_orderkey") % 101).alias("score"), F.when(F.col("o_custkey") % 2 == 0, F.array("o_orderstatus")).alias("reasons"))
    return orders.groupBy("o_custkey").agg(F.collect_list(file).alias("files")).select("o_custkey", F.to_json(F.struct(F.lit("now").alias("generated_at"), "files")).alias("report"))


def sized(spark: SparkSession, sf_dir: str, name: str, head: str, bound: int) -> DataFrame:
    """A file for each nation, one byte under, at or over a bound: ``head`` (as hexadecimal) and then blanks."""
    first, length = F.unhex(F.lit(head)), F.lit(bound - 1) + F.col("n_nationkey") % 3
    rows = _table(spark, sf_dir, "nation").select(F.concat(F.lit("sized/"), "n_nationkey", F.lit(name)).alias("path"), length.cast("long").alias("length"), F.concat(first, F.encode(F.repeat(F.lit(" "), (length - F.length(first)).cast("int")), "UTF-8")).alias("content"))
    return rows.repartition(8)  # the table is one small file, its files are large


def written(files: DataFrame, folder: str) -> None:
    """Write files (path, content) under a folder, in tasks: some for each core, however many the files come in."""
    spark = files.sparkSession
    store, place = files_of(spark, folder)
    tasks = max(8, 4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store.write(f"{place}/{path}", content or b"")
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])

    files.select("path", "content").repartition(tasks).mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


def _files(rows: DataFrame) -> DataFrame:
    content = F.encode("body", "UTF-8")
    return rows.select("path", F.octet_length("body").cast("long").alias("length"), content.alias("content"))
