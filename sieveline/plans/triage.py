"""The triage plan: files -> facts -> findings -> score, all narrow until results are sorted.

Facts are all that detectors look at: hash, first and last bytes, what one search for
all patterns finds, archive members, and the content of small files.  Of a relation
they are columns over its contents; files are read block by block, so that no content
is held whole.  Contents over the size limit are never read.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TriageOptions
from ..functions import columns as C
from ..functions.archive import zip_members
from ..operators import findings, scoring
from ..schemas import ISSUES, RESULT
from ..sources.report import read_report
from ..sources.facts import read_facts
from ..sources.tree import list_files


def file_columns(members: Column | None = None, options: TriageOptions = TriageOptions()) -> findings.File:
    """The detectors' view of a relation (path, length, content); ``members`` are taken as given where a relation has them."""
    content, name = F.col("content"), C.file_name(F.col("path"))
    file = findings.File(name, C.suffix(name), C.magic_type(content), F.col("length"), C.head(content, C.TEXT_WINDOW), C.tail(content, findings.IMAGE_TAIL), None, content, F.col("members") if members is None else members)
    return replace(file, hits=findings.searched(content, file.is_pdf(), file.is_image(), options))


def fact_columns() -> findings.File:
    """The detectors' view of facts."""
    name = F.when(~F.col("aside"), C.file_name(F.col("path")))  # a file that is set aside has no findings of its own
    return findings.File(name, C.suffix(name), C.magic_type(F.col("head")), *map(F.col, ("length", "head", "tail", "hits", "body", "members")))


def _result(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in RESULT))


def facts_of(df: DataFrame, options: TriageOptions = TriageOptions()) -> DataFrame:
    """Facts of any relation (path, length, content[, members][, error]); contents of rows over the size limit, or with an error, are not looked at."""
    if "error" not in df.columns:
        df = df.withColumn("error", F.lit(None).cast("string"))
    df = df.withColumn("content", F.when(~_aside(options), F.col("content")))
    file = file_columns(options=options)
    if "members" not in df.columns:
        df = df.withColumn("members", zip_members(F.when(file.needs_members(), F.col("content"))))
    body = F.when(F.col("length") <= findings.URL_LIMIT, F.col("content"))
    return df.select("path", "length", "error", C.sha256(F.col("content")).alias("sha256"), file.head.alias("head"), file.tail.alias("tail"), file.hits.alias("hits"), body.alias("body"), "members")


def scan_relation(df: DataFrame, options: TriageOptions = TriageOptions()) -> DataFrame:
    """Results for any relation (path, length, content[, members][, error]), scanned once; null contents are scanned as nothing."""
    return scan_facts(facts_of(df, options), options)


def _aside(options: TriageOptions) -> Column:
    """Whether a file is too large, or could not be read."""
    return F.coalesce(F.col("length") > options.max_file_size, F.lit(False)) | F.col("error").isNotNull()


def scan_facts(df: DataFrame, options: TriageOptions = TriageOptions()) -> DataFrame:
    """Results for facts."""
    file = fact_columns()
    magic = file.magic
    if options.use_magic:
        df = df.withColumn("magic_type", mime_type(F.col("head")))  # a label of its own; gates keep the sniffed type
        magic = F.col("magic_type")
    df = df.withColumn("aside", _aside(options))
    either = lambda there, own: F.when(F.col("aside"), there).otherwise(own)
    # contents are dropped as soon as findings are there
    out = df.select("path", F.col("length").alias("size"), either(F.lit(""), F.col("sha256")).alias("sha256"), either(F.lit("unknown"), magic).alias("magic_type"), F.concat(either(_aside_issues(), findings.none()), findings.all_findings(file, options)).alias("issues"), "error", "aside")
    out = out.withColumn("score", either(F.lit(0), scoring.score(F.col("issues"))))
    return _result(out.withColumns({"severity": scoring.severity(F.col("score")), "reasons": either(_aside_reasons(), scoring.reasons(F.col("issues")))}))


def _aside_issues() -> Column:
    skipped = findings.issue("skipped_large", findings.SKIPPED_LARGE)
    return F.when(F.col("error").isNotNull(), F.array().cast(ISSUES)).otherwise(F.array(skipped))


def _aside_reasons() -> Column:
    return F.when(F.col("error").isNotNull(), F.array().cast("array<string>")).otherwise(F.array(F.lit("skipped_large")))


def mime_type(head: Column) -> Column:
    """A MIME label by libmagic where its Python binding is installed, else the sniffed type."""
    try:
        import magic  # noqa: F401
    except ImportError:
        return C.magic_type(head)
    import pandas as pd

    def label(heads: pd.Series) -> pd.Series:
        import magic

        return heads.map(lambda b: magic.from_buffer(bytes(b or b""), mime=True))

    return F.pandas_udf(label, "string")(head)


def scan_path(spark: SparkSession, path: str, options: TriageOptions) -> DataFrame:
    return scan_facts(read_facts(list_files(spark, path), path, options), options)


def scan(spark: SparkSession, path: str, options: TriageOptions = TriageOptions()) -> DataFrame:
    """Results for every file under a folder, in order of path components."""
    return in_path_order(scan_path(spark, path, options))


def scan_targets(spark: SparkSession, paths: list[str], options: TriageOptions = TriageOptions()) -> DataFrame:
    """Results for several targets, one after the other; a file under two targets comes twice."""
    parts = [scan_path(spark, p, options).withColumn("target_idx", F.lit(k)) for k, p in enumerate(paths)]
    if not parts:
        return spark.createDataFrame([], RESULT)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("target_idx", C.path_order(F.col("path"))).drop("target_idx")


def in_path_order(results: DataFrame) -> DataFrame:
    return results.orderBy(C.path_order(F.col("path")))


def explode_issues(results: DataFrame) -> DataFrame:
    """One row per finding: path, position, its fields and its weight."""
    # an outer explode: for an inner one the optimizer would evaluate all findings once more, to filter empty arrays
    rows = results.select("path", F.posexplode_outer("issues").alias("pos", "i")).where("pos is not null")
    return rows.select("path", "pos", "i.*", scoring.weight(F.col("i.code")).alias("weight"))


def report_results(spark: SparkSession, path: str) -> DataFrame:
    return read_report(spark, path)
