"""The training-data pipeline: quality rules, language, near duplicates, repeated bytes, packing.

Each stage is a function of (spark, docs, sf_dir) that gets the rows which the
one before it kept, as a table read back from Parquet.  All but the last return
the columns of ``documents``.

Defined results: a null or empty text fails the quality rules; a very long text
goes through every stage whole; of repeated rows one stays, of similar rows the
one with the smallest id, of ties the one with the smallest hash of its text;
columns beside those of ``documents`` are carried along, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import language_id, packing, quality_rules, simhash, suffix_dedup
from sieveline.llm.frames import ensure_checkpoint_dir
from sieveline.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    forest = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.passed(docs, forest)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told, or is none of the learned, go."""
    model = language_id.fit_known(docs)
    return language_id.identified(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (a Jaccard similarity of five-word shingles of 0.8 or more) stays."""
    return simhash.one_of_each(docs)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the byte runs that occur elsewhere; every document stays."""
    columns = docs.columns
    shorter = suffix_dedup.deduplicated(docs)
    return shorter.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else shorter


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, one row per piece of a document."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("language_id", language), ("simhash_near_dedup", near_duplicates), ("suffix_array_dedup", repeated_bytes), ("packing", packed)]

#: Learned models, suffix order and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between them is written to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            written = f"{folder}/{k}-{name}"
            docs.write.parquet(written)
            docs = spark.read.parquet(written)
            if before:  # nothing reads the table before the last one any more
                place = spark._jvm.org.apache.hadoop.fs.Path(before)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            before = written
    return docs
