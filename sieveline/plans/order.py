"""Places of rows in a total order, with no task that holds all of them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import shared_folder

#: Bits of a place within its part.
PART_BITS = 33


def ranked(df: DataFrame, *keys: Column, name: str = "place") -> DataFrame:
    """``df`` with the place of each row, from 1, in the order of the keys; ties are in any order.

    Rows are dealt out by ranges of the keys, sorted and numbered in each part, and
    the parts' sizes added up; rows with one key may be in several parts.  What is
    sorted is written to the shared folder once, so that places stay.
    """
    spark = df.sparkSession
    columns = [f"_column{i}" for i in range(len(df.columns))]
    order = [f"_key{i}" for i in range(len(keys))]
    keyed = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, columns, strict=True)), *(k.alias(n) for k, n in zip(keys, order, strict=True)), F.monotonically_increasing_id().alias("_tie"))
    parts = keyed.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").select(*columns, F.monotonically_increasing_id().alias("_at"))
    place = f"{shared_folder(spark)}/ranked-{uuid.uuid4().hex}"
    parts.write.parquet(place)
    rows = spark.read.schema(parts.schema).parquet(place)
    sizes = rows.groupBy(F.shiftright("_at", PART_BITS).alias("part")).count().collect()  # a row a part
    before, total = [], 0
    for r in sorted(sizes):
        before.append((r["part"], total))
        total += r["count"]
    offsets = spark.createDataFrame(before, "_part long, _before long")
    at = F.col("_at").bitwiseAND((1 << PART_BITS) - 1)
    placed = rows.join(F.broadcast(offsets), F.shiftright("_at", PART_BITS) == F.col("_part")).select(*columns, (F.col("_before") + at + 1).alias(name))
    return placed.toDF(*df.columns, name)
