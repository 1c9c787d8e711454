"""Connected components of a link table, without leaving DataFrames.

Alternating large-star and small-star steps (Kiveris et al., 2014) shrink the
distance to the smallest node of each component; every step aggregates by node
before it joins, so a node with very many links is combined on the map side and
split by adaptive execution.  Before each round every part of at most about ``PART``
links is joined up by itself; where that is one part, nothing is left to do.  Each
round is checkpointed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as stars: each node that is linked, and the smallest node of its component here."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest with the components of a task's links."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a, b = forest(np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()]))
        if len(a) > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])
            a = b = np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])


#: Links of a part; so many are joined up by one task.
PART = 1 << 18


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first())


def _contracted(links: DataFrame) -> DataFrame:
    return links.where("u != v").mapInArrow(_contract, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """From links (u, v) of longs to (u, v) with v the smallest node that u reaches; only nodes u > v have a row."""
    links = cut(_contracted(links.select("u", "v")).distinct())
    state = _state(links)
    while True:
        parts = max(1, -(-state[0] // PART))
        links = cut(_contracted(links.coalesce(parts)))
        if parts == 1:  # no link is outside
            return links
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select("m", F.explode(F.array("u", "v")).alias("u")).select("u", F.col("m").alias("v"))
        links = cut(small.where("u != v").distinct().coalesce(parts))
        if (now := _state(links)) == state:
            return links
        state = now
