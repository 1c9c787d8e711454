"""Centroid clustering of integer vectors with Drake's adaptive bounds (Drake and Hamerly, 2012).

A vector's state is the number of its centroid with an upper bound of the
distance to it, the numbers of its next nearest centroids with a lower bound for
each, and one lower bound for all the rest.  When centroids have moved, bounds
follow by how far; only where they cannot certify that the centroid is still the
nearest, by itself, distances are computed: to as many of the listed centroids as
are uncertain, or to all if the remainder is.  How many are listed adapts to how
many were of use, between k / 8 and k / 4.

Distances and sums are exact integers, bounds are widened by more than rounding
can amount to, and a bound that is merely equal certifies nothing; so assignments
are those of a full search, ties going to the smaller number.

Each round reads the table of states that the round before it wrote to the shared
checkpoint folder, and writes the next with one row of cluster sums a task; only
k x (components + 1) sums reach the driver.  Older tables are removed.

Defined results: a vector that is null, has another number of components, or a
null or non-finite one, has no row; of ties for a first centroid by equal ids, the
smaller components come first; a null id is clustered and is no first centroid;
fewer vectors than k give fewer centroids, none no rows; repeated rows are vectors
of their own, and equal first centroids leave all but the first of them empty; a
component beyond LIMIT, at which a squared distance would exceed a long, counts as
LIMIT; an inertia beyond a long is the largest long; only the two named columns
are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import checkpoint_folder, drop_table

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
#: More than rounding can add up to, relative to a bound.
SLACK = 2.0**-40
#: Rows whose integer distances are computed at once.
STRIP = 256
LONGEST = (1 << 63) - 1


def limit(dims: int) -> int:
    """The largest component for which a squared distance fits a long."""
    return min(int((LONGEST / max(dims, 1)) ** 0.5 / 2) - 1, (1 << 31) - 1)


def usable(vector: Column, dims: int | None = None) -> Column:
    """Not null, with finite components (``dims`` of them)."""
    finite = F.forall(vector, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce(finite if dims is None else (F.size(vector) == dims) & finite, F.lit(False))


def matrix(column: pa.Array, n: int) -> np.ndarray:
    """An array column of equal lengths as n rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def rows_of(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of n vectors to k centroids, or to k of their own where ``c`` is n x k x components."""
    own = c.ndim == 3
    if x.size == 0 or c.size == 0:
        return np.zeros((len(x), c.shape[-2]), np.int64)
    largest = int(max(np.abs(x).max(), np.abs(c).max()))
    if x.shape[1] * (2 * largest) ** 2 < 1 << 53:  # floats are exact
        x, c = x.astype(np.float64), c.astype(np.float64)
        product = np.einsum("nd,nkd->nk", x, c) if own else x @ c.T
        return ((x * x).sum(1)[:, None] - 2 * product + (c * c).sum(-1)).astype(np.int64)
    out = np.empty((len(x), c.shape[-2]), np.int64)
    for a in range(0, len(x), STRIP):
        difference = x[a : a + STRIP, None, :] - (c[a : a + STRIP] if own else c[None])
        out[a : a + STRIP] = (difference * difference).sum(2)
    return out


def above(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * (1 + SLACK)


def below(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * (1 - SLACK)


def searched(x: np.ndarray, c: np.ndarray, listed: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid and the next ``listed``, and bounds: upper, lower of each listed, lower of the rest."""
    d = squared(x, c)
    order = np.argsort(d, axis=1, kind="stable")[:, : listed + 2]
    d = np.take_along_axis(d, order, 1)
    rest = below(d[:, listed + 1 :]) if d.shape[1] > listed + 1 else np.full((len(x), 1), np.inf)
    return order[:, : listed + 1], np.concatenate([above(d[:, :1]), below(d[:, 1 : listed + 1]), rest], 1)


def moved(x: np.ndarray, near: np.ndarray, bound: np.ndarray, c: np.ndarray, drift: np.ndarray, listed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """State after centroids have moved by ``drift`` at most, with ``listed`` of them kept, and how many of those listed were of use."""
    near = near.copy()
    upper, lower = bound[:, 0] + drift[near[:, 0]], bound[:, 1:].copy()
    lower[:, :-1] -= drift[near[:, 1:]]
    lower[:, -1] -= drift.max(initial=0)
    if listed < near.shape[1] - 1:  # what is listed no longer joins the rest
        lower[:, listed] = lower[:, listed:].min(1)
        near, lower = near[:, : listed + 1], lower[:, : listed + 1]
    listed = near.shape[1] - 1
    least = np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1]  # of this place and all behind it
    ask = np.flatnonzero(upper >= least[:, 0])
    upper[ask] = above(squared(x[ask], c[near[ask, :1]])[:, 0])
    ask = ask[upper[ask] >= least[ask, 0]]
    uncertain = (upper[ask, None] >= least[ask]).sum(1)
    for places in np.unique(uncertain[uncertain <= listed]):
        rows = ask[uncertain == places]
        some = np.sort(near[rows, : places + 1], axis=1)
        d = squared(x[rows], c[some])
        order = np.argsort(d, axis=1, kind="stable")  # numbers are in order already
        d = np.take_along_axis(d, order, 1)
        near[rows, : places + 1] = np.take_along_axis(some, order, 1)
        upper[rows], lower[rows, :places] = above(d[:, 0]), below(d[:, 1:])
    again = ask[uncertain > listed]
    bound = np.concatenate([upper[:, None], lower], 1)
    if len(again):
        near[again], bound[again] = searched(x[again], c, listed)
    return near, bound, int(uncertain[uncertain <= listed].max(initial=0))


class Clustering:
    """One run; ``listed`` is how many next nearest centroids a state lists."""

    def __init__(self, vectors: DataFrame, k: int, rounds: int, seed: int, scale: int, dims: int, id_col: str, vector_col: str):
        self.spark, self.rounds, self.dims, self.folder = vectors.sparkSession, rounds, dims, f"{checkpoint_folder(vectors.sparkSession)}/centroids-{uuid.uuid4().hex}"
        most = float(limit(dims))
        part = lambda v: F.floor(F.least(F.greatest(v.cast("double") * scale, F.lit(-most)), F.lit(most))).cast("int")
        self.vectors = vectors.where(usable(F.col(vector_col), dims)).select(F.col(id_col).alias("id"), F.transform(F.col(vector_col), part).alias("x"))
        first = self.vectors.where("id is not null").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), "x").limit(k).collect()
        self.centroids = np.array([r["x"] for r in first], np.int64).reshape(-1, dims)
        self.k = len(first)
        self.listed = max(1, min(k // 4, self.k - 1))
        self.table: str | None = None

    def assign(self, number: int, drift: np.ndarray) -> str:
        """Write the states of all vectors for the present centroids, and cluster sums."""
        c, listed, fresh, k, dims = self.centroids, self.listed, self.table is None, self.k, self.dims
        kind = self.vectors.schema["id"].dataType
        schema = T.StructType([T.StructField("id", kind), *T._parse_datatype_string("x array<int>, near array<int>, bound array<double>, distance long, sums binary, used int").fields])
        source = self.vectors if fresh else self.spark.read.parquet(self.table).where("x is not null").select("id", "x", "near", "bound")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, used, id_type = np.zeros((k, dims + 1), np.int64), 0, None
            for batch in batches:
                n, id_type = batch.num_rows, batch.column(0).type
                if not n:
                    continue
                x = matrix(batch.column(1), n).astype(np.int64)
                if fresh:
                    near, bound = searched(x, c, listed)
                else:
                    near, bound, places = moved(x, matrix(batch.column(2), n).astype(np.int64), matrix(batch.column(3), n), c, drift, listed)
                    used = max(used, places)
                np.add.at(sums[:, 0], near[:, 0], 1)
                np.add.at(sums[:, 1:], near[:, 0], x)
                distance = squared(x, c[near[:, :1]])[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows_of(near, pa.int32()), rows_of(bound, pa.float64()), pa.array(distance), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32())], names=schema.names)
            if id_type is not None:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.float64())), pa.nulls(1, pa.int64()), pa.array([sums.tobytes()], pa.binary()), pa.array([used], pa.int32())], names=schema.names)

        path = f"{self.folder}/{number}"
        source.mapInArrow(run, schema).write.parquet(path)
        if self.table:
            drop_table(self.spark, self.table)
        self.table = path
        return path

    def totals(self) -> tuple[np.ndarray, int]:
        """Count and component sums of each cluster (Python integers), and the most listed centroids that were of use."""
        k, width = self.k, self.dims + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k * width, np.int64)
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    total += np.frombuffer(b, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * width), pa.int32()), pa.array(total)], names=["i", "value"])

        rows = self.spark.read.parquet(self.table).where("sums is not null")
        found = rows.select("sums").mapInArrow(run, "i int, value long").groupBy("i").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
        total = np.zeros(k * width, object)
        for r in found:
            total[r["i"]] = int(r["value"])
        return total.reshape(k, width), rows.agg(F.coalesce(F.max("used"), F.lit(0))).first()[0]

    def run(self) -> DataFrame:
        """(id, cluster, distance) of all vectors after the rounds and one more assignment."""
        drift, at_most = np.zeros(self.k), self.listed
        for number in range(self.rounds + 1):
            self.assign(number, drift)
            if number == self.rounds:
                break
            total, used = self.totals()
            new = np.array([[s // row[0] for s in row[1:]] if row[0] else list(old) for row, old in zip(total, self.centroids.tolist(), strict=True)], np.int64).reshape(self.k, self.dims)
            drift = above(((new - self.centroids) ** 2).sum(1))
            self.centroids = new
            if number:
                self.listed = max(min(self.listed, used), min(max(1, self.k // 8), at_most))
        return self.spark.read.parquet(self.table).where("x is not null").select("id", F.element_at("near", 1).alias("cluster"), "distance")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, dims: int = DIMS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector."""
    work = Clustering(vectors, k, rounds, seed, scale, dims, id_col, vector_col)
    shape = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not work.k:
        return work.vectors.limit(0).select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    found = work.run()
    spent = {r["cluster"]: int(r["spent"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("spent")).collect()}
    total = min(sum(spent.values()), LONGEST)
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    table = [(j, min(spent.get(j, 0), LONGEST), total, digest(c)) for j, c in enumerate(work.centroids.tolist())]
    of_cluster = F.broadcast(vectors.sparkSession.createDataFrame(table, shape))  # k rows
    return found.join(of_cluster, "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
