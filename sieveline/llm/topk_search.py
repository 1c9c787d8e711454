"""Exact top-k search by integer inner products.

Vectors are packed into tiles, and those that are queries into blocks, both of a
bounded number of rows and ordered by id within.  Query groups and shards form a
grid: every block goes to all shards of its group's row, every tile to all groups
of its shard's column, and a cell, a bounded number of both, is one co-group.
There each strip of queries is multiplied with each tile; of every product only
the k + 1 best of a query are selected and merged into its list.  Lists of all
shards are merged as a tree, FAN at a time; the last step takes the query's own
row out, which is why lists hold one more than k.

Scores are exact: products are made in floats only where every partial sum is
below 2**53, else in 64-bit integers.

Defined results: a vector that is null or holds a null or non-finite component
takes no part, nor does a row with a null id; vectors of different lengths have no
inner product, so candidates are those of the query's length; of repeated rows each
is a query and each a candidate of the others; ties, also between rows of equal id,
go to the smaller id; fewer candidates than k give fewer ranks, an empty table or one
without queries no rows; a component beyond the one at which a score would exceed a
long counts as that one; only the two named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .centroids import usable
from .frames import whole_number

K, SCALE = 10, 1024
#: Rows of a tile, of a block of queries, and of a shard; queries that are multiplied at once.
TILE, BLOCK, SHARD, STRIP = 4096, 4096, 65536, 256
#: Lists that are merged at once.
FAN = 8
#: A score below all others marks a place of a list that is not filled.
UNFILLED = -((1 << 63) - 1)
PACKED = "dims int, place long, ids binary, kind string, body binary"
LISTS = "dims int, block long, branch int, ids binary, own binary, found binary, scores binary"


def limit(dims: int) -> int:
    """The largest component with which a score fits a long."""
    return math.isqrt((1 << 62) // max(dims, 1))


def packer(scale: int, rows: int):
    """Batches (id, vector) to rows of PACKED with at most ``rows`` vectors of one length, in the order of ids."""

    def emit(place: int, dims: int, ids: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
        i, x = np.concatenate(ids), np.concatenate(values)
        most = float(limit(dims))
        x = np.clip(np.floor(x * scale), -most, most)
        largest = np.abs(x).max(initial=0)
        kind = next(k for k, top in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63)) if largest < top)
        order = np.argsort(i, kind="stable")
        return pa.RecordBatch.from_pylist([{"dims": dims, "place": place, "ids": i[order].tobytes(), "kind": kind, "body": x[order].astype(kind).tobytes()}], pa.schema([("dims", pa.int32()), ("place", pa.int64()), ("ids", pa.binary()), ("kind", pa.string()), ("body", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        waiting: dict[int, tuple[list, list]] = {}  # by length
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            ids = batch.column(0).to_numpy()
            for dims in np.unique(lengths).tolist():
                own = lengths == dims
                values = batch.column(1).filter(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) if dims else np.zeros((int(own.sum()), 0))
                mine = ids[own]
                have = waiting.setdefault(dims, ([], []))
                for a in range(0, len(mine), rows):
                    have[0].append(mine[a : a + rows])
                    have[1].append(values[a : a + rows])
                    if sum(map(len, have[0])) >= rows:
                        i, x = np.concatenate(have[0]), np.concatenate(have[1])
                        yield emit(place, dims, [i[:rows]], [x[:rows]])
                        place += 1
                        have = waiting[dims] = ([i[rows:]], [x[rows:]])
        for dims, (ids, values) in waiting.items():
            if sum(map(len, ids)):
                yield emit(place, dims, ids, values)
                place += 1

    return run


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["body"], row["kind"]).reshape(len(ids), row["dims"]).astype(np.int64)


def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of both."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def selected(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best columns of each row, best first; columns are in the order of ids, which decides ties."""
    n = scores.shape[1]
    if n > k and int(np.abs(scores).max(initial=0)) < (1 << 62) // n:
        keys = scores * n + np.arange(n - 1, -1, -1)  # no two of a row are equal
        best = np.argpartition(keys, n - k, axis=1)[:, n - k :]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(keys, best, 1), axis=1), 1)
    else:
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return ids[best], np.take_along_axis(scores, best, 1)


def merged(lists: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of several lists of each row; shorter ones are filled up."""
    ids, scores = (np.concatenate(x, axis=1) for x in zip(*lists, strict=True))
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
    if (short := k - ids.shape[1]) > 0:
        ids, scores = np.pad(ids, ((0, 0), (0, short))), np.pad(scores, ((0, 0), (0, short)), constant_values=UNFILLED)
    return ids, scores


def cell(width: int):
    """A co-group of blocks and tiles to lists of ``width``."""

    def run(key: tuple, blocks: pa.Table, tiles: pa.Table) -> pa.Table:
        out = []
        for block in blocks.to_pylist():
            ids, q = unpacked(block)
            have = None
            for tile in tiles.to_pylist():
                its_ids, x = unpacked(tile)
                strips = [selected(product(q[a : a + STRIP], x), its_ids, width) for a in range(0, len(q), STRIP)]
                now = tuple(np.concatenate(part) for part in zip(*strips, strict=True))
                have = merged([now] if have is None else [have, now], width)
            if have is not None:
                out.append({"dims": block["dims"], "block": block["place"], "branch": key[2].as_py(), "ids": block["ids"], "own": (q * q).sum(1).tobytes(), "found": have[0].tobytes(), "scores": have[1].tobytes()})
        return pa.Table.from_pylist(out, list_schema())

    return run


def list_schema() -> pa.Schema:
    return pa.schema([("dims", pa.int32()), ("block", pa.int64()), ("branch", pa.int32()), *((n, pa.binary()) for n in ("ids", "own", "found", "scores"))])


def branch(width: int):
    """Lists of one block, FAN at most, to one."""

    def run(lists: pa.Table) -> pa.Table:
        rows = lists.to_pylist()
        n = len(rows[0]["ids"]) // 8
        found, scores = merged([tuple(np.frombuffer(r[c], np.int64).reshape(n, width) for c in ("found", "scores")) for r in rows], width)
        return pa.Table.from_pylist([rows[0] | {"branch": rows[0]["branch"] // FAN, "found": found.tobytes(), "scores": scores.tobytes()}], list_schema())

    return run


def ranks(width: int):
    """The last lists of a block to (query, rank, id, score), without each query's own row."""

    def run(lists: pa.Table) -> pa.Table:
        row = branch(width)(lists).to_pylist()[0]
        ids, own = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["own"], np.int64)
        found, scores = (np.frombuffer(row[c], np.int64).reshape(len(ids), width) for c in ("found", "scores"))
        self_ = (found == ids[:, None]) & (scores == own[:, None])
        at = np.where(self_.any(1), self_.argmax(1), width - 1)  # not among them: the last one goes
        keep = np.arange(width) != at[:, None]
        found, scores = found[keep].reshape(len(ids), -1), scores[keep].reshape(len(ids), -1)
        filled = scores != UNFILLED
        rank = np.broadcast_to(np.arange(1, width), found.shape)
        return pa.table({"query_id": np.repeat(ids, width - 1)[filled.ravel()], "rank": rank[filled].astype(np.int32), "vec_id": found[filled], "score": scores[filled]})

    return run


def search(vectors: DataFrame, queries: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, shard: int = SHARD, tile: int = TILE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row that meets ``queries``, its own left out."""
    whole_number(vectors, id_col)
    of_query = F.coalesce(queries, F.lit(False))
    n, asked = vectors.agg(F.count(id_col), F.count_if(of_query)).first()
    groups, shards = max(1, -(-asked // block)), max(1, -(-n // shard))
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    columns = (F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    one_of = lambda m: F.pmod(F.xxhash64("place"), F.lit(m)).cast("int")
    blocks = rows.where(of_query).select(*columns).mapInArrow(packer(scale, block), PACKED).withColumns({"query_group": one_of(groups), "shard": every(shards)})
    tiles = rows.select(*columns).mapInArrow(packer(scale, min(tile, shard)), PACKED).withColumns({"query_group": every(groups), "shard": one_of(shards)})
    cells = ("dims", "query_group", "shard")
    lists = blocks.groupBy(*cells).cogroup(tiles.groupBy(*cells)).applyInArrow(cell(k + 1), LISTS)
    while shards > FAN:
        lists = lists.groupBy("dims", "block", F.expr(f"branch div {FAN}").alias("_upper")).applyInArrow(branch(k + 1), LISTS)
        shards = -(-shards // FAN)
    return lists.groupBy("dims", "block").applyInArrow(ranks(k + 1), "query_id long, rank int, vec_id long, score long")
