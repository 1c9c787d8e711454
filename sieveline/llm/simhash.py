"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are compared in tiles with exclusive-or and bit counts in
numpy; tile pairs whose population counts differ by more than the radius are
skipped.  So that not all fingerprints meet, they are dealt out first, in a way
that loses no link:

* ``component_ids`` links fingerprints within a small radius.  They are dealt by
  the values of ``BLOCKS - RADIUS`` of ``BLOCKS`` bit blocks: two that differ in at
  most ``RADIUS`` bits agree in some such choice.
* ``one_of_each`` links texts by the Jaccard similarity of their shingles.  They
  are dealt by the shingles that similar sets must share (see ``shingles``).  A
  fingerprint of ``ODD_BITS`` bits, each of which tells whether an odd number of
  shingles falls on it, differs in no more bits than the sets do in shingles, so
  that pairs beyond what their sizes allow are ruled out for certain; the sets
  confirm the others.  Each text is compared with one text of every deal first,
  then with the ``CENTRES`` of them that are closest to the majority of their
  64-bit fingerprints, and at last those that are not in one component yet with
  each other; so edited copies of one text are not all compared.

A group that exceeds ``TILE`` is dealt again into tiles by population count (by
size for the similarity of sets) and a hash, and its tile pairs go to separate
tasks.  Links become components over the
whole table.

Defined results: a null, empty or blank text has fingerprint zero and is linked
like any other (its set is empty and equals itself only); fewer words than a
shingle are one shingle; a very long text is taken whole, with about 80 bytes of
arrays a word; repeated rows share a component, and one of them stays; a null id
takes no part in the smallest id, and a component of null ids only has a null
component_id; of ties the smallest fingerprint, or text hash, stays; input columns
may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .components import components, forest
from .frames import append, cut
from .textops import Words, flat, mixed, released, slices

SHINGLE = 3
SEED = 42
RADIUS = 2
BLOCKS, BLOCK_BITS = 4, 16
#: Fingerprints in a tile.
TILE = 4096
#: Groups up to this size are compared along diagonals of the sorted table, larger ones as matrices.
SMALL = 32
#: Sizes of similar sets are in one class or in neighbouring ones (a little over the largest quotient of two).
SIZE_STEP = 1.26
#: Bits of the fingerprint by odd counts.
ODD_BITS = 512
#: Texts of a deal that all others are compared with before any two are.
CENTRES = 8


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    words = Words(data, offsets)
    n_words = np.diff(words.first)
    out = np.zeros(len(n_words), np.uint64)
    if not len(words):
        return out
    joined, at = words.join(lower=True)
    ends = at + words.lengths
    counts = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    has = np.flatnonzero(counts)
    first = np.append(0, np.cumsum(counts[has]))
    begin = np.arange(first[-1]) + np.repeat(words.first[has] - first[:-1], counts[has])
    last = begin + np.repeat(np.minimum(n_words[has], shingle), counts[has]) - 1
    text, hashed = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((hashed(text[a:b], SEED) for a, b in zip(at[begin].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(begin))
    out[has] = majority(h, first)
    return out


def majority(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The bits that over half of the hashes in each (not empty) [bounds[i], bounds[i + 1]) have."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    if not len(out):
        return out
    for k in range(0, 64, 8):  # eight bits at a time keep the table of bits small
        bits = np.unpackbits((h >> np.uint64(k)).astype(np.uint8)[:, None], axis=1, bitorder="little")
        over = 2 * np.add.reduceat(bits, bounds[:-1], axis=0, dtype=np.int64) > np.diff(bounds)[:, None]
        out |= np.packbits(over, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(k)
    return out


def annotate(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``simhash``, the fingerprint as a signed long."""
    fields = T.StructType([T.StructField("simhash", T.LongType())])
    return append(docs, text_col, fields, lambda batch: [pa.array(fingerprints(*flat(batch.column(batch.schema.get_field_index(text_col))), shingle).view(np.int64))], keep)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which fingerprints of one or more words differ; the last axis of both are the words."""
    out = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
    for k in range(1, a.shape[-1]):
        out += np.bitwise_count(a[..., k] ^ b[..., k])
    return out


def tiled(words: np.ndarray, allow: np.ndarray, a: np.ndarray, b: np.ndarray | None, tile: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of ``a`` and ``b``, or (b is None) within ``a``, that differ in at most the sum of what both allow."""
    counts = np.bitwise_count(words).sum(1, dtype=np.int64)
    sort = lambda x: x[np.argsort(counts[x], kind="stable")]
    a = sort(a)
    other = a if b is None else sort(b)
    for i in range(0, len(a), tile):
        u = a[i : i + tile]
        for j in range(i if b is None else 0, len(other), tile):
            v = other[j : j + tile]
            if max(counts[v[0]] - counts[u[-1]], counts[u[0]] - counts[v[-1]]) > allow[u].max() + allow[v].max():
                continue
            near = differing(words[u, None], words[None, v]) <= allow[u, None] + allow[None, v]
            if b is None and i == j:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            if len(x):
                yield u[x], v[y]


def compare(group: np.ndarray, side: np.ndarray, words: np.ndarray, allow: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs that differ in at most the sum of what both allow, in rows in order of their group; side 0 is one tile, 1 and 2 are two tiles to compare."""
    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(cuts, len(group)))
    small = np.repeat((sizes <= SMALL) & (np.add.reduceat(side, cuts) == 0), sizes)
    at = np.flatnonzero(small)
    for d in range(1, min(SMALL, int(sizes.max(initial=1)))):
        if len(at) <= d:
            break
        u, v = at[:-d], at[d:]
        same = group[u] == group[v]
        u, v = u[same], v[same]
        near = differing(words[u], words[v]) <= allow[u] + allow[v]
        if near.any():
            yield u[near], v[near]
    for begin, size in zip(cuts, sizes, strict=True):
        if not small[begin]:
            own, s = np.arange(begin, begin + size), side[begin : begin + size]
            yield from tiled(words, allow, *((own, None) if not s.any() else (own[s == 1], own[s == 2])))


def by_group(batches: Iterator[pa.RecordBatch], keys: int, least: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """Columns of whole groups, in rows in order of their first ``keys`` columns, at least so many rows at once."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        if len(held[0]) < least:
            continue
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in held[:keys]], axis=0))
        if len(change):
            end = change[-1] + 1
            yield [x[:end] for x in held]
            held = [x[end:] for x in held]
    if held is not None and len(held[0]):
        yield held


def numbered(*keys: np.ndarray) -> np.ndarray:
    return np.cumsum(np.append(0, np.any([k[1:] != k[:-1] for k in keys], axis=0)))


def _links(radius: int):
    """Links within groups (bucket, pair), as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, pair, side, fp in by_group(batches, 2):
            a = b = np.zeros(0, np.int64)
            for u, v in compare(numbered(bucket, pair), side.astype(np.int64), fp.view(np.uint64)[:, None], np.full(len(fp), radius / 2)):
                a, b = np.concatenate([a, fp[u]]), np.concatenate([b, fp[v]])
                if len(a) > 1 << 20:
                    a, b = forest(a, b)
            if len(a):
                a, b = forest(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

    return released(run)


def dealt(keyed: DataFrame, radius: int, tile: int, pop: F.Column | None = None) -> DataFrame:
    """Rows (bucket, pair, side, simhash, ...) of (bucket, simhash, ...), in order of their group; groups over ``tile`` become pairs of tiles
    whose ``pop`` (population count, if it isn't given) differ by at most ``radius``."""
    more = [c for c in keyed.columns if c not in ("bucket", "simhash")]
    keyed = keyed.withColumn("pop", F.bit_count("simhash") if pop is None else pop.cast("int"))
    as_one = lambda df: df.select("bucket", F.lit(0).cast("long").alias("pair"), F.lit(0).cast("byte").alias("side"), "simhash", *more)
    together = lambda df: df.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair")
    over = cut(keyed.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > tile).select("bucket"))
    if over.isEmpty():
        return together(as_one(keyed))
    usual = as_one(keyed.join(over, "bucket", "left_anti"))
    hot = cut(keyed.join(over, "bucket"))
    tiles = hot.groupBy("bucket", "pop").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    placed = hot.join(tiles, ["bucket", "pop"]).select("bucket", "simhash", *more, (F.col("pop") * 1_000_000 + F.pmod(F.xxhash64("simhash", *more), F.col("parts"))).cast("long").alias("t"))
    each = tiles.select("bucket", "pop", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("bucket", "pop", (F.col("pop") * 1_000_000 + F.col("part")).cast("long").alias("t"))
    # tiles of one group that are within the radius
    other = each.select("bucket", F.col("t").alias("t2"), F.explode(F.sequence(F.col("pop") - radius, F.col("pop"))).alias("pop"))
    pairs = each.join(other, ["bucket", "pop"]).where("t <= t2").select("bucket", "t", "t2", F.xxhash64("t", "t2").alias("pair"))
    left = placed.join(pairs, ["bucket", "t"]).select("bucket", "pair", F.when(F.col("t") == F.col("t2"), 0).otherwise(1).cast("byte").alias("side"), "simhash", *more)
    right = placed.join(pairs.where("t < t2").select("bucket", F.col("t2").alias("t"), "pair"), ["bucket", "t"]).select("bucket", "pair", F.lit(2).cast("byte").alias("side"), "simhash", *more)
    return together(usual.union(left).union(right))


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (u, v) that span the components of distinct fingerprints (column simhash)."""
    if radius >= BLOCKS:
        raise ValueError(f"the radius must be below {BLOCKS}")
    block = [F.shiftrightunsigned("simhash", BLOCK_BITS * k).bitwiseAND((1 << BLOCK_BITS) - 1) for k in range(BLOCKS)]
    keys = []
    for n, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - radius)):
        key = F.lit(n).cast("long")
        for k in chosen:
            key = F.shiftleft(key, BLOCK_BITS).bitwiseOR(block[k])
        keys.append(key)
    keyed = distinct.select(F.explode(F.array(*keys)).alias("bucket"), "simhash")
    return dealt(keyed, radius, tile).mapInArrow(_links(radius), "u long, v long")


def groups(marked: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """From rows (id, simhash) to one row per fingerprint: simhash, its component's label and smallest id, and the fingerprint of a row with that id."""
    distinct = cut(marked.groupBy("simhash").agg(F.min(id_col).alias("least")))
    label = components(links(distinct.select("simhash"), radius, tile))
    labelled = distinct.join(label.select(F.col("u").alias("simhash"), F.col("v").alias("label")), "simhash", "left").withColumn("label", F.coalesce("label", "simhash"))
    best = labelled.groupBy("label").agg(F.min(F.struct(F.col("least").isNull(), "least", "simhash")).alias("best"))
    return labelled.join(best, "label").select("simhash", "label", F.col("best.least").alias("component_id"), F.col("best.simhash").alias("best_simhash"))


def component_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per document: id, fingerprint (16 hex digits) and component_id, the smallest id reachable."""
    marked = cut(annotate(docs, text_col, [id_col]))
    return marked.join(groups(marked, id_col, radius), "simhash").select(id_col, F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


SETS = "key long, simhash long, odd binary, n int, prefix array<long>"
MEMBERS = "shingle long, key long, n int, pos int, centre long, open boolean"
#: Bits of the map that tells which rows' texts may be wanted; what it lets through in vain is dropped by the join.
MAP_BITS = 24


def _sets(columns: int, shingle: int, counts: Broadcast):
    """From (..., text): instead of the text the key, fingerprint and size of its set, and its first shingles (once in a batch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            h, bounds = shingles.shingle_sets(*flat(batch.column(columns)), shingle)
            keys, n = shingles.set_keys(h, bounds), np.diff(bounds)
            fp = np.zeros(len(n), np.uint64)
            has = np.flatnonzero(n)
            fp[has] = majority(mixed(h.copy()), np.append(bounds[has], bounds[-1]))
            times = np.bincount(np.repeat(np.arange(len(n)), n) * ODD_BITS + (h % np.uint64(ODD_BITS)).astype(np.int64), minlength=len(n) * ODD_BITS)
            odd = np.packbits((times & 1).astype(np.uint8).reshape(len(n), ODD_BITS), axis=1)
            first, at = shingles.prefixes(h, bounds, counts.value)
            once = np.zeros(len(n), bool)
            once[np.unique(keys, return_index=True)[1]] = True
            prefix = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(first.view(np.int64)))
            prefix = pa.array([p if o else None for p, o in zip(prefix, once.tolist(), strict=True)], pa.list_(pa.int64())) if not once.all() else prefix
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], pa.array(keys.view(np.int64)), pa.array(fp.view(np.int64)), pa.array([x.tobytes() for x in odd], pa.binary()), pa.array(n.astype(np.int32)), prefix], names=[*batch.schema.names[:columns], "key", "simhash", "odd", "n", "prefix"])

    return released(run)


def allowed(n: np.ndarray) -> np.ndarray:
    """A set's part of the shingles, and so of the odd counts, in which two similar sets can differ (with room for rounding)."""
    return n * ((shingles.DENOMINATOR - shingles.NUMERATOR) / (shingles.DENOMINATOR + shingles.NUMERATOR)) + 1e-6


def words_of(odd: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(odd), np.uint64).reshape(len(odd), ODD_BITS // 64)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of shingle and key: each set that shares a shingle with others; ``centre`` is the first of
    them, if it may be similar, and ``open`` tells whether there are three or more.  Rows that say neither go."""
    for rows in by_group(batches, 1):
        shingle, key = rows[:2]
        new = np.append(True, (shingle[1:] != shingle[:-1]) | (key[1:] != key[:-1]))
        shingle, key, n, pos = (x[new] for x in rows)
        starts = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
        sizes = np.diff(np.append(starts, len(shingle)))
        first, many = np.repeat(starts, sizes), np.repeat(sizes > 2, sizes)
        a, b = n.astype(np.int64), pos.astype(np.int64)
        linked = (first != np.arange(len(key))) & shingles.near(a, a[first], b, b[first])
        some = np.flatnonzero(linked | many)
        columns = [pa.array(x[some]) for x in (shingle, key, n, pos)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(key[first[some]], mask=~linked[some]), pa.array(many[some])], names=[f.split()[0] for f in MEMBERS.split(", ")])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (u, v) with the sizes and odd counts of both, those that may be similar."""
    for batch in batches:
        if batch.num_rows:
            n = allowed(batch.column(2).to_numpy()) + allowed(batch.column(4).to_numpy())
            odd = (words_of(batch.column(i).to_numpy(zero_copy_only=False)) for i in (3, 5))
            yield batch.select([0, 1]).filter(pa.array(differing(*odd) <= n))


def _pairs(key: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Pairs of keys, the smaller one first, each once."""
    found = [np.zeros((0, 2), np.int64), *(np.sort(np.column_stack([key[u], key[v]]), axis=1) for u, v in parts)]
    u, v = np.unique(np.concatenate(found), axis=0).T
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


class Deal:
    """Rows of deals, for looking at pairs of places."""

    def __init__(self, fp: np.ndarray, key: np.ndarray, n: np.ndarray, pos: np.ndarray, label: np.ndarray, odd: np.ndarray):
        self.fp, self.key, self.label = fp.view(np.uint64), key, label
        self.n, self.pos = n.astype(np.int64), pos.astype(np.int64)
        self.odd, self.allow = words_of(odd), allowed(self.n)

    def open(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs that are of different components and may be similar."""
        n = self.n
        may = self.label[u] != self.label[v]
        u, v = u[may], v[may]
        may = shingles.near(n[u], n[v], self.pos[u], self.pos[v])
        u, v = u[may], v[may]
        may = differing(self.odd[u], self.odd[v]) <= self.allow[u] + self.allow[v]
        return u[may], v[may]


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (u, v) of different components, from rows in order of shingle: the texts of each deal that are closest to
    its majority (what edited copies were made from comes first), and all others."""
    for shingle, *rows in by_group(batches, 1):
        group, fp = numbered(shingle), rows[0].view(np.uint64)
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        far = np.bitwise_count(fp ^ majority(fp, np.append(starts, len(group)))[group])
        order = np.lexsort((mixed(rows[1].view(np.uint64).copy()), far, group))
        group, deal = group[order], Deal(*(x[order] for x in rows))
        first = np.searchsorted(group, group)
        rank = np.arange(len(group)) - first
        later = [np.flatnonzero(rank > c) for c in range(min(CENTRES, int(rank.max())))]
        yield _pairs(deal.key, [deal.open(first[v] + c, v) for c, v in enumerate(later)])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (u, v) of different components, from rows dealt by shingle; each pair once for the rows of a step."""
    for bucket, pair, side, *rows in by_group(batches, 2):
        deal = Deal(*rows)
        near = compare(numbered(bucket, pair), side.astype(np.int64), deal.odd, deal.allow)
        yield _pairs(deal.key, [deal.open(u, v) for u, v in near])


def similar_links(marked: DataFrame, nodes: DataFrame, bodies_of, shingle: int, tile: int = TILE) -> DataFrame:
    """Links (u, v) that span the components of the sets of ``marked`` (key, n, prefix) and ``nodes`` (key, simhash, n, odd);
    ``bodies_of`` gives (key, body) for a table of keys."""
    rows = marked.where("prefix is not null").select(F.posexplode("prefix").alias("pos", "shingle"), "key", "n").select("shingle", "key", "n", "pos")
    members = cut(rows.repartition("shingle").sortWithinPartitions("shingle", "key").mapInArrow(released(_met), MEMBERS))
    side = lambda c: nodes.select(F.col("key").alias(c), F.col("n").alias(f"{c}_n"), F.col("odd").alias(f"{c}_odd"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        if pairs.isEmpty():
            return pairs
        bodies = cut(bodies_of(pairs.select("u").union(pairs.select("v")).distinct().withColumnRenamed("u", "key")))
        right = cut(pairs.join(bodies.select(F.col("key").alias("v"), F.col("body").alias("right")), "v"))
        return cut(right.join(bodies.select(F.col("key").alias("u"), F.col("body").alias("left")), "u").select("u", "v", "left", "right").mapInArrow(shingles.similar(shingle), "u long, v long"))

    star = cut(members.where("centre is not null").select(F.least("centre", "key").alias("u"), F.greatest("centre", "key").alias("v")).distinct())
    star = star.join(side("u"), "u").join(side("v"), "v").select("u", "v", "u_n", "u_odd", "v_n", "v_odd")
    tried = cut(star.mapInArrow(_close, "u long, v long"))
    found = confirmed(tried)
    for step in (_around, _across):
        label = components(found).select(F.col("u").alias("key"), F.col("v").alias("label"))
        labelled = cut(members.where("open").select("shingle", "key", "n", "pos").join(label, "key", "left").withColumn("label", F.coalesce("label", "key")))
        several = cut(labelled.groupBy("shingle").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("shingle"))
        left = labelled.join(several, "shingle").join(nodes.select("key", "simhash", "odd"), "key").select(F.col("shingle").alias("bucket"), "simhash", "key", "n", "pos", "label", "odd")
        rows = left.repartition("bucket").sortWithinPartitions("bucket") if step is _around else dealt(left, 1, tile, F.floor(F.log("n") / math.log(SIZE_STEP)))
        pairs = cut(rows.mapInArrow(released(step), "u long, v long").distinct().join(tried, ["u", "v"], "left_anti"))
        found = cut(found.union(confirmed(pairs)))
        tried = tried.union(pairs)
    return found


def row_map(names: DataFrame) -> np.ndarray:
    """A bit for each value of the low bits of the hashes of names: whether a name has it.  Its size is fixed."""
    size = 1 << MAP_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(size // 8, np.uint8)
    for row in names.coalesce(8).mapInArrow(released(run), "bits binary").collect():
        out |= np.frombuffer(row.bits, np.uint8)
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = shingles.SHINGLE, tile: int = TILE) -> DataFrame:
    """``docs`` with one row of each component under the similarity of shingles: one with the smallest id (null ids last)."""
    names = [f"_column{i}" for i in range(len(docs.columns))]
    own_id, text = F.col(names[docs.columns.index(id_col)]), F.col(names[docs.columns.index(text_col)])
    # a row's name tells apart rows with one id by their text, so that one shuffle serves each join and the choice among repeated rows
    name = lambda id_, hash_: F.concat(F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit("")), F.lit(" "), hash_.cast("string"))
    named = docs.toDF(*names).withColumn("_row", name(own_id, F.xxhash64(text)))
    counts = docs.sparkSession.sparkContext.broadcast(shingles.shingle_counts(docs.select(F.col(text_col).alias("text")), shingle))  # of a fixed size
    whole = named.select(own_id.alias("_id"), "_row", text.alias("_text"))
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_row", T.StringType()), *T.StructType.fromDDL(SETS).fields])
    marked = cut(whole.mapInArrow(_sets(2, shingle, counts), schema))
    row = F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")
    nodes = cut(marked.groupBy("key").agg(F.min(row).alias("row"), F.first("simhash").alias("simhash"), F.first("n").alias("n"), F.min("odd").alias("odd")))

    place = F.pmod(F.xxhash64("_row"), F.lit(1 << MAP_BITS)).cast("int")

    def bodies_of(keys: DataFrame) -> DataFrame:
        wanted = cut(nodes.join(keys, "key").select("key", F.col("row._row").alias("_row")))
        sent = docs.sparkSession.sparkContext.broadcast(row_map(wanted.select(place)))

        def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            squeeze, bits = zstandard.ZstdCompressor(level=1, write_content_size=True, write_checksum=False).compress, sent.value
            for batch in slices(batches, "_text"):
                at = batch.column(2).to_numpy()
                batch = batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))
                data, offsets = flat(batch.column(1))
                text, at = data.tobytes(), offsets.tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze(text[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["_row", "body"])

        return whole.select("_row", "_text", place).mapInArrow(released(compress), "_row string, body binary").join(wanted, "_row").dropDuplicates(["key"]).select("key", "body")

    label = components(similar_links(marked.select("key", "n", "prefix"), nodes, bodies_of, shingle, tile)).select(F.col("u").alias("key"), F.col("v").alias("label"))
    best = nodes.join(label, "key", "left").groupBy(F.coalesce("label", "key").alias("label")).agg(F.min("row").alias("best"))
    winners = cut(best.select(F.col("best._row").alias("_row")))
    return named.join(winners, "_row", "left_semi").dropDuplicates(["_row"]).select(*names).toDF(*docs.columns)
