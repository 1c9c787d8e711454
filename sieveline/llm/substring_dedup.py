"""Substring dedup by De Bruijn compaction.

The edges of the graph are the ``window``-word k-mers of all documents, its
nodes their (window - 1)-word ends.  A repeated edge is one that also starts in
a document with a smaller id.

* Edges are grouped by minimizer, as compacting assemblers do: a document's walk
  through the graph is a chain of segments (see ``repeats``), and an edge lies in
  the segments of its minimizer alone.  Segments whose minimizer stands in one
  document only are no part of the graph.  Equal segments are one walk, whose
  source is its first document.
* Where different walks share a minimizer, each is taken apart into its edges.
  A group-by on the nodes finds those that the walks do not all enter and leave
  by the same edge, or at which a walk begins or ends.  A join with these nodes
  cuts every walk into its nonbranching paths, each one row from then on; equal
  paths begin with equal edges.
* A path of which an earlier document has the source is repeated, and so is each
  later occurrence of a walk.  It becomes a span only with a digest of the text
  at the source coordinates (document, text hash, first word, number of words);
  the document's own words are compared with it before they are removed.

Defined results: null and blank texts have no words and stay as they are; a very
long text is taken block by block, with about 60 bytes of arrays a byte while
its words are found; rows with a null id are neither source nor shortened; rows
with equal ids do not shorten each other; columns beside id and text are not
looked at, whatever their names; a table with no repeats comes back whole; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .frames import cut, whole_number
from .textops import Words, flat, offsets_of, released, slices, word_hashes

WINDOW = 50
#: Words of the k-gram that places an edge.
MINIMIZER = 12
#: Bytes of content that are handed on at once.
CHUNK = 1 << 19


def symbols(data: np.ndarray, offsets: np.ndarray):
    words = Words(data, offsets)
    joined, at = words.join()
    ends = at + words.lengths
    return word_hashes(words), words.first, joined.tobytes(), lambda i: at[i], lambda i: ends[i - 1]


WALKS = "m long, c long, id long, key long, start long, windows int, branching boolean, content binary, digest binary"
VISITS = "m long, c long, place int, node long, entry long, edge long"


def _walks(window: int):
    """From documents with walks: the words of those that branch, and digests of those that occur again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in WALKS.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
        for batch in batches:
            bounds, wanted = repeats.lists(batch.column(3))
            m, c, loc, again, branching = (wanted.field(i).to_pylist() for i in range(5))
            held: list[tuple] = []
            size = 0
            for row, (doc, key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), repeats.bodies(batch.column(2)), strict=True)):
                words = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
                joined, at = words.join()
                whole, begin, end = joined.tobytes(), at.tolist(), (at + words.lengths).tolist()
                for i in range(bounds[row], bounds[row + 1]):
                    start, n = loc[i] >> 22, loc[i] >> 1 & 0x1FFFFF
                    content = whole[begin[start] : end[start + n - 2 + window]]
                    held.append((m[i], c[i], doc, key, start, n, branching[i], content if branching[i] else None, repeats.digest(content) if again[i] else None))
                    size += len(content)
                    if size >= CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return released(run)


def _visits(window: int, seed: int):
    """From walks (m, c, content): the nodes they pass, with the edges by which they enter and leave (null where they begin or end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = xxhash.xxh3_64_intdigest
        for batch in slices(batches, "content"):
            data, offsets = flat(batch.column(2))
            words = Words(data, offsets)
            joined, at = words.join()
            whole, end = joined.tobytes(), at + words.lengths
            n = np.diff(words.first) - window + 1
            row = np.repeat(np.arange(len(n)), n)
            first = np.arange(len(row)) + np.repeat(words.first[:-1] - offsets_of(n)[:-1], n)
            edge = np.fromiter((hashed(whole[a:b], seed) for a, b in zip(at[first].tolist(), end[first + window - 1].tolist(), strict=True)), np.uint64, len(first)).view(np.int64)
            place = first - words.first[row]
            # a node before each edge, and one after the last
            leads = np.insert(first, offsets_of(n)[1:], words.first[1:] - window + 1)
            node = np.fromiter((hashed(whole[a:b], seed) for a, b in zip(at[leads].tolist(), end[leads + window - 2].tolist(), strict=True)), np.uint64, len(leads)).view(np.int64)
            walk = np.repeat(np.arange(len(n)), n + 1)
            place = leads - words.first[walk]
            ends = np.arange(len(leads)) - np.repeat(offsets_of(n + 1)[:-1], n + 1)
            leaves = ends < np.repeat(n, n + 1)
            enters = ends > 0
            out, into = np.zeros(len(leads), np.int64), np.zeros(len(leads), np.int64)
            out[leaves], into[enters] = edge, edge
            take = pa.array(walk)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(place.astype(np.int32)), pa.array(node), pa.array(into, mask=~enters), pa.array(out, mask=~leaves)], names=["m", "c", "place", "node", "entry", "edge"])

    return released(run)


def _path_digests(window: int):
    """From (m, edge, place, n, content) of the source of each repeated path: (m, edge, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "content"):
            words = Words(*flat(batch.column(4)))
            joined, at = words.join()
            whole, end = joined.tobytes(), at + words.lengths
            first = words.first[:-1] + batch.column(2).to_numpy()
            last = first + batch.column(3).to_numpy() - 2 + window
            digests = [repeats.digest(whole[a:b]) for a, b in zip(at[first].tolist(), end[last].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary())], names=["m", "edge", "digest"])

    return released(run)


def nonbranching_paths(walks: DataFrame, window: int, seed: int = 0) -> DataFrame:
    """(m, c, place, n, edge): walks (m, c, content) cut where paths branch; ``edge`` is the first of the n."""
    visits = walks.select("m", "c", "content").mapInArrow(_visits(window, seed), VISITS)
    degree = visits.groupBy("m", "node").agg(F.min("entry").alias("e1"), F.max("entry").alias("e2"), F.count("entry").alias("entries"), F.min("edge").alias("o1"), F.max("edge").alias("o2"), F.count("edge").alias("exits"), F.count("*").alias("n"))
    forks = cut(degree.where("e1 != e2 or o1 != o2 or entries < n or exits < n").select("m", "node"))
    cuts = visits.select("m", "c", "place", "node", "edge").join(forks, ["m", "node"]).groupBy("m", "c").agg(F.sort_array(F.collect_set(F.struct("place", "edge"))).alias("cuts"))
    between = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda i: F.struct(F.col("cuts")[i]["place"].alias("place"), (F.col("cuts")[i + 1]["place"] - F.col("cuts")[i]["place"]).alias("n"), F.col("cuts")[i]["edge"].alias("edge")))
    return cuts.select("m", "c", F.explode(between).alias("path")).select("m", "c", "path.*")


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = MINIMIZER, seed: int = 0) -> DataFrame:
    """(id, key, spans) of the documents (id, text) that have repeated windows."""
    table = repeats.segment_table(docs.where("id is not null"), symbols, window, k, seed)
    # small sides are cut before they are joined, so that the shuffles that meet can be split where a key is hot
    met = cut(table.groupBy("m").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("m"))
    met = cut(table.join(met, "m"))
    distinct = cut(met.groupBy("m", "c").agg(F.min(F.struct("id", "key", "loc")).alias("source"), F.max("id").alias("last")))
    branching = cut(distinct.groupBy("m").agg(F.count("*").alias("n"), F.min("source.id").alias("low"), F.max("source.id").alias("high")).where("n > 1 and low < high").select("m", F.lit(True).alias("branching")))
    wanted = distinct.join(branching, "m", "left").withColumn("again", F.col("last") > F.col("source.id")).where("again or branching")
    wanted = wanted.groupBy("source.id", "source.key").agg(F.collect_list(F.struct("m", "c", F.col("source.loc").alias("loc"), "again", F.coalesce("branching", F.lit(False)).alias("branching"))).alias("wanted"))
    walks = cut(repeats.with_documents(docs, wanted, "inner").select("id", "key", "body", "wanted").mapInArrow(_walks(window), WALKS))

    n = F.shiftright("loc", 1).bitwiseAND(0x1FFFFF).cast("int")
    again = walks.where("digest is not null").select("m", "c", "digest", F.col("id").alias("first"))
    later = met.join(again, ["m", "c"]).where("id > first").select("id", "key", F.shiftright("loc", 22).alias("start"), n.alias("n"), "digest")

    taken = walks.where("branching")
    # of repeated rows each has brought its walks, so first documents come from the table that has each once
    paths = cut(nonbranching_paths(taken, window, seed).join(distinct.select("m", "c", F.col("source.id").alias("id")), ["m", "c"]))
    repeated = cut(paths.groupBy("m", "edge").agg(F.min(F.struct("id", "c", "place", "n")).alias("source"), F.max("id").alias("last")).where("source.id < last").select("m", "edge", "source"))
    sources = repeated.select("m", "edge", "source.c", "source.place", "source.n").join(taken.select("m", "c", "content"), ["m", "c"]).select("m", "edge", "place", "n", "content")
    sources = cut(sources.mapInArrow(_path_digests(window), "m long, edge long, digest binary").join(repeated.select("m", "edge", F.col("source.id").alias("first")), ["m", "edge"]))
    parts = cut(paths.join(sources, ["m", "edge"]).where("id > first").select("m", "c", "id", "place", F.col("n").alias("windows"), "digest"))
    firsts = met.join(parts, ["m", "c", "id"]).select("id", "key", (F.shiftright("loc", 22) + F.col("place")).alias("start"), F.col("windows").alias("n"), "digest")
    return repeats.per_document(later.union(firsts))


FIELDS = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _shorten(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans = [], repeats.SpanLists(batch.column(2))
            for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), repeats.bodies(batch.column(1)), strict=True)):
                words = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
                n = len(words)
                gone = np.zeros(n, bool)
                start, windows, digests = spans.row(i)
                if len(start):
                    joined, at = words.join()
                    repeats.verified(joined.tobytes(), at[start].tolist(), (at + words.lengths)[start + windows - 2 + window].tolist(), digests)
                    gone = repeats.widened(repeats.marked_windows(start, windows, n - window + 1), window, n)
                body = words.data[words.solid]
                lengths = words.lengths[~gone]
                out = np.full(int(lengths.sum()) + max(len(lengths) - 1, 0), 32, np.uint8)
                out[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = body[np.repeat(~gone, words.lengths)]
                kept = out.tobytes()
                rows.append((doc, n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            arrays = [pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays if with_text else arrays[:4], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text])

    return released(run)


def shorten(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False, seed: int = 0) -> DataFrame:
    """Per document: words, removed words and the hash of the kept words; ``with_text`` adds those words, one space apart."""
    whole_number(docs, id_col)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    joined = repeats.with_documents(own, repeated_spans(own, window, seed=seed), "left")
    return joined.select("id", "body", "spans").mapInArrow(_shorten(window, with_text), FIELDS + ", kept string" * with_text)
