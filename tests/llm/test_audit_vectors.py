"""Filter audit, centroid clustering, top-k search."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import centroids, filter_audit, queries, topk_search

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


# Filter audit.


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    parts = defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = set()
        fails |= {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and least[t] < i else set()
        parts[lang or ""].append((i, fails))
    out = {}
    for part, rows in parts.items():
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                earlier = sum(f in r[1] for r in rows) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), earlier, sum(r[1] == {f} for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone), f]
        for (p, _, _), row in out.items():
            if p == part and row[-1] in total:
                row[-1] = total[row[-1]]
    return {(*k, *v) for k, v in out.items()}


def audit_corpus(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["Upper", "LOUD", "a#b", "x|y", "é", "中文"]
    texts = [None, "", " \t", "A", "#", " ", "word " * 300, " ".join(words[:250])]
    texts += [" ".join(r.choice(words[: r.choice((5, 100, 406))]) for _ in range(r.choice((3, 150, 200, 260)))) for _ in range(40)]
    rows = [(r.choice((k, 500 - k, -k)), r.choice(texts), r.choice(("en", "de", "", None))) for k in range(200)]
    rows += [(7000 + k, texts[7], "en") for k in range(100)]  # a text that a third of all rows have
    rows += [(6999, texts[7], "fr"), (6999, texts[7], "fr"), (6999, texts[6], "fr"), (None, texts[7], "en"), (None, texts[9], None)]
    r.shuffle(rows)
    labels = [(i, r.choice((0, 1, None)), r.choice((0, 1, None))) for i, *_ in rows if r.random() < 0.6]
    return rows, labels


@pytest.mark.parametrize("seed,cache", [(1, 1 << 24), (2, 3000), (3, 0)])
def test_audit_brute_force(spark, monkeypatch, seed, cache):
    monkeypatch.setattr(filter_audit, "CACHE_BYTES", cache)
    docs, labels = audit_corpus(seed)
    frame = spark.createDataFrame(docs, DOCS).withColumns({"part": F.lit(1), "mask": F.lit("x"), "good": F.lit(2)}).repartition(5)
    got = [tuple(r) for r in filter_audit.audit(frame, spark.createDataFrame(labels, LABELS)).collect()]
    assert len(got) == len(set(got)) == 600 * len({d[2] or "" for d in docs})
    assert set(got) == brute_audit(docs, labels)


def test_audit_chains_compare_texts(spark, monkeypatch):
    """Texts of one fingerprint are told apart by their contents."""
    records = list(filter_audit.combined(iter([(3, b"one", "p"), (1, b"two", "p"), (2, b"one", "p"), (4, None, None), (5, bytearray(b""), "q")])))
    same = sorted(((0, k[1]), v) for k, v in records if v[0] is not None)
    known = [v for _, v in records if v[0] is None]
    assert [v[1] for v in known] == [3, 5] and all(v[2] & filter_audit.DUPLICATE for v in known)
    again = [((0, 9), (same[0][1][0], 9, 0, Counter({"p": 2})))]
    assert [(i, bool(m & filter_audit.DUPLICATE), n) for i, _, m, n in filter_audit.decided(iter(same + again))] == [(1, False, 1), (2, False, 1), (4, False, 1), (9, True, 2)]


def test_non_minimum_ids_and_empty(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (0, "b", "y"), (None, "a", "y")], DOCS)
    assert sorted(r[0] for r in filter_audit.non_minimum_ids(docs).collect()) == [2, 3]
    none = filter_audit.audit(docs.limit(0), spark.createDataFrame([], LABELS))
    assert none.count() == 0 and none.columns == [f.split()[0] for f in filter_audit.ROWS.split(", ")]


# Centroid clustering.


def brute_clusters(rows, k, rounds, dims, seed=2, scale=256):
    kept = [(i, [math.floor(scale * v) for v in x]) for i, x in rows if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    c = [x for _, x in first]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, x in kept:
            own[near(x)[1]].append(x)
        c = [[sum(v) // len(own[j]) for v in zip(*own[j], strict=True)] if j in own else c[j] for j in range(len(c))]
    found = [(i, *near(x)) for i, x in kept]
    spent = Counter()
    for _, d, j in found:
        spent[j] += d
    return Counter((i, j, d, spent[j], sum(spent.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found)


def vectors(seed, n, dims, spread=1.0, grid=None):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(12, dims)) * spread
    x = middles[r.integers(0, 12, n)] + r.normal(size=(n, dims)) * 0.3
    if grid:
        x = np.round(x * grid) / grid
    rows = [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(n + k, list(rows[3][1])) for k in range(n // 3)]  # copies
    rows += [(5, rows[5][1]), (5, rows[6][1])]  # repeated ids
    rows += [(n * 2, None), (n * 2 + 1, []), (n * 2 + 2, rows[0][1][:-1]), (n * 2 + 3, [*rows[0][1][:-1], float("nan")]), (n * 2 + 4, [*rows[0][1][:-1], float("-inf")]), (n * 2 + 5, [*rows[0][1][:-1], None]), (None, rows[1][1])]
    return rows


@pytest.mark.parametrize("seed,k,spread,grid", [(1, 40, 1.0, None), (2, 9, 0.2, 4), (3, 40, 3000.0, None), (4, 2, 1.0, None), (5, 1, 1.0, 2), (6, 500, 1.0, 1)])
def test_clusters_brute_force(spark, seed, k, spread, grid):
    rows = vectors(seed, 240, 8, spread, grid)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "near": F.lit(2), "id": F.lit(3), "cluster": F.lit(4)}).repartition(4)
    got = centroids.cluster(frame, k=k, dims=8)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_clusters(rows, k, 5, 8)


def test_bounds_save_distances_and_certify():
    """After small moves few distances are computed, and every assignment is that of a full search."""
    r = np.random.default_rng(0)
    c = r.integers(-300, 300, (40, 16))
    x = c[r.integers(0, 40, 3000)] + r.integers(-40, 40, (3000, 16))
    near, bound = centroids.searched(x, c, 10)
    asked = []
    plain = centroids.squared
    for step in range(6):
        new = c + r.integers(-3, 4, c.shape) * (step % 3)
        drift = centroids.above(((new - c) ** 2).sum(1))
        c = new
        centroids.squared = lambda a, b: (asked.append(a.shape[0] * b.shape[-2]), plain(a, b))[1]
        try:
            near, bound, used = centroids.moved(x, near, bound, c, drift, 10 - step)
        finally:
            centroids.squared = plain
        d = plain(x, c)
        assert (near[:, 0] == d.argmin(1)).all() and used <= 10
        own = np.take_along_axis(d, near, 1)
        assert (bound[:, 0] ** 2 >= own[:, 0] * (1 - 1e-9)).all() and (np.maximum(bound[:, 1:-1], 0) ** 2 <= own[:, 1:] * (1 + 1e-9) + 1e-9).all()
        rest = np.sort(np.where((np.arange(40) == near[:, :, None]).any(1), 1 << 60, d), axis=1)[:, 0]
        assert (np.maximum(bound[:, -1], 0) ** 2 <= rest * (1 + 1e-9) + 1e-9).all()
    assert sum(asked) < 0.1 * 6 * x.shape[0] * 40


def test_clusters_of_extremes(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(1, [1e300, -1e300]), (2, [0.0, 0.0]), (3, [-1e300, 1e300])]
    got = {r.vec_id: r for r in centroids.cluster(spark.createDataFrame(rows, schema), k=1, dims=2).collect()}
    assert len(got) == 3 and all(0 <= r.distance < 1 << 63 and 0 <= r.inertia < 1 << 63 for r in got.values())
    for some in ([], [(1, None)], [(None, [1.0, 2.0])]):
        assert centroids.cluster(spark.createDataFrame(some, schema), k=4, dims=2).count() == 0


def test_squared_agrees_beyond_floats():
    r = np.random.default_rng(1)
    x, c = (r.integers(-centroids.limit(64), centroids.limit(64), (n, 64)) for n in (700, 5))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in c] for p in x[:5]]
    assert centroids.squared(x, c)[:5].tolist() == want
    assert centroids.squared(x, c[None].repeat(700, 0)).tolist() == centroids.squared(x, c).tolist()


# Top-k search.


def brute_search(rows, k, step, scale=1024):
    kept = [(i, [math.floor(scale * v) for v in x]) for i, x in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = Counter()
    for a, (i, x) in enumerate(kept):
        if i % step == 0:
            scores = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), j) for b, (j, y) in enumerate(kept) if b != a and len(x) == len(y))[:k]
            out.update((i, rank, j, -s) for rank, (s, j) in enumerate(scores, 1))
    return out


@pytest.mark.parametrize("seed,spread,grid,block,shard,tile", [(1, 1.0, None, 4096, 65536, 4096), (2, 0.1, 2, 7, 20, 9), (3, 5000.0, None, 3, 11, 4), (4, 1.0, 1, 50, 5, 5), (5, 1e5, None, 16, 64, 32)])
def test_search_brute_force(spark, seed, spread, grid, block, shard, tile):
    rows = vectors(seed, 200, 6, spread, grid) + [(900, [1.0, 2.0]), (901, [3.0, -1.0]), (950, [0.5]), (None, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"place": F.lit(1), "shard": F.lit(2), "id": F.lit(3), "x": F.lit(4)}).repartition(4)
    got = topk_search.search(frame, F.col("vec_id") % 5 == 0, block=block, shard=shard, tile=tile)
    assert Counter(map(tuple, got.collect())) == brute_search(rows, 10, 5)


def test_search_ties_and_few(spark):
    schema = "vec_id long, embedding array<float>"
    same = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(0, 30)], schema)
    got = topk_search.search(same, F.col("vec_id") == 3, k=5).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(3, n, i, 1 << 20) for n, i in enumerate((0, 1, 2, 4, 5), 1)]
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)
    assert [tuple(r) for r in topk_search.search(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2 << 20)]
    for some in ([], [(1, [1.0])], [(0, None)], [(0, [])]):
        assert topk_search.search(spark.createDataFrame(some, schema), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_centroids", "op13_topk_search"])
def test_queries_and_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy()))
    assert rows(got) == rows(want)
