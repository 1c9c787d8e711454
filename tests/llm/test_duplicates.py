"""Substring, suffix-array and SimHash dedup, components, the pipeline."""

import hashlib
import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from sieveline.llm import components, queries, repeats, shingles, simhash, substring_dedup, suffix_dedup
from sieveline.llm.textops import Prefix, flat, mixed

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def spread(marks, window, n):
    gone = np.zeros(n, bool)
    for a in marks:
        gone[a : a + window] = True
    return gone


def brute_words(docs, window):
    first = {}
    for i, t in docs:
        w = WORD.findall(t or "")
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in docs:
        w = WORD.findall(t or "")
        gone = spread([a for a in range(len(w) - window + 1) if i is not None and first[tuple(w[a : a + window])] < i], window, len(w))
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def brute_bytes(docs, window):
    bodies = [(t or "").encode() for _, t in docs]
    times = Counter(b[a : a + window] for b in bodies for a in range(len(b) - window + 1))
    out = []
    for (i, _), b in zip(docs, bodies, strict=True):
        gone = spread([a for a in range(len(b) - window + 1) if times[b[a : a + window]] > 1], window, len(b))
        runs = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


def corpus(seed, words=True):
    """Texts that share passages, with edits, self-repeats, runs of one symbol, nulls and repeated rows."""
    r = random.Random(seed)
    vocabulary = ["the", "of", "xa", "é", "b", "ccc", "dd\n", "e,", "f.", "g"] + [f"w{i}" for i in range(30)]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(20, 150))] for _ in range(6)] + [["z"] * 140, ["p", "q"] * 70]
    docs = []
    for i in range(40):
        body = []
        for _ in range(r.randint(0, 4)):
            own = list(r.choice(passages))
            if r.random() < 0.4:
                own[r.randrange(len(own))] = "EDIT"
            body += own[r.randint(0, 10) :] + [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        docs.append((i, " ".join(body)))
    return docs + [(50, None), (51, ""), (52, " \n "), docs[5], (None, docs[6][1]), (7, docs[8][1]), (60, "z " * 400)]


@pytest.mark.parametrize("seed", [1, 2])
def test_words_against_brute_force(spark, seed):
    docs = corpus(seed)
    for window, k in ((50, 12), (12, 4)):
        df = spark.createDataFrame(docs, SCHEMA).repartition(3)
        spans = substring_dedup.repeated_spans(df.selectExpr("doc_id as id", "text"), window, k)
        assert spans.count()
        got = repeats.with_documents(df.selectExpr("doc_id as id", "text"), spans, "left").select("id", "body", "spans").mapInArrow(substring_dedup._shorten(window, False), substring_dedup.FIELDS)
        assert Counter(map(tuple, got.collect())) == brute_words(docs, window)


@pytest.mark.parametrize(("seed", "bound"), [(1, 1 << 15), (2, 40), (1, 1)])
def test_bytes_against_brute_force(spark, seed, bound):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    for window in (200, 40):
        got = suffix_dedup.shorten(df, window=window, bound=bound)
        assert Counter(map(tuple, got.collect())) == brute_bytes(docs, window)


def test_whole_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    for name, want in (("op4_substring_dedup", brute_words(docs, 50)), ("op7_suffix_dedup", brute_bytes(docs, 200))):
        assert Counter(map(tuple, queries.queries()[name](spark, d).collect())) == want
        assert Counter(con.sql(queries.oracle_sql()[name]).fetchall()) == want


def test_longer_than_a_block(spark):
    """Texts that are looked at in several rounds."""
    r = random.Random(9)
    shared = [f"s{r.randrange(10**6)}" for _ in range(90)]
    long_words = [f"w{r.randrange(10**6)}" for _ in range(repeats.BLOCK + 60)]
    long_words[repeats.BLOCK - 40 : repeats.BLOCK + 50] = shared
    docs = [(1, " ".join(shared)), (2, " ".join(long_words)), (3, "z" * (repeats.BLOCK + 700)), (4, "q" * 150 + "z" * 250)]
    df = spark.createDataFrame(docs, SCHEMA)
    words = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.shorten(df).collect()}
    assert words == {1: (90, 0), 2: (repeats.BLOCK + 60, 90), 3: (1, 0), 4: (1, 0)}
    rows = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.shorten(df).collect()}
    assert rows == {1: (len(docs[0][1]), 1), 2: (len(docs[0][1]), 1), 3: (repeats.BLOCK + 700, 1), 4: (250, 1)}


def test_many_contents_around_one_passage(spark):
    """A group that is parted again and again, down to whole windows."""
    r = random.Random(11)
    line = "".join(r.choice("abcdefgh ") for _ in range(230))
    docs = [(i, "".join(r.choice("ijklm") for _ in range(r.randint(0, 60))) + line + "".join(r.choice("nopqr") for _ in range(r.randint(0, 60)))) for i in range(120)]
    for bound in (1 << 15, 200, 1):
        assert Counter(map(tuple, suffix_dedup.shorten(spark.createDataFrame(docs, SCHEMA), bound=bound).collect())) == brute_bytes(docs, 200)


def test_spans_are_verified_at_their_source():
    text = b"some words of a text"
    repeats.verified(text, [0, 5], [4, 10], [repeats.digest(b"some"), None])
    with pytest.raises(ValueError, match="seed"):
        repeats.verified(text, [0], [4], [repeats.digest(b"sums")])


def test_paths_are_compacted(spark):
    """Walks that share a stretch become paths that begin and end where they part."""
    walks = [(1, 1, b"a b c d e f g"), (1, 2, b"x b c d e f y"), (1, 3, b"c d e")]
    got = substring_dedup.nonbranching_paths(spark.createDataFrame(walks, "m long, c long, content binary"), 3).collect()
    paths = {(r.c, r.place): r.n for r in got}
    # windows of three words: abc bcd cde def efg; xbc bcd cde def efy; cde
    assert paths == {(1, 0): 1, (1, 1): 1, (1, 2): 1, (1, 3): 1, (1, 4): 1, (2, 0): 1, (2, 1): 1, (2, 2): 1, (2, 3): 1, (2, 4): 1, (3, 0): 1}
    two = substring_dedup.nonbranching_paths(spark.createDataFrame(walks[:2], "m long, c long, content binary"), 3).collect()
    assert {(r.c, r.place): r.n for r in two} == {(1, 0): 1, (1, 1): 3, (1, 4): 1, (2, 0): 1, (2, 1): 3, (2, 4): 1}
    assert len({r.edge for r in two if r.n == 3}) == 1


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("a", "x" * 300, 1), (None, "x" * 300, 2), ("b", "short", 3)], "doc_id string, text string, body int")
    got = {(r.doc_id, r.body): r.text for r in suffix_dedup.deduplicated(docs).collect()}
    assert got == {("a", 1): "", (None, 2): "", ("b", 3): "short"}
    for run in (substring_dedup.shorten, suffix_dedup.shorten):
        with pytest.raises(TypeError):
            run(docs)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA + ", spans int, id string")
    assert substring_dedup.shorten(empty).count() == suffix_dedup.shorten(empty).count() == simhash.component_ids(empty).count() == 0
    assert suffix_dedup.deduplicated(empty).columns == empty.columns and simhash.one_of_each(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=0, max_size=80), min_size=1, max_size=5), st.integers(17, 24))
def test_suffix_order(texts, window):
    contents = [t.encode() for t in texts if len(t) >= window]
    if contents:
        data = np.frombuffer(b"".join(contents), np.uint8)
        starts = np.concatenate([sum(map(len, contents[:i])) + np.arange(len(c) - window + 1) for i, c in enumerate(contents)])
        order = suffix_dedup.SuffixOrder(data, starts, window)
        held = [data[s : s + window].tobytes() for s in order.starts]
        assert held == sorted(held) and (order.starts == starts[order.order]).all()
        assert order.same.tolist() == [False] + [a == b for a, b in zip(held[:-1], held[1:], strict=True)]


def test_hash_collisions_are_found(monkeypatch):
    """With a useless hash the order comes from the bytes."""
    data = np.frombuffer(random.Random(0).randbytes(40) * 3 + b"a" * 60, np.uint8) & 1
    starts = np.arange(len(data) - 30)
    monkeypatch.setattr(suffix_dedup, "Prefix", lambda d: Prefix(np.zeros(len(d), np.uint8)))
    order = suffix_dedup.SuffixOrder(data, starts, 30)
    held = [data[s : s + 30].tobytes() for s in order.starts]
    assert held == sorted(held) and order.same.tolist() == [False] + [a == b for a, b in zip(held[:-1], held[1:], strict=True)]


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def joined_up(values, ids, radius=2):
    label = list(range(len(values)))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i, x in enumerate(values):
        for j in range(i):
            if (x ^ values[j]).bit_count() <= radius:
                label[find(i)] = find(j)
    roots = [find(i) for i in range(len(values))]
    least = {}
    for r, i in zip(roots, ids, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [least[r] for r in roots]


def test_op10(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(900, None), (901, ""), (902, "One"), (903, "one"), (904, "A b"), (None, "one"), (None, "q r s"), docs[3], (905, docs[4][1] + " x")]
    values = [fingerprint(t) for _, t in docs]
    want = Counter(zip([i for i, _ in docs], [f"{v:016x}" for v in values], joined_up(values, [i for i, _ in docs]), strict=True))
    df = spark.createDataFrame(docs, SCHEMA)
    assert Counter(map(tuple, simhash.component_ids(df).collect())) == want


@pytest.mark.parametrize("tile", [8, 4096])
def test_tiles_lose_no_link(spark, tile):
    r = np.random.default_rng(1)
    values = {0, (1 << 64) - 1}
    for base in r.integers(0, 1 << 63, 3).tolist():
        for _ in range(150):
            x = base
            for k in r.choice(64, r.integers(0, 5), False):
                x ^= 1 << int(k)
            values.add(x)
    values = sorted(values)
    rows = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(values)]
    got = {g.simhash: g.component_id for g in simhash.groups(spark.createDataFrame(rows, "doc_id long, simhash long"), tile=tile).collect()}
    assert [got[s] for _, s in rows] == joined_up(values, range(len(values)))


def five_words(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1))))


def similar_groups(docs):
    """The smallest id of each row's component under a five-word Jaccard similarity of at least 0.8, by brute force."""
    sets = [five_words(t) for _, t in docs]
    label = list(range(len(docs)))
    places = {}
    for i, s in enumerate(sets):
        for g in s or [None]:
            places.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s or [None] for j in places[g] if j < i}:
            same = len(s & sets[j])
            if 5 * same >= 4 * (len(s) + len(sets[j]) - same) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    groups = {}
    for (i, _), x in zip(docs, label, strict=True):
        groups.setdefault(x, []).append(i)
    return Counter(min((i for i in ids if i is not None), default=None) for ids in groups.values())


@pytest.mark.parametrize("bits", [1, 18])
def test_near_copies_against_brute_force(spark, bits, monkeypatch):
    """Copies with edits, chains of them, one line that all share, empty texts and repeated rows, through the pipeline's stage."""
    monkeypatch.setattr(shingles, "SKETCH_BITS", bits)
    r = random.Random(bits)
    line = "this very line stands in all of the texts".split()
    docs = []
    for base in range(12):
        body = [f"w{r.randrange(300)}" for _ in range(r.choice([12, 40, 150]))]
        for _ in range(8):
            docs.append((len(docs), " ".join([*line, *body])))
            for _ in range(r.randint(1, 2)):  # each copy is edited further
                body[r.randrange(len(body))] = f"E{r.randrange(10**6)}"
    docs += [(500, None), (501, ""), (502, "One"), (503, "one"), (504, "A b"), (None, "one"), (None, "q r s"), docs[3], (505, docs[4][1] + " x")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, SCHEMA).repartition(3), "").collect()
    assert Counter(x.doc_id for x in got) == similar_groups(docs)


def votes(texts):
    """The bits of each five-word text's one shingle, as votes of one or minus one."""
    h, _ = shingles.shingle_sets(*flat(pa.array(texts)))
    return np.unpackbits(mixed(h.copy())[:, None].view(np.uint8), axis=1).astype(int) * 2 - 1


def far_pair(r, shared=40, own=5):
    """Two texts of a similarity of 0.8 with fingerprints as far apart as a greedy choice of words makes them."""
    words, total = [f"s{r.randrange(10**9)}" for _ in range(4)], np.zeros(64, int)
    for _ in range(shared):  # keep the votes of what is shared even
        some = [f"c{r.randrange(10**9)}" for _ in range(300)]
        cast = votes([" ".join([*words[-4:], w]) for w in some])
        k = int(((total + cast) ** 2).sum(1).argmin())
        total += cast[k]
        words.append(some[k])
    texts, marks = [], []
    for sign in (1, -1):
        text, mine = list(words), total.copy()
        for _ in range(own):
            some = [f"o{r.randrange(10**9)}" for _ in range(300)]
            cast = votes([" ".join([*text[-4:], w]) for w in some])
            k = int((sign * np.sign(mine + cast)).sum(1).argmax())
            mine += cast[k]
            text.append(some[k])
        texts.append(" ".join(text))
        marks.append(mine > 0)
    return texts, int((marks[0] != marks[1]).sum())


@pytest.mark.parametrize("tile", [3, 4096])
def test_near_copies_whose_fingerprints_are_far(spark, tile):
    """Sets of a similarity of just 0.8 and just under it; some with fingerprints over 24 bits apart; in tiles as well."""
    r = random.Random(7)
    word = iter(f"v{k}" for k in itertools.count())
    texts, bits = [], []
    for _ in range(6):
        pair, differ = far_pair(r)
        texts += pair
        bits.append(differ)
    assert min(bits) > 24
    for _ in range(40):
        n = r.choice([27, 36, 45, 450])  # shingles of each; a ninth of them are its own
        for less in (0, 1):
            shared = " ".join(next(word) for _ in range(n * 8 // 9 - less + 4))
            texts += [f"{shared} {' '.join(next(word) for _ in range(n // 9 + less))}" for _ in range(2)]
    docs = list(enumerate(texts))
    got = simhash.one_of_each(spark.createDataFrame(docs, SCHEMA).repartition(3), tile=tile).collect()
    want = similar_groups(docs)
    assert Counter(x.doc_id for x in got) == want and not [i for i in want if i < 12 and i % 2]


def test_near_copies_of_a_table(spark):
    docs = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, SCHEMA), "").collect()
    assert Counter(x.doc_id for x in got) == similar_groups(docs)


@pytest.mark.parametrize("part", [5, 1 << 18])
@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, monkeypatch, shape, part):
    monkeypatch.setattr(components, "PART", part)
    r = random.Random(4)
    links = {"chain": [(i, i + 1) for i in range(60)], "star": [(5, i) for i in range(40)], "random": [(r.randrange(80), r.randrange(80)) for _ in range(50)], "none": []}[shape]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "u long, v long").repartition(4)).collect()))
    label = {x: x for p in links for x in p}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if k != v}


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, d).cache()
        assert docs.columns == names, name
        kept.append(docs.count())
    assert kept[0] > kept[1] >= kept[2] > kept[3] == kept[4]
    want = brute_bytes([(r.doc_id, r.text) for r in before.collect()], 200)
    assert sum(n - gone for _, n, gone, _, _ in want) >= sum(len(r.text.encode()) for r in docs.collect()) > 0
    packed = corpus_pipeline.run(spark, d)
    assert packed.select("doc_id").distinct().count() == kept[4]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "simhash_near_dedup", "suffix_array_dedup", "packing"]


def test_language_stage_rejects_what_is_not_learned(spark):
    """Random letters and languages that no row is labelled with go; of the rows that were there, hardly any does."""
    r = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("size(split(trim(text), ' +')) >= 10")
    odd = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)) for n in (10, 30, 30, 300, 3000)]
    odd.append("Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.")
    odd.append("Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.")
    odd.append("すべての人間は、 生まれながらにして 自由であり、 かつ、 尊厳と 権利とについて 平等である。 人間は、 理性と 良心とを 授けられており、 互いに 同胞の 精神をもって 行動しなければならない。")
    more = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    kept = [x.doc_id for x in corpus_pipeline.language(spark, docs.union(more), "").select("doc_id").collect()]
    assert not [i for i in kept if i >= 10**9] and len(kept) >= 0.99 * docs.count()


def test_pipeline_hard_rows(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int, simhash string, rest int, score double"
    long_text = " ".join(f"word{i} der die und" for i in range(4000))
    rows = [(1, None, None, None, None, 1, "a", 1, 1.0), (None, long_text, "de", "s", 1, 1, "b", 1, 1.0), (2, long_text, "de", "s", 1, None, None, None, None), (2, long_text, "de", "s", 1, None, None, None, None), (3, "", "en", "", 0, 0, "", 0, 0.0)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == table.columns
        docs.collect()
        corpus_pipeline.packed(spark, docs, sf_dir).collect()
