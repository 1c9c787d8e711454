"""Text primitives, quality rules, quality classifier, language id."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm import language_id, quality_classifier, quality_rules, queries, textops
from sieveline.llm.frames import fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [None, "", "  \n\n a", "a b c d e a b c d e", "é ü\né ü\n\r\n x\x0bx", "\n" * 5, "a\n" * 40, "| # *", "a b\na b\n a b"]


def counts(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(grams)
    again = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t|#", max_size=60)), max_size=6))
def test_statistics(texts):
    texts += EDGES
    got, features = quality_rules.statistics(*textops.flat(pa.array(texts, pa.string())))
    assert [tuple(int(got[c][i]) for c in quality_rules.COUNTS) for i in range(len(texts))] == [counts(t) for t in texts]
    assert np.isfinite(features).all()


def test_prefix_hashes():
    data = np.random.default_rng(0).integers(0, 4, 300).astype(np.uint8)
    windows = textops.Prefix(data).windows(7)
    held = [data[i : i + 7].tobytes() for i in range(len(data) - 6)]
    assert len(set(held)) == len(set(windows.tolist())) == len(set(zip(held, windows.tolist(), strict=True)))
    assert (textops.sliding_min(windows, 5) == [windows[i : i + 5].min() for i in range(len(windows) - 4)]).all()


def test_forest_is_monotone():
    random = np.random.default_rng(1)
    x = random.random((600, 2))
    y = ((x[:, 0] < 0.5) ^ (random.random(600) < 0.2)).astype(float)
    forest = quality_rules.fit_forest(x, y, [-1, 0])
    line = np.column_stack([np.linspace(-1, 2, 200), np.full(200, 0.3)])
    score = forest.score(line)
    assert (np.diff(score) <= 1e-12).all() and score[0] > 0.7 > 0.3 > score[-1]
    assert ((forest.score(x) > 0.5) == (x[:, 0] < 0.5)).mean() > 0.95
    assert quality_rules.fit_forest(x[:5], np.ones(5), [0, 0]).score(x[:2]).tolist() == [0.5, 0.5]


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return d, spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_op2(spark, tables):
    d, docs, labels = tables
    got = queries.op2_quality_rules(spark, d).toPandas().set_index("doc_id")
    text = docs.select("doc_id", "text").toPandas().set_index("doc_id").text
    assert len(got) == len(text)
    for i, t in text.items():
        row = got.loc[i]
        n, chars, symbols, dup, again = counts(t)
        assert tuple(row[list(quality_rules.COUNTS)]) == (n, chars, symbols, dup, again)
        assert row.base_failed == (n < 10 or 100 * again > 20 * n) and (not row.base_failed or not row.kept)
    held = labels.where(fold() == 0).toPandas().set_index("doc_id").join(got)
    assert held[(held.quality == 1) & ~held.base_failed].kept.mean() > 0.97 and held[held.quality == 0].kept.mean() < 0.1


def test_op3(spark, tables):
    d, docs, labels = tables
    got = queries.op3_quality_classifier(spark, d).toPandas().set_index("doc_id")
    assert len(got) == docs.count() and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    held = got[got.held_out].join(labels.toPandas().set_index("doc_id"), how="inner")
    assert (held.predicted == held.quality).mean() > 0.93 and ((held.score >= 0.5) == (held.quality == 1)).mean() > 0.93


def test_passages_and_forward_pass_by_hand():
    """Inputs counted word by word, and the network's score bag by bag."""
    texts = ["Alpha beta, 12 # x. " * 30, "", "one two three four"]
    counts, bags = quality_classifier.passages(*textops.flat(pa.array(texts)))
    assert bags.tolist() == [0, 3, 4, 5] and counts[:, quality_classifier.WIDTH - 3].tolist() == [64, 64, 22, 0, 4]
    for text, a, b in zip(texts, bags[:-1], bags[1:], strict=True):
        words = text.split()
        for k in range(a, b):
            own = words[64 * (k - a) : 64 * (k - a + 1)]
            assert counts[k, : quality_classifier.SHAPES].sum() == counts[k, quality_classifier.SHAPES : -3].sum() == len(own)
            assert counts[k, -2] == sum(n for n in Counter(own).values() if n > 1) and counts[k, -1] == own.count("#")
    random = np.random.default_rng(4)
    w = {k: random.normal(0, 0.3, s) for k, s in {"encode": (quality_classifier.WIDTH, 5), "encode_b": (5,), "tanh": (5, 3), "gate": (5, 3), "attend": (3,), "score": (5,), "score_b": (1,)}.items()}
    network = quality_classifier.Network(np.full(quality_classifier.WIDTH, 0.01), np.full(quality_classifier.WIDTH, 0.5), w)
    for got, a, b in zip(network.score(counts, bags), bags[:-1], bags[1:], strict=True):
        e, hs = [], []
        for row in counts[a:b].astype(float):
            held = max(row[-3], 1)
            x = np.append(np.append(row[:-3] / held, row[-3] / 64), row[-2:] / held)
            h = np.tanh((x - 0.01) / 0.5 @ w["encode"] + w["encode_b"])
            e.append(np.exp(np.dot(np.tanh(h @ w["tanh"]) / (1 + np.exp(-(h @ w["gate"]))), w["attend"])))
            hs.append(h)
        z = sum(x * h for x, h in zip(e, hs, strict=True)) / sum(e)
        assert abs(got - 1 / (1 + np.exp(-(z @ w["score"] + w["score_b"][0])))) < 1e-6


def test_fit_sees_every_passage(spark):
    """Only the last passage of a long text tells its label."""
    docs = [(i, "plain words here " * 2000 + ("# # # # " * 16 if i % 2 else "")) for i in range(60)]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i, _ in docs], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in quality_classifier.annotate(df, quality_classifier.fit(df, labels), ["doc_id"]).collect()}
    assert np.mean([got[i] == 1 - i % 2 for i, _ in docs]) > 0.95


def test_gradient():
    random = np.random.default_rng(3)
    x, bags, y = random.normal(size=(9, quality_classifier.WIDTH)), np.array([0, 2, 3, 9]), np.array([1.0, 0, 1])
    w = {k: random.normal(0, 0.3, s) for k, s in {"encode": (quality_classifier.WIDTH, 4), "encode_b": (4,), "tanh": (4, 3), "gate": (4, 3), "attend": (3,), "score": (4,), "score_b": (1,)}.items()}
    one = np.ones(3)
    loss = lambda: -np.mean(y * np.log(p := quality_classifier.forward(w, x, bags)["p"]) + (1 - y) * np.log(1 - p))
    for k, g in quality_classifier.backward(w, x, bags, y, one).items():
        at = tuple(0 for _ in w[k].shape)
        w[k][at] += 1e-5
        up = loss()
        w[k][at] -= 2e-5
        down = loss()
        w[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6, k


def test_op5(spark, tables):
    d, docs, _ = tables
    got = queries.op5_language_id(spark, d).toPandas().set_index("doc_id").join(docs.toPandas().set_index("doc_id").lang)
    assert len(got) == docs.count() and (got.lang == got.lang_pred)[got.held_out].mean() > 0.97


def test_language_scores_by_hand(spark):
    """A rare language is learned too, and scores are those of the counts."""
    docs = [(i, f"the dog and the cat number {i} went home", "en") for i in range(3000)] + [(5000 + i, "kissa ja koira menivät kotiin", "fi") for i in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.fit(df, 50)
    assert model.langs == ["en", "fi"]
    text = "the kissa"
    buckets, bounds, _ = language_id.grams(*textops.flat(pa.array([text])))
    assert len(buckets) == 3 * len(text) and bounds.tolist() == [0, 27]
    joint = [sum(float(model.log_prob[j][b]) for b in buckets) for j in range(2)]
    (row,) = language_id.annotate(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    best = int(np.argmax(joint))
    assert row.lang_pred == model.langs[best] and abs(row.score - 1 / (1 + np.exp(joint[1 - best] - joint[best]))) < 1e-9
    assert np.allclose(np.exp(model.log_prob).sum(1), 1)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, lang_pred int"
HARD = [(1, None, None, None, None, "x", 1, 2), (None, "der Hund und die Katze " * 5, "de", "s", 1, "y", None, None), (3, "", "en", "s", 0, None, 1, 1), (3, "", "en", "s", 0, None, 1, 1), (4, "12 34 !", "en", "s", 0, "", 0, 0), (5, "the dog and the cat " * 3000, "en", "s", 9, "", 0, 0)]


def test_hard_rows(spark):
    docs, empty = spark.createDataFrame(HARD, SCHEMA), spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([(3, 1, 0), (None, 1, 0), (5, None, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    for table in (docs, empty):
        n = table.count()
        forest = quality_rules.fit(table, labels)
        assert quality_rules.annotate(table, forest, ["doc_id"]).count() == n
        assert quality_rules.passed(table, forest).columns == table.columns
        assert quality_classifier.annotate(table, quality_classifier.fit(table, labels)).count() == n
        model = language_id.fit(table)
        found = [(r.lang_pred, r.score) for r in language_id.annotate(table, model, ["doc_id"]).orderBy("doc_id").collect()]
        assert len(found) == n and all(0 <= s <= 1 for _, s in found)
        assert language_id.identified(table, model).columns == table.columns
    # nulls first: de (null id), null text, empty, empty, no letter
    assert [f[0] for f in found] == [] and [r[0] for r in language_id.annotate(docs, language_id.fit(docs), ["doc_id"]).orderBy("doc_id").select("lang_pred").collect()][1:5] == ["und"] * 4


def test_op2_sample_is_bounded_by_ids(spark, monkeypatch):
    """Repeated ids and labels neither widen the sample nor change with the order of rows."""
    texts = [" ".join(["word", "other", "#"][i % 3] for i in range(n)) for n in range(12, 52)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(7, texts[k % 40] + " more") for k in range(300)] + [(None, "a b c")]
    labels = [(i, i % 2) for i in range(40)] + [(7, 0), (7, 1), (None, 1)]
    seen = []
    monkeypatch.setattr(quality_rules, "fit_forest", lambda x, y, signs: seen.append((x, y)))
    for turn in (1, -1):
        quality_rules.fit(spark.createDataFrame(docs[::turn], "doc_id long, text string").repartition(3), spark.createDataFrame(labels[::turn], "doc_id long, quality int"), max_sample=30)
    (x, y), (x2, y2) = seen
    assert len(x) <= 30 and np.array_equal(x, x2) and np.array_equal(y, y2)


def test_op2_kept_by_hand(spark, tables):
    """The query's verdict and score against a walk through each tree, row by row."""
    d, docs, labels = tables
    forest = quality_rules.fit(docs.select("doc_id", "text"), labels)
    got = queries.op2_quality_rules(spark, d).toPandas().set_index("doc_id")
    assert len(forest.feature) and len(got) == docs.count()
    for row in docs.select("doc_id", "text").collect():
        _, x = quality_rules.statistics(*textops.flat(pa.array([row.text], pa.string())))
        total = forest.base
        for t in range(len(forest.feature)):
            at = 0
            while forest.left[t][at] != at:
                at = forest.right[t][at] if x[0][forest.feature[t][at]] > forest.threshold[t][at] else forest.left[t][at]
            total += forest.value[t][at]
        score = 1 / (1 + np.exp(-total))
        own = got.loc[row.doc_id]
        assert abs(own.score - score) < 1e-9 and own.kept == (not own.base_failed and score >= quality_rules.MIN_SCORE)


def test_op3_scores_by_hand(spark, tables):
    """The query's scores against a plain forward pass of a network that is fitted anew, passage by passage."""
    d, docs, labels = tables
    network = quality_classifier.fit(docs.select("doc_id", "text"), labels)
    got = {r.doc_id: r for r in queries.op3_quality_classifier(spark, d).collect()}
    w = network.weights
    for row in docs.select("doc_id", "text").collect():
        counts, _ = quality_classifier.passages(*textops.flat(pa.array([row.text], pa.string())))
        top, bottom = np.zeros(len(w["score"])), 0.0
        for own in counts.astype(float):
            held = max(own[-3], 1)
            x = np.append(np.append(own[:-3] / held, own[-3] / 64), own[-2:] / held)
            h = np.tanh((x - network.mean) / network.spread @ w["encode"] + w["encode_b"])
            e = np.exp(np.dot(np.tanh(h @ w["tanh"]) / (1 + np.exp(-(h @ w["gate"]))), w["attend"]))
            top, bottom = top + e * h, bottom + e
        score = 1 / (1 + np.exp(-(top / bottom @ w["score"] + w["score_b"][0])))
        assert abs(got[row.doc_id].score - score) < 1e-5 and got[row.doc_id].predicted == int(got[row.doc_id].score >= 0.3)


def plain_grams(text):
    """Buckets of a text's n-grams, one character after the other."""
    m, points = 1 << 32, []
    for c in text:
        low = c.lower() if c.isalpha() else " "
        p = ord(low) if len(low) == 1 else ord(c)
        if not (p == 32 and points and points[-1] == 32):
            points.append(p)
    out = []
    for i, p in enumerate(points):
        one = p * 0x9E3779B1 % m
        pair = lambda k: (points[k - 1] * 0x9E3779B1 % m ^ (points[k] + 0x7F4A7C15) % m) * 0x85EBCA6B % m
        two = pair(i) if i else one
        three = (pair(i - 1) ^ p * 0xC2B2AE35 % m) * 0x27D4EB2F % m if i > 1 else two
        for h in (one, two, three):
            h ^= h >> 15
            out.append((h * 0x2C1B3C6D % m) >> 18)
    return out


def test_op5_by_hand(spark, tables):
    """The query against counts, priors and posteriors of a plain loop over the rows that may be learned from."""
    d, docs, _ = tables
    rows = docs.select("doc_id", "text", "lang", fold().alias("fold")).collect()
    size, smooth, learned = language_id.BUCKETS, language_id.SMOOTHING, {}
    for lang, text in {(r.lang, r.text, r.doc_id): (r.lang, r.text) for r in rows if r.lang and r.text is not None and r.fold}.values():
        learned.setdefault(lang, Counter()).update(plain_grams(text))
    langs = sorted(learned)
    total = {k: sum(c.values()) + smooth * size for k, c in learned.items()}
    got = {r.doc_id: r for r in queries.op5_language_id(spark, d).collect()}
    assert len(langs) > 1 and len(got) == len(rows)
    for r in rows:
        own = got[r.doc_id]
        assert own.held_out == (r.fold == 0)
        if not any(c.isalpha() for c in r.text or ""):
            assert (own.lang_pred, own.score) == ("und", 0)
            continue
        times = Counter(plain_grams(r.text))
        joint = np.array([sum(n * np.log((learned[k][b] + smooth) / total[k]) for b, n in times.items()) for k in langs])
        score = 1 / np.exp(joint - joint.max()).sum()
        assert own.lang_pred == langs[int(joint.argmax())] and abs(own.score - score) < 1e-6


def test_grams_do_not_reach_over_texts():
    texts = ["ab c", "", "x", None, "É", "ßa", " a", "12", "abc def"]
    buckets, bounds, _ = language_id.grams(*textops.flat(pa.array(texts)))
    for k, t in enumerate(texts):
        assert buckets[bounds[k] : bounds[k + 1]].tolist() == plain_grams(t or ""), t


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    df = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(10)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="different values"):
        language_id.fit(df)


def test_bytes_that_are_no_utf8(spark):
    """A Parquet string column may hold any bytes: no operator fails, and other rows keep their results."""
    import public_tokenizers

    from sieveline.llm import packing, sentence_pieces, simhash, substring_dedup, suffix_dedup

    good = spark.createDataFrame([(1, "der Hund und die Katze gehen heim é", "de"), (2, "the dog and the cat go home", "en"), (4, "é", "de")], "doc_id long, text string, lang string")
    bad = spark.createDataFrame([(3,)], "doc_id long").selectExpr("doc_id", "cast(X'41C320FF42E282' as string) as text", "'en' as lang")
    both = good.union(bad).coalesce(1).orderBy("doc_id")
    model = language_id.fit(good)
    pieces, bpe = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
    for of in (
        lambda df: language_id.annotate(df, model, ["doc_id"]), lambda df: sentence_pieces.digest(df, pieces, keep=["doc_id"]), lambda df: packing.pack(df, bpe).select("doc_id", "length", "ids_crc32"), substring_dedup.shorten, suffix_dedup.shorten,
        simhash.component_ids, lambda df: quality_classifier.annotate(df, quality_classifier.Network(np.zeros(quality_classifier.WIDTH), np.ones(quality_classifier.WIDTH), {k: np.ones(s) for k, s in {"encode": (quality_classifier.WIDTH, 5), "encode_b": (5,), "tanh": (5, 3), "gate": (5, 3), "attend": (3,), "score": (5,), "score_b": (1,)}.items()}), ["doc_id"]),
    ):
        want, got = ({r.doc_id: tuple(r) for r in of(df).collect()} for df in (good, both))
        assert set(got) == {1, 2, 3, 4} and {k: got[k] for k in want} == want
    texts = ["a", "é", None, "", "b"]
    data, offsets = textops.flat(pa.array(texts))
    assert textops.valid(data, offsets)[0] is data
    halves = np.frombuffer("é".encode(), np.uint8)
    fixed, at = textops.valid(halves, np.array([0, 1, 2]))
    assert fixed.tobytes().decode() == "��" and at.tolist() == [0, 3, 6]


def test_what_a_worker_keeps():
    """One operator's things stay for its next task and go with a task of another one."""
    made = []
    make = lambda: made.append(1) or object()
    run = lambda keeps: list(textops.released(lambda batches: iter([1]), keeps)(iter([])))
    run(None)
    first = textops.kept("a", make)
    run("a")
    assert textops.kept("a", make) is first and len(made) == 1
    run("b")
    assert textops.kept("a", make) is not first and len(made) == 2
    textops.kept("b", make)
    assert textops.kept("a", make) and len(made) == 4
    run(None)
    assert not textops._kept
