"""Quality rules: document statistics and gradient-boosted trees over them.

Trees are grown by histogram on a bounded sample of labelled documents, with
monotonic constraints on chosen statistics (more symbols, repeated lines or
repeated windows never raise a score), and flattened into numpy node arrays,
with which a batch is scored without a loop over documents or trees.

Defined results: a null or empty text has no words and fails the base rules;
a very long text is judged whole, with about 100 bytes of arrays a word; repeated
rows are scored alike; a score that equals the threshold is kept; an empty table
gives an empty result; input columns named as an output are replaced (by
``passed`` none is); with no usable labels the forest is empty, its score is 0.5
and the base rules alone decide.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import append, filtered, sample_ids
from .textops import Prefix, Words, again, binary, codes, covered, flat, mixed, offsets_of, sums, word_hashes

#: Base rules.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Labelled documents that the forest is fitted on, at most.
MAX_SAMPLE = 8192
#: A document whose score is lower is rejected.
MIN_SCORE = 0.5

SYMBOLS = b"#*$%&|<>"
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True
IS_DIGIT = np.zeros(256, bool)
IS_DIGIT[48:58] = True
IS_STOP = np.zeros(256, bool)
IS_STOP[list(b".!?")] = True

#: Name of each statistic that the trees see, and the sign that a rise may give the score (0: any).
FEATURES = {
    "log_words": 0, "word_chars": 0, "symbols_per_char": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0,
    "capital_share": 0, "lone_symbol_share": -1, "digits_per_char": 0, "stop_share": 0, "words_per_line": 0, "symbol_word_share": -1,
}

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FIELDS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("score", T.DoubleType())])


def repeated_words(words: Words, hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Which words lie in an n-word window that its document has twice or more.

    Windows that share a hash are compared word for word.
    """
    total = len(words)
    if total < n:
        return np.zeros(total, bool)
    starts = np.flatnonzero(words.doc[: total - n + 1] == words.doc[n - 1 :])
    keys = mixed(Prefix(hashes).windows(n)[starts] + words.doc[starts].astype(np.uint64))
    starts = starts[again(keys)]
    if not len(starts):
        return np.zeros(total, bool)
    joined, at = words.join()
    text, ends = joined.tobytes(), at[starts + n - 1] + words.lengths[starts + n - 1]
    held = [(d, text[a:b]) for d, a, b in zip(words.doc[starts].tolist(), at[starts].tolist(), ends.tolist(), strict=True)]
    times = Counter(held)
    return covered(starts[[times[x] > 1 for x in held]], n, total)


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of each text, and the (texts, FEATURES) matrix."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    n_words = np.diff(words.first)
    hashes = word_hashes(words)
    chars = sums(words.solid & ((data & 0xC0) != 0x80), offsets)
    symbol = IS_SYMBOL[data]
    n_symbols = sums(symbol, offsets)
    repeat = sums(repeated_words(words, hashes), words.first)

    newline = data == 10
    begins = np.union1d(offsets[:-1][offsets[:-1] < len(data)], np.flatnonzero(newline) + 1)
    begins = begins[begins < len(data)]  # an empty line has no word, so it never counts
    bounds = np.append(begins, len(data))
    doc = np.searchsorted(offsets, begins, "right") - 1
    lines, _ = codes(binary(data[~newline], offsets_of(np.diff(bounds) - np.diff(np.append(0, np.cumsum(newline))[bounds]))))
    worded = np.diff(np.searchsorted(words.starts, bounds)) > 0
    n_lines = np.bincount(doc[worded], minlength=n)
    key = doc[worded] * (len(lines) + 1) + lines[worded]
    n_dup = n_lines - np.bincount(np.unique(key) // (len(lines) + 1), minlength=n)

    seen = np.sort(words.doc.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    new = seen[np.append(True, seen[1:] != seen[:-1])] if len(seen) else seen
    n_distinct = np.bincount((new >> np.uint64(40)).astype(np.int64), minlength=n)
    first, last = data[words.starts], data[np.maximum(words.ends - 1, 0)] if len(words) else data[:0]
    share = lambda x: sums(x, words.first) / np.maximum(n_words, 1)
    features = np.column_stack([
        np.log1p(n_words), chars / np.maximum(n_words, 1), n_symbols / np.maximum(chars, 1), n_dup / np.maximum(n_lines, 1), repeat / np.maximum(n_words, 1), n_distinct / np.maximum(n_words, 1),
        share((first >= 65) & (first <= 90)), share((words.lengths == 1) & IS_SYMBOL[first]), sums(IS_DIGIT[data], offsets) / np.maximum(chars, 1), share(IS_STOP[last]), n_words / np.maximum(n_lines, 1), share(IS_SYMBOL[last]),
    ])
    return {"n_words": n_words, "word_chars": chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": repeat}, features


@dataclass
class Forest:
    """Trees as node arrays of shape (trees, nodes).  A leaf is its own child, so every walk has the same length."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        at = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            up = x[rows, self.feature[trees, at]] > self.threshold[trees, at]
            at = np.where(up, self.right[trees, at], self.left[trees, at])
        return 1 / (1 + np.exp(-(self.base + self.value[trees, at].sum(1))))


def fit_forest(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, min_rows: int = 10, l2: float = 1.0) -> Forest:
    """Gradient boosting of the logistic loss; both labels weigh the same in total."""
    nodes = 2 ** (depth + 1) - 1
    shape = (trees if len(np.unique(y)) == 2 else 0, nodes)
    itself = np.tile(np.arange(nodes), (shape[0], 1))
    forest = Forest(np.zeros(shape, np.int64), np.zeros(shape), itself.copy(), itself.copy(), np.zeros(shape), 0.0, depth)
    if not shape[0]:
        return forest
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    margin = np.zeros(len(y))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        node, bounds = np.zeros(len(y), np.int64), {0: (-np.inf, np.inf)}
        for k in range(nodes):
            if k not in bounds:
                continue
            rows, (low, high) = np.flatnonzero(node == k), bounds[k]
            gs, hs = g[rows].sum(), h[rows].sum()
            forest.value[t, k] = rate * np.clip(-gs / (hs + l2), low, high)
            if 2 * k + 2 >= nodes or len(rows) < 2 * min_rows:
                continue
            best = (1e-6, None)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                gl, hl, cl = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-(gs - gl) / (hs - hl + l2), low, high)
                gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                gain[(cl < min_rows) | (len(rows) - cl < min_rows) | (signs[j] * (vr - vl) < 0)] = -1
                if gain.max() > best[0]:
                    i = int(gain.argmax())
                    best = (gain[i], (j, i, vl[i], vr[i]))
            if best[1] is None:
                continue
            j, i, vl, vr = best[1]
            forest.feature[t, k], forest.threshold[t, k] = j, edges[j][i]
            forest.left[t, k], forest.right[t, k] = 2 * k + 1, 2 * k + 2
            node[rows] = 2 * k + 1 + (binned[rows, j] > i)
            middle = (vl + vr) / 2  # a constrained split also parts the ranges that its two sides may take
            bounds[2 * k + 1] = (low, middle) if signs[j] > 0 else (middle, high) if signs[j] < 0 else (low, high)
            bounds[2 * k + 2] = (middle, high) if signs[j] > 0 else (low, middle) if signs[j] < 0 else (low, high)
        margin += forest.value[t, node]
    return forest


def fit(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> Forest:
    """Learn ``labels.quality`` (doc_id, quality) on at most ``max_sample`` labelled documents that are not held out."""
    chosen = sample_ids(labels.where("quality in (0, 1) and doc_id is not null"), "doc_id", ["quality"], max_sample)
    fields = T.StructType([T.StructField("features", T.ArrayType(T.DoubleType()))])

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        _, x = statistics(*flat(batch.column(batch.schema.get_field_index("text"))))
        return [pa.array(list(x), pa.list_(pa.float64()))]

    sampled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # one row an id, so that the sample stays within its bound: of several, the one with the smallest hash
    choice = F.struct(F.xxhash64("text", "quality").alias("hash"), F.coalesce("text", F.lit("")).alias("text"), "quality")
    once = sampled.groupBy("doc_id").agg(F.min(choice).alias("choice")).select("doc_id", "choice.text", "choice.quality")
    rows = append(once, "text", fields, make, ["quality", "doc_id"]).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows["features"].tolist(), float).reshape(-1, len(FEATURES))
    return fit_forest(x, rows["quality"].to_numpy(float), list(FEATURES.values()))


def annotate(docs: DataFrame, forest: Forest, keep: list[str] | None = None, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``kept`` and the forest's ``score``."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        counts, x = statistics(*flat(batch.column(batch.schema.get_field_index(text_col))))
        failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
        score = forest.score(x)
        return [*(pa.array(counts[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(~failed & (score >= min_score)), pa.array(score)]

    return append(docs, text_col, FIELDS, make, keep)


def passed(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    return filtered(docs, text_col, lambda df, column: annotate(df, forest, text_col=column), "kept")
