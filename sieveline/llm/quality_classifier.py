"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Every passage is
encoded (hashed word shapes and hashed words as shares, sent through a learned
layer); gated attention, learned from document labels only, weighs the
passages; the weighted passage representation is scored.  The network is
trained in numpy, in mini-batches of whole bags, on a bounded sample of labelled
rows with all their passages (``WIDTH`` bytes each in the driver, about 2.5 a
word), and scores batches without a loop over documents.

Defined results: a null or empty text is one empty passage and gets that bag's
score; a very long text is scored whole, with about 700 bytes of arrays a
passage; ties and repeated rows score alike; an input column named ``score`` or
``predicted`` is replaced; an empty table gives an empty result; without usable
labels every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import append, sample_ids
from .quality_rules import IS_DIGIT, IS_STOP, IS_SYMBOL
from .textops import Words, again, flat, mixed, offsets_of, word_hashes

PASSAGE_WORDS = 64
SHAPES, HASHED = 96, 64
WIDTH = SHAPES + HASHED + 3
#: Labelled documents that the network is fitted on, at most.
MAX_SAMPLE = 3072
#: Documents of one training step, and steps.
BATCH, STEPS = 128, 480
THRESHOLD = 0.3
FIELDS = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (passages, WIDTH) counts of all texts, a byte each, and n + 1 offsets of each text's passages; each has one at least."""
    words = Words(data, offsets)
    n_words = np.diff(words.first)
    counts = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    bags = offsets_of(counts)
    passage = bags[words.doc] + (np.arange(len(words)) - words.first[words.doc]) // PASSAGE_WORDS
    x = np.zeros((bags[-1], WIDTH), np.uint8)
    if len(words):
        first, last = data[words.starts], data[words.ends - 1]
        size = np.minimum(np.frexp(words.lengths)[1], 6) - 1
        head = np.where(IS_SYMBOL[first], 0, np.where(IS_DIGIT[first], 1, np.where((first >= 65) & (first <= 90), 2, 3)))
        tail = np.where(IS_SYMBOL[last], 0, np.where(IS_STOP[last], 1, np.where(last == 44, 2, 3)))
        hashes = word_hashes(words)
        shape = size * 16 + head * 4 + tail
        bucket = SHAPES + (hashes >> np.uint64(40)).astype(np.int64) % HASHED
        x[:] = np.bincount(np.concatenate([passage * WIDTH + shape, passage * WIDTH + bucket]), minlength=x.size).reshape(x.shape)
        of = lambda which=None: np.bincount(passage, which, len(x))
        x[:, WIDTH - 3] = of()
        x[:, WIDTH - 2] = of(again(mixed(hashes + passage.astype(np.uint64))))
        x[:, WIDTH - 1] = of((words.lengths == 1) & IS_SYMBOL[first])
    return x, bags


def shares(counts: np.ndarray) -> np.ndarray:
    """The network's input: counts by the words of their passage, and how full that is."""
    held = counts[:, WIDTH - 3 : WIDTH - 2]
    x = counts / np.maximum(held, 1).astype(np.float32)
    x[:, WIDTH - 3] = held[:, 0] / np.float32(PASSAGE_WORDS)
    return x


@dataclass
class Network:
    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, counts: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return forward(self.weights, (shares(counts) - self.mean) / self.spread, bags)["p"]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(w: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
    """Gated attention: a_k ~ exp(v . (tanh(T h_k) * sigmoid(G h_k))); p = sigmoid(u . sum a_k h_k + b)."""
    h = np.tanh(x @ w["encode"] + w["encode_b"])
    t, g = np.tanh(h @ w["tanh"]), sigmoid(h @ w["gate"])
    e = (t * g) @ w["attend"]
    bag = np.repeat(np.arange(len(bags) - 1), np.diff(bags))
    e = np.exp(e - np.maximum.reduceat(e, bags[:-1])[bag])
    a = e / np.add.reduceat(e, bags[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, bags[:-1])
    return {"h": h, "t": t, "g": g, "a": a, "bag": bag, "z": z, "p": sigmoid(z @ w["score"] + w["score_b"][0])}


def backward(w: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    f = forward(w, x, bags)
    d = weight * (f["p"] - y) / weight.sum()
    dz = d[:, None] * w["score"]
    dzp = dz[f["bag"]]
    da = (dzp * f["h"]).sum(1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, bags[:-1])[f["bag"]])
    dt, dg = de[:, None] * w["attend"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * w["attend"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["a"][:, None] * dzp + dt @ w["tanh"].T + dg @ w["gate"].T) * (1 - f["h"] ** 2)
    return {"encode": x.T @ dh, "encode_b": dh.sum(0), "tanh": f["h"].T @ dt, "gate": f["h"].T @ dg, "attend": ((f["t"] * f["g"]) * de[:, None]).sum(0), "score": f["z"].T @ d, "score_b": np.array([d.sum()])}


def moments(counts: np.ndarray, part: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of each input."""
    if not len(counts):
        return np.zeros(WIDTH), np.ones(WIDTH)
    total, square = np.zeros(WIDTH), np.zeros(WIDTH)
    for at in range(0, len(counts), part):
        x = shares(counts[at : at + part]).astype(float)
        total += x.sum(0)
        square += (x * x).sum(0)
    mean = total / len(counts)
    return mean, np.sqrt(np.maximum(square / len(counts) - mean * mean, 0)) + 1e-2


def fit_network(counts: np.ndarray, bags: np.ndarray, y: np.ndarray, hidden: int = 24, steps: int = STEPS, size: int = BATCH, rate: float = 0.01, decay: float = 1e-3, seed: int = 7) -> Network:
    """Adam over mini-batches of whole bags, at a falling rate; the rarer label weighs more, by the square root of the ratio."""
    random = np.random.default_rng(seed)
    mean, spread = moments(counts)
    shapes = {"encode": (WIDTH, hidden), "encode_b": (hidden,), "tanh": (hidden, 16), "gate": (hidden, 16), "attend": (16,), "score": (hidden,), "score_b": (1,)}
    w = {k: (random.normal(0, 1 / np.sqrt(s[0]), s) if not k.endswith("_b") else np.zeros(s)) for k, s in shapes.items()}
    if len(np.unique(y)) < 2:
        return Network(mean, spread, {k: np.zeros_like(v) for k, v in w.items()})
    weight = np.where(y == 1, 1.0, np.sqrt(y.mean() / (1 - y.mean())))
    m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if not len(order):
            order = random.permutation(len(y))
        own, order = order[:size], order[size:]
        n = bags[own + 1] - bags[own]
        first = offsets_of(n)
        rows = np.arange(first[-1]) + np.repeat(bags[own] - first[:-1], n)
        x = (shares(counts[rows]) - mean) / spread
        for k, g in backward(w, x, first, y[own], weight[own]).items():
            g = g + decay * w[k] * (not k.endswith("_b"))
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            w[k] = w[k] - rate * (1 - (step - 1) / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Network(mean, spread, w)


def fit(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> Network:
    """Learn ``labels.quality`` on at most ``max_sample`` labelled rows that are not held out, with all their passages."""
    chosen = sample_ids(labels.where("quality in (0, 1) and doc_id is not null"), "doc_id", ["quality"], max_sample)
    fields = T.StructType([T.StructField("passages", T.BinaryType())])

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        x, bags = passages(*flat(batch.column(batch.schema.get_field_index("text"))))
        return [pa.array([x[a:b].tobytes() for a, b in zip(bags[:-1], bags[1:], strict=True)], pa.binary())]

    sampled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "quality"])
    rows = append(sampled, "text", fields, make, ["quality", "doc_id"]).toPandas()
    rows = rows.sort_values(["doc_id", "quality"], kind="stable")
    parts = [np.frombuffer(b, np.uint8).reshape(-1, WIDTH) for b in rows["passages"]]
    counts = np.concatenate(parts) if parts else np.zeros((0, WIDTH), np.uint8)
    return fit_network(counts, offsets_of(np.array([len(p) for p in parts], np.int64)), rows["quality"].to_numpy(float))


def annotate(docs: DataFrame, network: Network, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        x, bags = passages(*flat(batch.column(batch.schema.get_field_index("text"))))
        score = sent.value.score(x, bags)
        return [pa.array(score.astype(float)), pa.array((score >= threshold).astype(np.int32))]

    return append(docs, "text", FIELDS, make, keep)
