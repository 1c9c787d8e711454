"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of lower-cased 1-, 2- and 3-grams of letters and spaces are gathered on
the executors from a bounded sample of the labelled rows of each language; the
log-probability matrix (``BUCKETS`` values of 8 bytes a language, so its size
does not depend on the rows) is broadcast, and a batch is scored as a sparse
matrix in numpy.

The posterior compares learned languages only, so it says nothing of a text in
none of them.  ``fit_known`` therefore also learns how likely a letter sequence
of each language is, per n-gram: each sampled text is scored with its own counts
left out, and ``identified`` rejects what is less likely than all but one in a
thousand of them (of the short ones, for a short text).

Defined results: a null text, an empty text or one without a letter is ``und``
with score 0; ties go to the language that sorts first; repeated rows get equal
results and count once in the sample; a very long text is scored whole, with
about 40 bytes of arrays a character; n-grams do not reach over texts; bytes that
are no UTF-8 count as U+FFFD, which is no letter; over MAX_LANGUAGES different
values of lang are an error; an input column named ``lang_pred`` or
``score`` is replaced, by ``identified`` none is; an empty table gives an empty
result; without labelled rows every text is ``und``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import append, cut, filtered, fold
from .textops import flat, offsets_of, released, slices, valid

#: Buckets of hashed n-grams.
BUCKETS = 1 << 14
#: Labelled rows of each language that the counts are taken from: all if there are fewer, else about so many.
MAX_SAMPLE = 1024
SMOOTHING = 0.5
#: Languages that a model may have: its matrix, 128 KB a language, is sent to all executors.
MAX_LANGUAGES = 512
UNDETERMINED = "und"
#: A text whose best language is less likely is rejected by ``identified``.
MIN_SCORE = 0.5
#: So many of the sampled texts may be less likely than the floor, and texts of fewer n-grams have a floor of their own.
FLOOR_SHARE, SHORT = 0.001, 1024
FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


@cache
def letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a space."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts, text by text; n + 1 offsets into them; which texts have a letter."""
    data, offsets = valid(data, offsets)
    points = letters()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    head = np.flatnonzero((data & 0xC0) != 0x80)
    bounds = np.searchsorted(head, offsets)
    # runs of what is no letter count as one space
    space = points == 32
    keep = ~(space & np.append(False, space[:-1]))
    keep[bounds[:-1][bounds[:-1] < len(points)]] = True
    kept = offsets_of(keep)
    points, bounds, has = points[keep], kept[bounds], np.diff(offsets_of(~space)[bounds]) > 0
    n = len(points)
    out = np.empty((n, 3), np.uint32)
    one = points * np.uint32(0x9E3779B1)
    out[:, 0] = one
    start = bounds[:-1][np.diff(bounds) > 0]  # no n-gram goes back into another text
    second = start[start + 1 < np.append(start[1:], n)] + 1
    two = one.copy()
    two[1:] = (one[:-1] ^ (points[1:] + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
    two[start] = one[start]
    out[:, 1] = two
    three = two.copy()
    three[2:] = (two[1:-1] ^ (points[2:] * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F)
    three[start], three[second] = two[start], two[second]
    out[:, 2] = three
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return (out >> np.uint32(18)).astype(np.int32).ravel(), bounds * 3, has


@dataclass
class Model:
    langs: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray
    #: Least log-probability per n-gram of long and of short texts, languages x 2.
    floor: np.ndarray | None = None

    def joint(self, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log P(text, language), texts x languages."""
        out = np.tile(self.log_prior, (len(bounds) - 1, 1))
        for j in range(len(self.langs)):  # a sparse row holds a bucket as often as it occurs
            total = np.append(0, np.cumsum(self.log_prob[j][buckets], dtype=np.float64))
            out[:, j] += total[bounds[1:]] - total[bounds[:-1]]
        return out

    def posterior(self, joint: np.ndarray) -> np.ndarray:
        """P(language | text), texts x languages."""
        out = np.exp(joint - joint.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)

    def known(self, joint: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which texts, of n n-grams each, are as likely as texts of their best language are."""
        if self.floor is None:
            return np.ones(len(n), bool)
        best = joint.argmax(1)
        return (joint - self.log_prior)[np.arange(len(n)), best] >= n * self.floor[best, (n < SHORT).astype(int)]


def _sample(docs: DataFrame, max_sample: int) -> DataFrame:
    """Rows (text, lang), about ``max_sample`` of each language at most, chosen by a hash, of those that are not held out."""
    labelled = docs.where("lang is not null and text is not null and doc_id is not null").where(fold() != 0).select("doc_id", "text", "lang")
    rates = [(r["lang"], min(max_sample / r["n"], 1.0)) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    if not rates:
        return labelled.select("text", "lang")
    if len(rates) > MAX_LANGUAGES:
        raise ValueError(f"{len(rates)} different values of lang, over {MAX_LANGUAGES}: is it a column of languages?")
    rate = F.create_map(*(F.lit(x) for pair in rates for x in pair))[F.col("lang")]
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32)) < rate * float(1 << 32))
    return cut(chosen.dropDuplicates().select("text", "lang"))


def _counts(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages of the sample, and how often each has each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            names = np.array(batch.column(1).to_pylist())
            buckets, bounds, _ = grams(*flat(batch.column(0)))
            lang = np.repeat(names, np.diff(bounds))
            for name in np.unique(names):
                totals[name] = totals.get(name, np.zeros(BUCKETS, np.int64)) + np.bincount(buckets[lang == name], minlength=BUCKETS)
        for name, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])

    counts = sample.mapInArrow(released(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((len(langs), BUCKETS))
    for j, name in enumerate(langs):
        own = counts[counts["lang"] == name]
        table[j, own["bucket"].to_numpy()] = own["n"].to_numpy()
    return langs, table


def _model(langs: list[str], table: np.ndarray) -> Model:
    table = table + SMOOTHING
    # a flat prior: how common a language is in the sample says little about one text
    return Model(langs, np.zeros(len(langs)), np.log(table / table.sum(1, keepdims=True)))


def fit(docs: DataFrame, max_sample: int = MAX_SAMPLE) -> Model:
    """Count on about ``max_sample`` rows of each language, at most, that are not held out."""
    return _model(*_counts(_sample(docs, max_sample)))


def fit_known(docs: DataFrame, max_sample: int = MAX_SAMPLE) -> Model:
    """``fit`` with the floors that ``identified`` then holds texts to."""
    sample = _sample(docs, max_sample)
    langs, table = _counts(sample)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text with a letter: its language, its n-grams, and their mean log-probability in the other texts of the language."""
        total = table.sum(1)
        for batch in slices(batches):
            buckets, bounds, has = grams(*flat(batch.column(0)))
            rows = []
            for i in np.flatnonzero(has).tolist():
                j, (own, times) = langs.index(batch.column(1)[i].as_py()), np.unique(buckets[bounds[i] : bounds[i + 1]], return_counts=True)
                n = int(times.sum())
                rows.append((j, n, float(times @ np.log(table[j, own] - times + SMOOTHING)) / n - np.log(total[j] - n + SMOOTHING * BUCKETS)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.float64()))], names=["lang", "n", "mean"])

    model = _model(langs, table)
    scores = sample.mapInArrow(released(left_out), "lang int, n long, mean double").toPandas()
    usual = scores.groupby("lang")["mean"].median().reindex(range(len(langs)), fill_value=np.inf).to_numpy()  # nothing is in a language without a letter
    below = scores["mean"].to_numpy() - usual[scores["lang"].to_numpy()]

    def floor(values: np.ndarray) -> float:
        return float(np.quantile(values, FLOOR_SHARE, method="lower")) if len(values) else 0.0

    usual_floor = floor(below)
    model.floor = usual[:, None] + np.array([usual_floor, min(usual_floor, floor(below[scores["n"].to_numpy() < SHORT]))])
    return model


def _marked(docs: DataFrame, model: Model, keep: list[str] | None, text_col: str, fields: T.StructType) -> DataFrame:
    """``docs`` with the first of ``lang_pred``, ``score`` and ``known`` that ``fields`` names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        model = sent.value
        data, offsets = flat(batch.column(batch.schema.get_field_index(text_col)))
        buckets, bounds, has = grams(data, offsets)
        if not model.langs:
            return [pa.array([UNDETERMINED] * batch.num_rows), pa.array(np.zeros(batch.num_rows)), pa.array(has)][: len(fields)]
        joint = model.joint(buckets, bounds)
        p = model.posterior(joint)
        names = np.where(has, np.array(model.langs, object)[p.argmax(1)], UNDETERMINED)
        return [pa.array(names, pa.string()), pa.array(np.where(has, p.max(1), 0.0)), pa.array(model.known(joint, np.diff(bounds)))][: len(fields)]

    return append(docs, text_col, fields, make, keep)


def annotate(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior of that language."""
    return _marked(docs, model, keep, text_col, FIELDS)


def identified(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language can be told and, by the floors of the model if it has any, is one of the learned."""
    fields = T.StructType([*FIELDS, T.StructField("known", T.BooleanType())])
    return filtered(docs, text_col, lambda df, column: _marked(df, model, None, column, fields), f"lang_pred != '{UNDETERMINED}' and score >= {min_score} and known")
