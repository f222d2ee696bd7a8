"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of all texts is unlabelled. The risk of a linear
classifier over the presence of words and word beginnings is estimated as

    prior * loss(positives as toxic) + max(0, loss(unlabelled as clean) - prior * loss(positives as clean))

where the maximum keeps the estimated risk of clean texts from falling below zero: where it would,
the step goes the other way. Everything is fitted in numpy on bounded samples (``most_positives``
and ``most_unlabelled`` texts, about) of which whole texts are used; what reaches the driver is a
kilobyte for each text at most, however long it is.

Defined results: null and empty texts get the score of a text without features; rows with a null id
teach nothing; without a positive all scores are 0; a document with several labels is toxic if one says so; repeated rows agree; an
empty table gives an empty result; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, distinct, flat, materialize, spans, stream, word_hashes
from .sampling import up_to

MOST_POSITIVES = 3000
MOST_UNLABELLED = 9000
#: Features at most, the size of the model; texts that a feature is in at least.
FEATURES, LEAST_TEXTS = 8192, 3
BEGINNING = 5
#: Least log-likelihood ratio of a feature; what chance alone brings about is well below.
LEAST_GAIN = 6.0
_NO_LETTER = np.array([not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, feature) of every word and word beginning, with repeats; words are runs of letters."""
    buf, off = flat(texts)
    buf = LOWER[buf]
    starts, ends, first = spans(buf, off, _NO_LETTER)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    whole = word_hashes(buf, starts, ends)
    longer = ends - starts > BEGINNING
    begin = ~word_hashes(buf, starts[longer], starts[longer] + BEGINNING)
    return np.concatenate([doc, doc[longer]]), np.concatenate([whole, begin])


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        n = len(texts)
        if not len(self.vocabulary):
            return np.zeros(n)
        doc, feature = text_features(texts)
        at = np.minimum(np.searchsorted(self.vocabulary, feature), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == feature
        present = distinct(doc[hit] * len(self.vocabulary) + at[hit])
        logit = self.bias + np.bincount(present // len(self.vocabulary), self.weights[present % len(self.vocabulary)], n)
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def _gain(p: np.ndarray | Column, u: np.ndarray | Column, positives: int, unlabelled: int, log: Callable = np.log, where: Callable = np.where) -> np.ndarray | Column:
    """Log-likelihood ratio of a feature that ``p`` positives and ``u`` unlabelled texts have."""
    a, b = (p + 0.5) / (positives + 1), (u + 0.5) / (unlabelled + 1)
    gain = positives * (a * log(a / b) + (1 - a) * log((1 - a) / (1 - b)))
    return where(a > b, gain, 0.1 * gain)  # presence of an insult tells more than absence of a common word


def select(positives: list[np.ndarray], unlabelled: list[np.ndarray], most: int = FEATURES) -> np.ndarray:
    """Features that set positives apart: the largest log-likelihood ratios of presence."""
    p, np_ = np.unique(np.concatenate(positives), return_counts=True)
    u, nu_ = np.unique(np.concatenate(unlabelled), return_counts=True) if unlabelled else (p[:0], np_[:0])
    p, np_ = p[np_ >= LEAST_TEXTS], np_[np_ >= LEAST_TEXTS]
    at = np.minimum(np.searchsorted(u, p), max(0, len(u) - 1))
    nu = np.where(u[at] == p, nu_[at], 0) if len(u) else np.zeros(len(p))
    gain = _gain(np_, nu, len(positives), len(unlabelled))
    order = np.argsort(-gain, kind="stable")[:most]
    return np.sort(p[order[gain[order] >= LEAST_GAIN]])


class Presence:
    """Which features each row has, and a last one that all have."""

    def __init__(self, rows: list[np.ndarray], features: int):
        self.n, self.width = len(rows), features + 1
        sizes = [len(r) + 1 for r in rows]
        self.row = np.repeat(np.arange(self.n), sizes)
        self.column = np.concatenate([np.append(r, features) for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n)

    def sums(self, z: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, z[self.row], self.width)


def fit(positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """From the distinct features of each text."""
    if not positives:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    vocabulary = select(positives, unlabelled)
    found = lambda rows: [np.flatnonzero(np.isin(vocabulary, r, assume_unique=True)) for r in rows]
    return fit_present(vocabulary, found(positives), found(unlabelled), prior)


def fit_present(vocabulary: np.ndarray, positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 800, rate: float = 0.05, penalty: float = 1e-4) -> Model:
    """Non-negative risk estimation with the logistic loss, by Adam over all rows; see the module's text."""
    xp, xu = Presence(positives, len(vocabulary)), Presence(unlabelled, len(vocabulary))
    w = np.zeros(len(vocabulary) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        lp, lu = xp.times(w), xu.times(w)
        zp, zu = sigmoid(lp), sigmoid(lu)
        clean = np.logaddexp(0, lu).mean() - prior * np.logaddexp(0, lp).mean() if xu.n else 0.0
        of_clean = xu.sums(zu) / max(1, xu.n) - prior * xp.sums(zp) / xp.n
        if clean < 0:
            grad = -of_clean
        else:
            grad = prior * xp.sums(zp - 1) / xp.n + of_clean + penalty * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(vocabulary, w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, most_positives: int = MOST_POSITIVES, most_unlabelled: int = MOST_UNLABELLED, prior: float | None = None) -> Model:
    """Fit on (doc_id, text) and (doc_id, toxic); ``prior``: the toxic share of all texts, else that of the labels.

    Features are counted and chosen on executors; the driver gets the chosen ones, and for each text
    of the samples which of them it has, a bit for each.
    """
    truth = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen = truth.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("p")).first()
    prior = min(0.5, max(0.01, seen["p"] / max(1, seen["n"]))) if prior is None else prior
    role = lambda name: F.lit(name).alias("role")
    positive = up_to(truth.filter("toxic = 1").select("doc_id", role("positive")), "role", most_positives, "positives")
    unlabelled = up_to(docs.filter(F.col("doc_id").isNotNull()).select("doc_id", role("unlabelled")), "role", most_unlabelled, "unlabelled")
    chosen = positive.union(unlabelled.distinct())  # the two bounds, about
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                doc, feature = text_features(part.column("text"))
                order = np.argsort(doc, kind="stable")
                cut = np.searchsorted(doc[order], np.arange(part.num_rows + 1))
                found = [distinct(feature[order[cut[i] : cut[i + 1]]]).view(np.int64) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("role"), pa.array(found, pa.list_(pa.int64()))], ["role", "x"])

    rows = materialize(stream(texts.select("role", "text"), extract, "role string, x array<long>"), "features")
    n = {r["role"]: r["n"] for r in rows.groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}
    positives, others = n.get("positive", 0), n.get("unlabelled", 0)
    if not positives:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    counts = rows.select("role", F.explode("x").alias("feature")).groupBy("feature").agg(F.count_if(F.col("role") == "positive").alias("p"), F.count_if(F.col("role") == "unlabelled").alias("u"))
    gain = _gain(F.col("p"), F.col("u"), positives, others, F.log, lambda test, a, b: F.when(test, a).otherwise(b))
    best = counts.filter(F.col("p") >= LEAST_TEXTS).withColumn("gain", gain).filter(F.col("gain") >= LEAST_GAIN).orderBy(F.col("gain").desc(), "feature").limit(FEATURES)
    vocabulary = np.sort(np.array([r["feature"] for r in best.collect()], np.int64).view(np.uint64))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.packbits(np.isin(vocabulary, np.asarray(x.values, np.int64).view(np.uint64), assume_unique=True)).tobytes() for x in batch.column("x")]
            yield pa.RecordBatch.from_arrays([batch.column("role"), pa.array(found, pa.binary())], ["role", "x"])

    got = stream(rows, marks, "role string, x binary").toArrow()
    bits = sorted(zip(got.column("role").to_pylist(), got.column("x").to_pylist(), strict=True))
    of = lambda name: [np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), count=len(vocabulary))) for r, x in bits if r == name]
    return fit_present(vocabulary, of("positive"), of("unlabelled"), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(part.column("text")), pa.float64())], ["doc_id", "score"])

    return stream(docs.select("doc_id", "text"), run, "doc_id long, score double")
