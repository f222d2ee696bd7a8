"""Language identification in two levels: first the language's family, then the language in it.

At both levels, a linear support vector machine for each pair of classes votes. Features are hashed
byte n-grams of the whole lower-cased text: square roots of counts, at unit length. The machines are
fitted with numpy on a bounded sample of labelled rows (``per_language`` of each language, about).

Defined results: null texts, and texts without a letter, get ``und`` with score 0; without any
labelled row all do; with one language all others get that with score 1; repeated rows agree; an
empty table gives an empty result; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import IS_SEPARATOR, chunks, flat, stream
from .sampling import up_to

UNKNOWN = "und"
#: Families of ISO 639-1 codes. A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "ug", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "dravidian": ("kn", "ml", "ta", "te"),
}
DIMENSIONS = 4096
#: Labelled rows of each language on which the machines are fitted, about.
PER_LANGUAGE = 500
_ROWS = 512


def family_of(language: str) -> str:
    code = language.split("-")[0].lower()
    return next((f for f, codes in FAMILIES.items() if code in codes), f"only {language}")


def features(texts: pa.Array) -> np.ndarray:
    """One row of hashed 1- to 3-grams of bytes for each text; a run of n-grams never leaves its text."""
    buf, off = flat(pc.utf8_lower(texts))
    buf = np.where(IS_SEPARATOR[buf], np.uint8(32), buf).astype(np.uint32)
    n = len(off) - 1
    doc = np.repeat(np.arange(n, dtype=np.int64) * DIMENSIONS, np.diff(off))
    counts = np.zeros(n * DIMENSIONS, np.float32)
    code = np.zeros(len(buf), np.uint32)
    for k in (1, 2, 3):
        code = buf if k == 1 else (code[:-1] << np.uint32(8)) | buf[k - 1 :]
        same = doc[: len(code)] == doc[k - 1 :]
        place = ((code + np.uint32(k << 24)) * np.uint32(2654435761)) >> np.uint32(20)
        counts += np.bincount((doc[: len(code)] + place)[same], minlength=n * DIMENSIONS)
        if len(buf) <= k:
            break
    x = np.sqrt(counts.reshape(n, DIMENSIONS))
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of the least squared hinge loss, classes weighed alike; y is +1 or -1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    v, vb, t, rate = w.copy(), b, 1.0, 1.0 / (2 * 2.0 + penalty)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v + vb))
        pull = -2 * weight * y * slack
        new, newb = v - rate * (x.T @ pull + penalty * v), vb - rate * float(pull.sum())
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / after * (new - w), newb + (t - 1) / after * (newb - b)
        w, b, t = new, newb, after
    return w.astype(np.float32), b


@dataclass
class OneVersusOne:
    classes: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMENSIONS), np.float32))
    biases: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> OneVersusOne:
        classes = sorted(set(y.tolist()))
        fits = [svm(x[m := (y == a) | (y == b)], np.where(y[m] == a, 1, -1).astype(np.float32)) for a, b in cls._pairs(classes)]
        if not fits:
            return cls(classes)
        return cls(classes, np.stack([w for w, _ in fits]), np.array([b for _, b in fits], np.float32))

    @staticmethod
    def _pairs(classes: list[str]) -> list[tuple[str, str]]:
        return [(a, b) for i, a in enumerate(classes) for b in classes[i + 1 :]]

    def shares(self, x: np.ndarray, slope: float = 3.0) -> np.ndarray:
        """For each row and class, the mean of its chances against each other class, summing to 1."""
        k = len(self.classes)
        if k == 1:
            return np.ones((len(x), 1))
        chance = 1 / (1 + np.exp(-slope * (x @ self.weights.T + self.biases).astype(np.float64)))
        out = np.zeros((len(x), k))
        for p, (a, b) in enumerate(self._pairs(self.classes)):
            out[:, self.classes.index(a)] += chance[:, p]
            out[:, self.classes.index(b)] += 1 - chance[:, p]
        # with more classes, a sure winner has only 2/k of the sum: sharpen before it is shared out
        out = (out / (k - 1)) ** k
        return out / np.maximum(out.sum(1, keepdims=True), 1e-300)


@dataclass
class Model:
    families: OneVersusOne | None
    languages: dict[str, OneVersusOne]

    @classmethod
    def fit(cls, x: np.ndarray, languages: list[str]) -> Model:
        if not languages:
            return cls(None, {})
        y = np.array(languages, object)
        family = np.array([family_of(v) for v in languages], object)
        return cls(OneVersusOne.fit(x, family), {f: OneVersusOne.fit(x[family == f], y[family == f]) for f in sorted(set(family.tolist()))})

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if self.families is None:
            return [UNKNOWN] * n, np.zeros(n)
        x = features(texts)
        by_family = self.families.shares(x)
        best = by_family.argmax(1)
        names, score = np.full(n, UNKNOWN, object), by_family[np.arange(n), best]
        for i, f in enumerate(self.families.classes):
            rows = np.flatnonzero(best == i)
            if len(rows):
                shares = self.languages[f].shares(x[rows])
                pick = shares.argmax(1)
                names[rows] = np.array(self.languages[f].classes, object)[pick]
                score[rows] *= shares[np.arange(len(rows)), pick]
        letters = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
        names[~letters], score[~letters] = UNKNOWN, 0.0
        return names.tolist(), np.clip(score, 0, 1)


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on (doc_id, text, lang); rows without an id, a language or a letter teach nothing."""
    rows = labelled.filter(F.col("lang").isNotNull())
    chosen = up_to(rows.select("doc_id", "lang", "text"), "lang", per_language, "language").select("lang", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, rows=_ROWS):
                letters = pc.fill_null(pc.match_substring_regex(part.column("text"), r"\p{L}"), False)
                part = part.filter(letters)
                if part.num_rows:
                    x = features(part.column("text")).astype(np.float16)
                    yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([v.tobytes() for v in x], pa.binary())], ["lang", "x"])

    got = stream(chosen, extract, "lang string, x binary").toArrow()
    langs = got.column("lang").to_pylist()
    x = np.stack([np.frombuffer(v, np.float16) for v in got.column("x").to_pylist()]).astype(np.float32) if langs else np.zeros((0, DIMENSIONS), np.float32)
    order = sorted(range(len(langs)), key=lambda i: (langs[i], x[i].tobytes()))
    return Model.fit(x[order], [langs[i] for i in order])


def identify(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns of ``docs``, without any of those two names, and the predicted language and its score."""
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, rows=_ROWS):
                found, score = model.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, *names])

    return stream(docs, predict, schema)
