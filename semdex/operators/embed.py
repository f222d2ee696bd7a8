"""Embedding of texts: providers, and the operator that applies one to a column.

The hashing provider needs no model: a text's words are counted, with a sign, in 64 buckets, both
taken from the word's md5. It is also an expression, ``hashed``, for whole tables.
"""

from __future__ import annotations

import hashlib
import json
import re
import urllib.error
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, ProviderError
from ..sources.config import Embedding

BATCH = 32
TIMEOUT_S = 30
HASH_WIDTH = 64
_DIGITS = "0123456789abcdef"


class Provider(ABC):
    """Gives a vector for each text. Instances are sent to executors, so models are loaded on first use."""

    batch = BATCH

    @abstractmethod
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...

    def dimensions(self) -> int:
        """The width of the vectors, found by embedding one text."""
        return len(self.embed(["width"])[0])


class HashingProvider(Provider):
    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), HASH_WIDTH))
        for i, text in enumerate(texts):
            for word in re.findall(r"[^\s]+", text, re.ASCII):
                h = hashlib.md5(word.encode()).hexdigest()
                out[i, int(h[:2], 16) % HASH_WIDTH] += 1 if int(h[2], 16) < 8 else -1
        return out.tolist()

    def dimensions(self) -> int:
        return HASH_WIDTH


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\x0b\f\r]+"), lambda w: w != "")


def _bucket(hash_: Column) -> tuple[Column, Column]:
    """A word's bucket and sign from its md5 in hexadecimal."""
    digit = lambda at: F.instr(F.lit(_DIGITS), F.substring(hash_, at, 1)) - 1
    return (digit(1) * 16 + digit(2)) % HASH_WIDTH, F.when(digit(3) < 8, 1.0).otherwise(-1.0)


def hashed(text: Column) -> Column:
    """The hashing provider's vector as an expression, for a few texts: its work is words times width."""
    terms = F.transform(F.transform(_words(text), F.md5), lambda h: F.struct(_bucket(h)[0].alias("b"), _bucket(h)[1].alias("v")))
    add = lambda acc, t: F.transform(acc, lambda x, i: F.when(i == t["b"], x + t["v"]).otherwise(x))
    return F.aggregate(terms, F.array_repeat(F.lit(0.0), HASH_WIDTH), add)


def hashed_entries(rows: DataFrame, key: str, text: str = "content") -> DataFrame:
    """(key, bucket, v): the entries other than 0 of the hashing provider's vectors, for whole tables.

    Words are summed up by key and bucket before they are shuffled.
    """
    words = rows.select(key, F.explode(_words(F.col(text))).alias("_w")).select(key, F.md5("_w").alias("_h"))
    bucket, sign = _bucket(F.col("_h"))
    return words.groupBy(key, bucket.cast("int").alias("bucket")).agg(F.sum(sign).alias("v")).filter("v <> 0")


class HttpProvider(Provider):
    """A provider behind an HTTP interface; subclasses say what is asked and where the vectors are."""

    path = ""

    def __init__(self, model: str, base_url: str, api_key: str | None = None):
        self.model, self.base_url, self.api_key = model, base_url.rstrip("/"), api_key

    @abstractmethod
    def vectors(self, answer: dict) -> list[list[float]]: ...

    def _ask(self, texts: Sequence[str]) -> dict:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(self.base_url + self.path, json.dumps({"model": self.model, "input": list(texts)}).encode(), head)
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT_S) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            raise ProviderError("Invalid API key" if e.code == 401 else f"{self.base_url} answered {e.code}") from e
        except (OSError, ValueError) as e:
            raise ProviderError(f"{self.base_url} can't be asked: {e}") from e

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch):
            some = texts[at : at + self.batch]
            try:
                got = self.vectors(self._ask(some))
            except (KeyError, TypeError) as e:
                raise ProviderError(f"{self.base_url} gave an answer of another form") from e
            if len(got) != len(some):
                raise ProviderError(f"{len(some)} texts were sent, {len(got)} vectors came back")
            out += [[float(x) for x in v] for v in got]
        return out


class OllamaProvider(HttpProvider):
    path = "/api/embed"

    def vectors(self, answer: dict) -> list[list[float]]:
        return answer["embeddings"]


class OpenAIProvider(HttpProvider):
    path, batch = "/embeddings", 100

    def vectors(self, answer: dict) -> list[list[float]]:
        return [x["embedding"] for x in sorted(answer["data"], key=lambda x: x.get("index", 0))]


class OnnxProvider(Provider):
    """A local model: 512 tokens at most, mean over tokens, unit length. ``model`` is a folder with model.onnx and tokenizer.json."""

    def __init__(self, model: str):
        self.model = model
        self._loaded = None

    def __getstate__(self) -> dict:
        return {"model": self.model, "_loaded": None}

    def _load(self) -> tuple:
        if self._loaded is None:
            try:
                import onnxruntime
                from tokenizers import Tokenizer

                tokenizer = Tokenizer.from_file(f"{self.model}/tokenizer.json")
                tokenizer.enable_truncation(512)
                tokenizer.enable_padding()
                self._loaded = tokenizer, onnxruntime.InferenceSession(f"{self.model}/model.onnx")
            except Exception as e:
                raise ProviderError(f"the model in {self.model} can't be loaded: {e}") from e
        return self._loaded

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        if not texts:
            return []
        tokenizer, session = self._load()
        coded = tokenizer.encode_batch(list(texts))
        mask = np.array([x.attention_mask for x in coded], np.int64)
        given = {"input_ids": np.array([x.ids for x in coded], np.int64), "attention_mask": mask, "token_type_ids": np.array([x.type_ids for x in coded], np.int64)}
        hidden = session.run(None, {i.name: given[i.name] for i in session.get_inputs()})[0]
        return pooled(hidden, mask).tolist()


def pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Means over the tokens that count, at unit length."""
    m = mask[:, :, None].astype(hidden.dtype)
    mean = (hidden * m).sum(1) / np.maximum(m.sum(1), 1e-9)
    return mean / np.maximum(np.sqrt((mean * mean).sum(1, keepdims=True)), 1e-12)


class SentenceTransformersProvider(Provider):
    def __init__(self, model: str):
        self.model = model
        self._loaded = None

    def __getstate__(self) -> dict:
        return {"model": self.model, "_loaded": None}

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        if not texts:
            return []
        if self._loaded is None:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as e:
                raise ProviderError("sentence-transformers isn't installed") from e
            self._loaded = SentenceTransformer(self.model)
        return [[float(x) for x in v] for v in self._loaded.encode(list(texts), batch_size=min(BATCH, len(texts)))]


def create_provider(config: Embedding, api_key: str | None = None) -> Provider:
    key = api_key or config.api_key

    def need(value: str | None, what: str) -> str:
        if not value:
            raise ConfigError(f"provider {config.provider} needs embedding.{what}")
        return value

    makers: dict[str, Callable[[], Provider]] = {
        "hashing": HashingProvider,
        "onnx": lambda: OnnxProvider(config.model),
        "sentence-transformers": lambda: SentenceTransformersProvider(config.model),
        "ollama": lambda: OllamaProvider(config.model, config.base_url or "http://localhost:11434"),
        "openai": lambda: OpenAIProvider(config.model, config.base_url or "https://api.openai.com/v1", need(key, "api_key")),
        "openai-compatible": lambda: OpenAIProvider(config.model, need(config.base_url, "base_url"), key),
    }
    if config.provider not in makers:
        raise ConfigError(f"unknown provider: {config.provider}; known: {', '.join(sorted(makers))}")
    return makers[config.provider]()


def embed_column(rows: DataFrame, provider: Provider, text: str = "content", out: str = "embedding") -> DataFrame:
    """Add the vectors of a text column; each worker asks for ``provider.batch`` at a time."""
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], f"`{out}` array<float>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, provider.batch):
                part = batch.slice(at, provider.batch)
                texts = [t or "" for t in part.column(text).to_pylist()]
                got = provider.embed(texts)
                if len(got) != len(texts):
                    raise ProviderError(f"{len(texts)} texts were given, {len(got)} vectors came back")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.list_(pa.float32()))], [*part.schema.names, out])

    return rows.mapInArrow(run, schema)


def hashed_vectors(rows: DataFrame, key: str, text: str = "content") -> DataFrame:
    """(key, embedding): the hashing provider's vectors of whole tables; ``key`` names a row."""
    held = hashed_entries(rows, key, text).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "v"))).alias("_v"))  # an entry for each bucket at most
    at = lambda i: F.coalesce(F.try_element_at("_v", i.cast("int")), F.lit(0.0)).cast("float")
    vector = F.transform(F.sequence(F.lit(0), F.lit(HASH_WIDTH - 1)), at)
    return rows.select(key).join(held, key, "left").select(key, vector.alias("embedding"))


def embed_rows(rows: DataFrame, provider: Provider, key: str, text: str = "content") -> DataFrame:
    """As ``embed_column``; what needs no model is worked out by expressions. ``key`` names a row."""
    if type(provider) is HashingProvider:
        return rows.join(hashed_vectors(rows, key, text), key).select(*rows.columns, "embedding")
    return embed_column(rows, provider, text)
