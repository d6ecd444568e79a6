"""Embedding texts in tasks: a protocol, a hashing embedder and a slot for a model."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataseek.schema import DIM

BATCH = 32


class Embedder(Protocol):
    """``max_chars``: characters of a text that the model reads; None for all."""

    dim: int
    max_chars: int | None

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Words hashed into a signed vector of unit length: the same text gives the same vector
    anywhere, from the whole text. A stand-in for a model, for tests and offline use."""

    max_chars = None

    def __init__(self, dim: int = DIM):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, text in enumerate(texts):
            for w in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(w.encode())
                out[i, (h >> 1) % self.dim] += 1 if h & 1 else -1
        return unit(out)


class OnnxEmbedder:
    """Mean-pooled output of an ONNX model, at unit length. Needs a model file and a
    function from texts to its inputs; loaded once in a worker. Reads the beginning of a text."""

    max_chars = 1500

    def __init__(self, model_path: str, encode: Callable[[list[str]], dict], dim: int = DIM):
        self.model_path, self.encode, self.dim, self._session = model_path, encode, dim, None

    def embed(self, texts: list[str]) -> np.ndarray:
        if self._session is None:
            import onnxruntime

            self._session = onnxruntime.InferenceSession(self.model_path)
        inputs = self.encode(texts)
        hidden = np.asarray(self._session.run(None, inputs)[0])
        return unit(mean_pool(hidden, np.asarray(inputs["attention_mask"])))


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    m = mask[:, :, None].astype(hidden.dtype)
    return (hidden * m).sum(1) / np.maximum(m.sum(1), 1e-9)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(n > 0, n, 1)).astype(np.float32)


def with_vectors(chunks: DataFrame, make: Callable[[], Embedder] = HashEmbedder) -> DataFrame:
    """Chunks with a ``vector`` of their content, as much of it as the embedder reads. ``make``
    is called once in a task; texts go to the embedder in batches."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            cut = [(t or "")[: model.max_chars] for t in texts]
            parts = [model.embed(cut[i : i + BATCH]) for i in range(0, len(cut), BATCH)]
            yield pd.Series([row for p in parts for row in p])

    return chunks.withColumn("vector", embed("content"))
