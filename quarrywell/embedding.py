"""Embedding adapters: any function from texts to vectors, as an Arrow batch function; the offline hash embedding.

Fixed values: the models' names and their dimensions (the defaults below)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrywell.functions.vector import hash_embed


class _Embedder:
    def dimension(self) -> int:
        return self.dim

    def name(self) -> str:
        """What its vectors are kept under."""
        return f"{type(self).__name__}-{getattr(self, 'model', '')}-{self.dim}"

    def embed_single(self, text: str) -> list[float]:
        return self.embed([text])[0]


class HashEmbedder(_Embedder):
    """Deterministic and native; for tests and offline use."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def column(self, text: Column, batch_size: int | None = None) -> Column:
        return hash_embed(text, self.dim)

    def embed(self, texts: list[str]) -> list[list[float]]:
        import hashlib

        return [[hashlib.sha256(t.encode()).digest()[i % 32] / 255.0 for i in range(self.dim)] for t in texts]


class FunctionEmbedder(_Embedder):
    """Any ``list[str] -> list[list[float]]`` of a known dimension."""

    def __init__(self, function: Callable[[list[str]], list[list[float]]], dim: int, model: str = ""):
        self.function, self.dim, self.model = function, dim, model

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.function(texts) if texts else []

    def column(self, text: Column, batch_size: int | None = None) -> Column:
        """In Arrow batches, the function getting at most ``batch_size`` texts at once.  Null texts have no vector."""
        function = self.function

        @F.pandas_udf("array<float>")
        def run(s: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            there = s.index[s.notna()]
            step = batch_size or max(len(there), 1)
            for k in range(0, len(there), step):
                part = there[k : k + step]
                for i, v in zip(part, function(s.loc[part].tolist())):
                    out.at[i] = list(v)
            return out

        return run(text)


_loaded: dict = {}


def loaded(key, make: Callable):
    """What ``make`` makes, once in each worker process."""
    if key not in _loaded:
        _loaded[key] = make()
    return _loaded[key]


def fast_embedder(model: str = "BAAI/bge-small-en-v1.5", dim: int = 384) -> FunctionEmbedder:
    """The fastembed package's models, where it is installed."""

    def make():
        from fastembed import TextEmbedding

        return TextEmbedding(model)

    return FunctionEmbedder(lambda texts: [x.tolist() for x in loaded(("fastembed", model), make).embed(texts)], dim, model)


def openai_embedder(model: str = "text-embedding-3-small", dim: int = 1536) -> FunctionEmbedder:
    """The OpenAI service's models, where its package and a key are there."""

    def make():
        from openai import OpenAI

        return OpenAI()

    return FunctionEmbedder(lambda texts: [x.embedding for x in loaded("openai", make).embeddings.create(model=model, input=texts).data], dim, model)
