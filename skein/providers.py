"""Models behind columns. What is here is deterministic and stands in for real models; it is none of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.text import share, terms


class Embedder(Protocol):
    dim: int

    def load(self) -> Callable[[list[str]], np.ndarray]:
        """Called once in each worker; gives a function from texts to unit vectors."""


class HashEmbedder:
    """Signed word hashes; equal words, equal coordinates."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def load(self) -> Callable[[list[str]], np.ndarray]:
        import zlib

        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), self.dim), dtype=np.float32)
            for i, t in enumerate(texts):
                for w in (t or "").lower().split():
                    h = zlib.crc32(w.encode())
                    out[i, h % self.dim] += 1 if h & (1 << 31) else -1
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norm > 0, norm, 1)

        return embed


def embed(text: Column, model: Embedder) -> Column:
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = model.load()
        for b in batches:
            yield pd.Series(list(f(b.tolist())), dtype=object)

    return run(text)


def overlap_score(query: Column, text: Column) -> Column:
    """A pair scorer in column functions: the share of the query's terms that the text has."""
    return F.coalesce(share(terms(text), terms(query)), F.lit(0.0))


def available(**models) -> dict[str, bool]:
    return {name: m is not None for name, m in models.items()}


class Generator(Protocol):
    """A language model."""

    def load(self) -> Callable[[list[str]], list[str | None]]:
        """Called once in each worker; gives a function from prompts to texts, null where the model failed."""


class PairScorer(Protocol):
    """A reranking model: relevance of texts to questions, 0 to 1."""

    def load(self) -> Callable[[list[str], list[str]], list[float]]: ...


class DocumentReader(Protocol):
    """A reader of PDF files."""

    def load(self) -> Callable[[bytes], list[dict]]:
        """Called once in each worker; gives a function from a file to its pages.

        A page is {text, words: [(x0, x1, y0, text)], images: [{data, n_bytes, width, height, channels, box: (x0, x1, y1)}],
        tables: [{header, rows}]}; all but text may be missing. An image's data are raw pixels."""


class Ocr(Protocol):
    def load(self) -> Callable[[np.ndarray], str]:
        """Called once in each worker; gives a function from an image to the text in it."""


class VisionModel(Protocol):
    def load(self) -> Callable[[bytes, str, str], str | None]:
        """Called once in each worker; gives a function from a PNG file, its modality and its context to JSON findings."""


def generate(prompt: Column, model: Generator) -> Column:
    """The model's text for each prompt; null for a null prompt and where the model raises, so one batch that fails
    costs no other."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = model.load()
        for b in batches:
            asked = b[b.notna()]
            try:
                said = list(f(asked.tolist())) if len(asked) else []
            except Exception:  # whatever a model's client raises
                said = [None] * len(asked)
            yield pd.Series(said, index=asked.index, dtype=object).reindex(b.index).where(lambda x: x.notna(), None)

    return run(prompt)


def pair_score(question: Column, text: Column, model: PairScorer) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        f = model.load()
        for qs, ts in batches:
            try:
                yield pd.Series(f(qs.fillna("").tolist(), ts.fillna("").tolist()), index=qs.index, dtype="float64")
            except Exception:  # a reranker that fails gives no score; the next stage goes on without it
                yield pd.Series([None] * len(qs), index=qs.index, dtype="float64")

    return run(question, text)
