"""Embedders: functions from texts to unit vectors, applied by Arrow batches. The default needs no model."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Signed feature hashing of lower-case words; a text without words gets the zero vector."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in split_words(t):
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1.0 if h & 0x40000000 else -1.0
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(norm > 0, norm, 1)

    return embed


class LearnedEmbedder:
    """Texts as means of learned word vectors (operators/embedding.py), rare words weighing more, less the direction that all texts
    share. A text without a known word gets the zero vector."""

    def __init__(self, words: list[str], vectors: np.ndarray, weights: np.ndarray, common: np.ndarray):
        self.places = {w: i for i, w in enumerate(words)}
        self.vectors, self.weights, self.common = vectors.astype(np.float32), weights.astype(np.float32), common.astype(np.float32)

    def means(self, texts: list[str]) -> np.ndarray:
        """Before the common direction is taken away."""
        ids = [[i for w in split_words(t) if (i := self.places.get(w)) is not None] for t in texts]
        out = np.zeros((len(texts), self.vectors.shape[1]), np.float32)
        flat = np.fromiter((i for x in ids for i in x), np.int64, sum(map(len, ids)))
        rows = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        if len(flat):
            starts = np.flatnonzero(np.diff(rows, prepend=-1))
            out[rows[starts]] = np.add.reduceat(self.vectors[flat] * self.weights[flat, None], starts, axis=0)
            out[rows[starts]] /= np.bincount(rows, minlength=len(ids))[rows[starts], None]
        return out

    def __call__(self, texts: list[str]) -> np.ndarray:
        v = self.means(texts)
        v -= (v @ self.common)[:, None] * self.common
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        return v / np.where(norm > 1e-12, norm, 1)


def split_words(text: str | None) -> list[str]:
    return re.findall(r"\w+", (text or "").lower())


def embedded(text: Column, embedder: Callable[[list[str]], np.ndarray] | None = None, dim: int = 64) -> Column:
    """array<float> of each text. embedder: any function from a list of texts to a matrix of unit rows; it is built into
    the task, so load a model lazily within it."""
    f = embedder or hashing_embedder(dim)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(f(s.fillna("").tolist())))

    return run(text)
