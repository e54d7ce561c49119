"""Embedding providers. The default needs no model: hashed tokens, L2-normalised."""

from __future__ import annotations

import re
import zlib
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .workers import reach

WORD = re.compile(r"[^\W_]+")


class Embedder(Protocol):
    dimension: int

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        """One row of `dimension` floats for each text."""
        ...


class HashedTokens:
    """Signed counts of hashed words and their parts, of length one; equal texts have equal vectors."""

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts):
            for word in WORD.findall(text.lower()):
                h = zlib.crc32(word.encode())
                row[h % self.dimension] += 1.0 if h >> 16 & 1 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)

    def embed(self, text: str) -> np.ndarray:
        return self.embed_batch([text])[0]


def embed(texts: DataFrame, embedder: Embedder, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """(<id>, embedding) of every text, a batch at a time."""
    reach(texts.sparkSession)
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            vectors = np.asarray(embedder.embed_batch([t or "" for t in b.column(text_col).to_pylist()]), np.float32)
            ends = pa.array(np.arange(0, vectors.size + 1, embedder.dimension), pa.int32())
            yield pa.record_batch([b.column(id_col), pa.ListArray.from_arrays(ends, pa.array(vectors.ravel()))], [id_col, "embedding"])

    return texts.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, embedding array<float>")
