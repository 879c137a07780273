"""Vectors for texts behind one interface; the default needs no model."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Embedder(Protocol):
    dim: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashedTrigrams:
    """Counts of hashed character trigrams, signed; stable across machines."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for k, text in enumerate(texts):
            code = np.frombuffer(f"  {text.lower()}  ".encode("utf-32-le"), np.uint32).astype(np.uint64)
            h = (code[:-2] * np.uint64(0x9E3779B1) ^ code[1:-1] * np.uint64(0x85EBCA6B) ^ code[2:] * np.uint64(0xC2B2AE35)) & np.uint64(0xFFFFFFFF)
            np.add.at(out[k], (h % np.uint64(self.dim)).astype(np.int64), np.where((h >> np.uint64(16)) & np.uint64(1), 1.0, -1.0))
        return out


def with_embedding(df: DataFrame, text: str, embedder: Embedder, most: int | None = None, out: str = "embedding", parity: bool = False) -> DataFrame:
    """``df`` with unit vectors of the whole texts, or of their first ``most`` characters where a model reads no more; null for null and blank texts and for zero vectors
    (with parity=True a zero vector). The embedder is made once per worker process and gets whole batches."""
    names = df.columns
    shape = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), f"`{out}` array<float>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text).to_pylist()
            at = [i for i, t in enumerate(texts) if t and t.strip()]
            vectors: list = [[0.0] * embedder.dim if parity else None] * len(texts)
            if at:
                m = embedder([texts[i][:most] for i in at])
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                for i, v, n in zip(at, m, norm[:, 0]):
                    if n > 0:
                        vectors[i] = (v / n).astype(np.float32).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], [*names, out])

    return df.mapInArrow(run, shape)
