"""Embedding texts: any function of a batch of texts, and one that needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .quantize import _fields


def hashing(texts: list[str], dim: int = 64) -> np.ndarray:
    """Unit vectors of hashed words: the same text always gives the same vector."""
    out = np.zeros((len(texts), dim))
    for i, text in enumerate(texts):
        for word in (text or "").lower().split():
            h = hashlib.blake2b(word.encode(), digest_size=8).digest()
            out[i, int.from_bytes(h[:4], "little") % dim] += 1 if h[4] & 1 else -1
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n > 0, n, 1)


def embed(docs: DataFrame, function: Callable[[list[str]], np.ndarray] = hashing, text_col: str = "content", vector_col: str = "embedding") -> DataFrame:
    """``docs`` with vectors where there are none; those that have one keep it."""
    has = vector_col in docs.columns
    kept = [c for c in docs.columns if c != vector_col]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            old = batch.column(vector_col).to_pylist() if has else [None] * batch.num_rows
            missing = [i for i, v in enumerate(old) if v is None]
            if missing:
                texts = batch.column(text_col).to_pylist()
                for i, v in zip(missing, np.asarray(function([texts[i] for i in missing]), np.float64).tolist(), strict=True):
                    old[i] = v
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(old, pa.list_(pa.float64()))], names=[*kept, vector_col])

    return docs.mapInArrow(run, f"{_fields(docs, (vector_col,))}, `{vector_col}` array<double>")
