"""Attention caches: quantized keys and values by layer, head and position."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CacheConfig
from ..functions import codec
from ..functions.vectors import TINY
from .quantize import _apply, code_matrix, dequantize, quantize, unit


def append(rows: DataFrame, config: CacheConfig, vector_col: str = "vector") -> DataFrame:
    """(layer, head, pos, kind, codes, norm) of rows with a vector; kind is key or value."""
    return quantize(rows.select("layer", "head", "pos", "kind", vector_col), config.quantizer, vector_col)


def attention_scores(cache: DataFrame, query, config: CacheConfig, layer: int | None = None, head: int | None = None) -> DataFrame:
    """(layer, head, pos, score): scaled inner products of a query with the keys; zeros for a zero query."""
    keys = cache.where("kind = 'key'")
    keys = keys if layer is None else keys.where(F.col("layer") == layer)
    keys = keys if head is None else keys.where(F.col("head") == head)
    of = config.quantizer
    q, length = unit(np.asarray(query, np.float64)[None])
    rotated = codec.rotation(of).forward(q)[0] * (length[0] if length[0] >= TINY else 0.0) / np.sqrt(config.head_dim)
    levels = codec.codebook(of.work_dim, of.bits, of.exact_pdf)[0]

    def make(batch):
        import pyarrow as pa

        return (pa.array(levels[code_matrix(batch.column("codes"), of.work_dim)] @ rotated * batch.column("norm").to_numpy().astype(np.float64)),)

    return _apply(keys.select("layer", "head", "pos", "codes", "norm"), ("codes", "norm", "score"), "score double", make)


def values(cache: DataFrame, config: CacheConfig) -> DataFrame:
    """(layer, head, pos, vector) of the values."""
    return dequantize(cache.where("kind = 'value'").drop("kind"), config.quantizer, "vector")


def lengths(cache: DataFrame) -> DataFrame:
    """(layer, head, seq_len)"""
    return cache.where("kind = 'key'").groupBy("layer", "head").agg(F.count(F.lit(1)).alias("seq_len"))


def memory(cache: DataFrame, config: CacheConfig) -> DataFrame:
    """(code_bytes, packed_bytes, fp16_bytes) of the whole cache."""
    n = F.count(F.lit(1))
    return cache.agg(F.sum((F.octet_length("codes") + 4).cast("long")).alias("code_bytes"), (n * (codec.packed_size(config.quantizer.work_dim, config.bits) + 4)).alias("packed_bytes"), (n * config.head_dim * 2).alias("fp16_bytes"))
