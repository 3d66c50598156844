"""Model weights: rows of tensors quantized, and how well they are kept."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import HADAMARD, QuantizerConfig
from ..functions import codec
from .quantize import decode, encode

SAMPLE_EVERY = 100


def compress(rows: DataFrame, bits: int = 4, seed: int = 42, rotation: str = HADAMARD) -> DataFrame:
    """(file, tensor, row, width, codes, norm, cosine) of (file, tensor, row, values).

    Each width has its quantizer. ``cosine`` to the original is taken of every 100th row.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("values")
            values, at = lists.flatten().to_numpy().astype(np.float64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            numbers = batch.column("row").to_numpy()
            codes, norms, cosines = [None] * len(lists), np.zeros(len(lists), np.float32), [None] * len(lists)
            widths = np.diff(at)
            for width in np.unique(widths):
                if width < 2:
                    raise ValueError("rows must have two values or more")
                config = QuantizerConfig(int(width), bits, seed, rotation)
                own = np.flatnonzero(widths == width)
                x = values[at[own][:, None] + np.arange(width)]
                c, n = encode(x, config)
                norms[own] = n
                for i, place in enumerate(own):
                    codes[place] = codec.pack(c[i], bits)
                some = np.flatnonzero(numbers[own] % SAMPLE_EVERY == 0)
                y = decode(c[some], n[some], config)
                size = np.linalg.norm(x[some], axis=1) * np.linalg.norm(y, axis=1)
                for i, v in zip(own[some], np.where(size > 0, (x[some] * y).sum(1) / np.where(size > 0, size, 1), 0.0), strict=True):
                    cosines[i] = float(v)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("tensor"), batch.column("row"), pa.array(widths.astype(np.int32)), pa.array(codes, pa.binary()), pa.array(norms), pa.array(cosines, pa.float64())], names=["file", "tensor", "row", "width", "codes", "norm", "cosine"])

    return rows.select("file", "tensor", "row", "values").mapInArrow(run, "file string, tensor string, row long, width int, codes binary, norm float, cosine double")


def restore(packed: DataFrame, bits: int = 4, seed: int = 42, rotation: str = HADAMARD) -> DataFrame:
    """(file, tensor, row, values) of what :func:`compress` made."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for width, data, norm in zip(batch.column("width").to_pylist(), batch.column("codes").to_pylist(), batch.column("norm").to_pylist(), strict=True):
                config = QuantizerConfig(width, bits, seed, rotation)
                out.append(decode(codec.unpack(data, config.work_dim, bits)[None], np.array([norm], np.float64), config)[0])
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("tensor"), batch.column("row"), pa.array(out, pa.list_(pa.float64()))], names=["file", "tensor", "row", "values"])

    return packed.select("file", "tensor", "row", "width", "codes", "norm").mapInArrow(run, "file string, tensor string, row long, values array<double>")


def summary(packed: DataFrame) -> DataFrame:
    """(file, tensor, rows, cols, bytes, avg_cosine) by tensor."""
    return packed.groupBy("file", "tensor").agg(F.count(F.lit(1)).alias("rows"), F.max("width").alias("cols"), F.sum((F.octet_length("codes") + 4).cast("long")).alias("bytes"), F.avg("cosine").alias("avg_cosine"))
