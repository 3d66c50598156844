"""Quantizers over DataFrames: one Arrow pass, no shuffle."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame

from ..config import QuantizerConfig
from ..functions import codec
from ..functions.vectors import TINY


def matrix(column, dim: int | None = None) -> np.ndarray:
    """Rows of a list column without nulls, as float64; another length raises ValueError."""
    lists = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    if lists.null_count:
        raise ValueError("vectors must not be null")
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(lists):
        return np.zeros((0, dim or 0))
    dim = dim or len(values) // len(lists)
    if len(values) != dim * len(lists) or (np.diff(lists.offsets.to_numpy()) != dim).any():
        raise ValueError(f"vectors must have {dim} coordinates")
    return values.reshape(-1, dim)


def code_matrix(column, width: int) -> np.ndarray:
    """Rows of a binary column of ``width`` bytes each."""
    data = b"".join(column.to_pylist())
    if len(data) != width * len(column):
        raise ValueError(f"codes must have {width} bytes")
    return np.frombuffer(data, np.uint8).reshape(-1, width)


def binary(rows: np.ndarray):
    import pyarrow as pa

    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows and their lengths; a row that counts as zero gives zeros and 0."""
    n = np.linalg.norm(x, axis=-1)
    zero = n < TINY
    return np.where(zero[..., None], 0.0, x / np.where(zero, 1.0, n)[..., None]), np.where(zero, 0.0, n)


def encode(x: np.ndarray, config: QuantizerConfig) -> tuple[np.ndarray, np.ndarray]:
    """Codes and lengths of rows."""
    u, norms = unit(x)
    return codec.codes_of(codec.rotation(config).forward(u), codec.codebook(config.work_dim, config.bits, config.exact_pdf)[1]), norms


def decode(codes: np.ndarray, norms: np.ndarray, config: QuantizerConfig) -> np.ndarray:
    centroids = codec.codebook(config.work_dim, config.bits, config.exact_pdf)[0]
    return codec.rotation(config).back(centroids[codes]) * norms[:, None]


def _fields(df: DataFrame, without: tuple[str, ...]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in without)


def _apply(df: DataFrame, without: tuple[str, ...], added: str, make) -> DataFrame:
    """``df`` without some columns plus what ``make(batch)`` returns for ``added``."""
    kept = [c for c in df.columns if c not in without]
    names = [a.split()[0] for a in added.split(", ")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *make(batch)], names=[*kept, *names])

    fields = _fields(df, without)
    return df.mapInArrow(run, f"{fields}, {added}" if fields else added)


def quantize(df: DataFrame, config: QuantizerConfig, vector_col: str = "embedding") -> DataFrame:
    """``df`` with codes (a byte a coordinate) and norm (float) in place of the vector."""

    def make(batch):
        import pyarrow as pa

        codes, norms = encode(matrix(batch.column(vector_col), config.dim), config)
        return binary(codes), pa.array(norms.astype(np.float32))

    return _apply(df, (vector_col, "codes", "norm"), "codes binary, norm float", make)


def dequantize(df: DataFrame, config: QuantizerConfig, vector_col: str = "embedding") -> DataFrame:
    """``df`` with the vector that its codes stand for in place of codes and norm."""

    def make(batch):
        import pyarrow as pa

        x = decode(code_matrix(batch.column("codes"), config.work_dim), batch.column("norm").to_numpy().astype(np.float64), config)
        return (pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * config.dim), pa.array(x.ravel())),)

    return _apply(df, ("codes", "norm", vector_col), f"{vector_col} array<double>", make)


def marshal(df: DataFrame, config: QuantizerConfig) -> DataFrame:
    """``df`` with codes and norm packed into one binary column, ``packed``."""

    def make(batch):
        import pyarrow as pa

        rows = zip(code_matrix(batch.column("codes"), config.work_dim), batch.column("norm").to_pylist(), strict=True)
        return (pa.array([codec.marshal(c, config.bits, n) for c, n in rows], pa.binary()),)

    return _apply(df, ("codes", "norm", "packed"), "packed binary", make)


def unmarshal(df: DataFrame) -> DataFrame:
    def make(batch):
        import pyarrow as pa

        rows = [codec.unmarshal(b) for b in batch.column("packed").to_pylist()]
        return pa.array([c.tobytes() for c, _, _ in rows], pa.binary()), pa.array([n for _, _, n in rows], pa.float32())

    return _apply(df, ("packed", "codes", "norm"), "codes binary, norm float", make)


def asymmetric_cosine(df: DataFrame, query, config: QuantizerConfig) -> DataFrame:
    """``df`` (codes) with ``cosine`` of a full query to what the codes stand for; 0 where a length is zero."""
    q, length = unit(np.asarray(query, np.float64)[None])
    rotated, centroids = codec.rotation(config).forward(q)[0], codec.codebook(config.work_dim, config.bits, config.exact_pdf)[0]

    def make(batch):
        import pyarrow as pa

        c = centroids[code_matrix(batch.column("codes"), config.work_dim)]
        size = np.linalg.norm(c, axis=1)
        ok = (size >= TINY) & (length[0] >= TINY)
        return (pa.array(np.where(ok, c @ rotated / np.where(ok, size, 1), 0.0)),)

    return _apply(df, ("cosine",), "cosine double", make)


class Product:
    """Unbiased inner products: codes of one bit less, and the signs of a random projection of what they miss."""

    def __init__(self, config: QuantizerConfig):
        if config.bits < 2:
            raise ValueError("bits must be from 2 to 8")
        self.base = replace(config, bits=config.bits - 1)
        self.dim = config.dim
        self.projection = np.random.default_rng(config.seed + 1).standard_normal((config.dim, config.dim))
        self.factor = np.sqrt(np.pi / 2) / config.dim

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes, lengths, signs (1 or -1) and lengths of the residuals."""
        codes, norms = encode(x, self.base)
        residual, sizes = unit(x - decode(codes, norms.astype(np.float32).astype(np.float64), self.base))
        return codes, norms, np.where(residual @ self.projection.T >= 0, 1, -1).astype(np.int8), sizes

    def decode(self, codes, norms, signs, sizes) -> np.ndarray:
        return decode(codes, norms, self.base) + (self.factor * sizes)[:, None] * (signs.astype(np.float64) @ self.projection)

    def inner(self, queries: np.ndarray, codes, norms, signs, sizes) -> np.ndarray:
        """Estimated inner products, a row a vector and a column a query."""
        return decode(codes, norms, self.base) @ queries.T + (self.factor * sizes)[:, None] * (signs.astype(np.float64) @ (self.projection @ queries.T))


def quantize_product(df: DataFrame, config: QuantizerConfig, vector_col: str = "embedding") -> DataFrame:
    """``df`` with codes, norm, signs (a byte each) and residual_norm in place of the vector."""
    product = Product(config)

    def make(batch):
        import pyarrow as pa

        codes, norms, signs, sizes = product.encode(matrix(batch.column(vector_col), config.dim))
        return binary(codes), pa.array(norms.astype(np.float32)), binary(signs), pa.array(sizes.astype(np.float32))

    return _apply(df, (vector_col, "codes", "norm", "signs", "residual_norm"), "codes binary, norm float, signs binary, residual_norm float", make)


def inner_product(df: DataFrame, query, config: QuantizerConfig) -> DataFrame:
    """``df`` of :func:`quantize_product` with ``inner``, the estimated inner product with a query."""
    product, q = Product(config), np.asarray(query, np.float64)[None]

    def make(batch):
        import pyarrow as pa

        get = lambda c: batch.column(c).to_numpy().astype(np.float64)
        codes, signs = code_matrix(batch.column("codes"), product.base.work_dim), code_matrix(batch.column("signs"), config.dim).view(np.int8)
        return (pa.array(product.inner(q, codes, get("norm"), signs, get("residual_norm"))[:, 0]),)

    return _apply(df, ("inner",), "inner double", make)
