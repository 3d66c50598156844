"""Vector arithmetic as Catalyst expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below these lengths a vector, and a product of squared lengths, count as zero.
TINY, TINY_SQUARED = 1e-15, 1e-30


def _c(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a, b) -> Column:
    """Sum of products; null if the lengths differ."""
    a, b = _c(a), _c(b)
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: x * y)))


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, v: s + v * v))


def multiply(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x * y)


def scale(a, factor) -> Column:
    return F.transform(_c(a), lambda v: v * factor)


def normalize(a) -> Column:
    """Unit vector; zeros for a vector that counts as zero."""
    a = _c(a)
    return F.when(norm(a) < TINY, F.transform(a, lambda v: v * 0.0)).otherwise(scale(a, 1 / norm(a)))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 for empty vectors and where a length counts as zero."""
    a, b = _c(a), _c(b)
    product = dot(a, a) * dot(b, b)
    return F.when(F.coalesce(F.sqrt(product) < TINY_SQUARED, F.lit(True)), 0.0).otherwise(dot(a, b) / F.sqrt(product))


def l2_squared(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def negative_dot(a, b) -> Column:
    return -dot(a, b)


def hadamard(a, size: int) -> Column:
    """Walsh-Hadamard transform of ``size`` coordinates (a power of two) at unit scale."""
    a = _c(a)
    sign = lambda i, j: F.when(F.bit_count(i.bitwiseAND(j)) % 2 == 0, 1.0).otherwise(-1.0)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: _sum(F.transform(a, lambda x, i: x * sign(i, j))) / size**0.5)


def quantized(a, boundaries: list[float]) -> Column:
    """Codes: for each coordinate the number of boundaries below it."""
    return F.transform(_c(a), lambda y: sum((F.when(F.lit(b) < y, 1).otherwise(0) for b in boundaries), F.lit(0)))


def dequantized(codes, centroids: list[float]) -> Column:
    codes = F.col(codes) if isinstance(codes, str) else codes
    return F.transform(codes, lambda c: F.get(F.array(*map(F.lit, centroids)), c))
