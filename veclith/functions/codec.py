"""NumPy codecs: rotations, codebooks, bit packing, small floats."""

from __future__ import annotations

import math
import struct
from functools import lru_cache

import numpy as np

from ..config import HADAMARD, QuantizerConfig


def walsh(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows at unit scale; its own inverse."""
    n = x.shape[-1]
    y = np.array(x, np.float64)
    step = 1
    while step < n:
        y = y.reshape(*x.shape[:-1], n // (2 * step), 2, step)
        y = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(*x.shape[:-1], n)
        step *= 2
    return y / math.sqrt(n)


class Rotation:
    """A random orthogonal map from ``dim`` to ``work_dim`` coordinates, the same for a seed."""

    def __init__(self, config: QuantizerConfig):
        self.dim, self.work_dim = config.dim, config.work_dim
        random = np.random.default_rng(config.seed)
        if config.rotation == HADAMARD:
            self.first, self.second = (random.integers(0, 2, self.work_dim) * 2.0 - 1.0 for _ in range(2))
            self.matrix = None
        else:
            q, r = np.linalg.qr(random.standard_normal((self.dim, self.dim)))
            # signs of the diagonal make the distribution uniform
            self.matrix = q * np.where(np.diag(r) < 0, -1.0, 1.0)

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Rows rotated; missing coordinates count as zero."""
        if self.matrix is not None:
            return x @ self.matrix.T
        wide = np.zeros((*x.shape[:-1], self.work_dim))
        wide[..., : self.dim] = x
        return walsh(wide * self.first) * self.second

    def back(self, y: np.ndarray) -> np.ndarray:
        if self.matrix is not None:
            return y @ self.matrix
        return (walsh(y * self.second) * self.first)[..., : self.dim]


@lru_cache(maxsize=64)
def rotation(config: QuantizerConfig) -> Rotation:
    return Rotation(config)


#: The quantile start, the clip at six deviations, 200 rounds and the stop at
#: 1e-10 decide which codebook comes out where the iteration is cut off (4 bits and more).
ROUNDS, STOP, CLIP = 200, 1e-10, 6.0
_NODES, _NODE_WEIGHTS = np.polynomial.legendre.leggauss(100)


def _moments(d: int, exact: bool):
    """Mass and first moment of the density of a coordinate between two bounds."""
    if not exact:
        sigma = 1 / math.sqrt(d)

        def gaussian(a: float, b: float) -> tuple[float, float]:
            u, v = a / sigma, b / sigma
            mass = 0.5 * (math.erf(v / math.sqrt(2)) - math.erf(u / math.sqrt(2)))
            return mass, sigma * (math.exp(-u * u / 2) - math.exp(-v * v / 2)) / math.sqrt(2 * math.pi)

        return gaussian
    scale = math.exp(math.lgamma(d / 2) - math.lgamma((d - 1) / 2)) / math.sqrt(math.pi)

    def beta(a: float, b: float) -> tuple[float, float]:
        a, b = max(a, -1.0), min(b, 1.0)
        if b <= a:
            return 0.0, 0.0
        x = (a + b) / 2 + (b - a) / 2 * _NODES
        p = scale * np.maximum(0.0, 1 - x * x) ** ((d - 3) / 2) * _NODE_WEIGHTS * (b - a) / 2
        return float(p.sum()), float((p * x).sum())

    return beta


def _normal_quantile(p: float) -> float:
    lo, hi = -10.0, 10.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < p else (lo, mid)
    return (lo + hi) / 2


@lru_cache(maxsize=64)
def codebook(d: int, bits: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Centroids (ascending) and the boundaries between them: Lloyd-Max for one coordinate."""
    levels, sigma = 1 << bits, 1 / math.sqrt(d)
    limit = min(CLIP * sigma, 1.0) if exact else CLIP * sigma
    moments = _moments(d, exact)
    c = np.array([min(max(sigma * _normal_quantile((2 * i + 1) / (2 * levels)), -limit), limit) for i in range(levels)])
    for _ in range(ROUNDS):
        edges = [-limit, *((c[1:] + c[:-1]) / 2), limit]
        new = c.copy()
        for i in range(levels):
            mass, first = moments(edges[i], edges[i + 1])
            if mass > 1e-300:
                new[i] = first / mass
        moved, c = float(np.abs(new - c).max()), new
        if moved < STOP:
            break
    c = (c - c[::-1]) / 2  # the density is symmetric
    return c, (c[1:] + c[:-1]) / 2


def distortion(d: int, bits: int, exact: bool = False) -> float:
    """Expected squared error of one coordinate."""
    c, b = codebook(d, bits, exact)
    sigma = 1 / math.sqrt(d)
    limit = min(CLIP * sigma, 1.0) if exact else CLIP * sigma
    edges, total = [-limit, *b, limit], 0.0
    scale = math.exp(math.lgamma(d / 2) - math.lgamma((d - 1) / 2)) / math.sqrt(math.pi)
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        x = (lo + hi) / 2 + (hi - lo) / 2 * _NODES
        p = scale * np.maximum(0.0, 1 - x * x) ** ((d - 3) / 2) if exact else np.exp(-x * x * d / 2) / (sigma * math.sqrt(2 * math.pi))
        total += float(((x - c[i]) ** 2 * p * _NODE_WEIGHTS).sum() * (hi - lo) / 2)
    return total


def codes_of(rotated: np.ndarray, boundaries: np.ndarray) -> np.ndarray:
    return np.searchsorted(boundaries, rotated, "left").astype(np.uint8)


def pack(codes: np.ndarray, bits: int) -> bytes:
    """Codes of 1 to 8 bits, lowest bit first."""
    return np.packbits((codes.astype(np.uint8)[:, None] >> np.arange(bits, dtype=np.uint8) & 1).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits]
    return (flat.reshape(n, bits) << np.arange(bits, dtype=np.uint8)).sum(1).astype(np.uint8)


def packed_size(n: int, bits: int) -> int:
    return -(-n * bits // 8)


def marshal(codes: np.ndarray, bits: int, norm: float) -> bytes:
    """A vector on its own: coordinates (16 bits), bits (8), length (float32), packed codes."""
    return struct.pack("<HBf", len(codes), bits, norm) + pack(codes, bits)


def unmarshal(data: bytes) -> tuple[np.ndarray, int, float]:
    n, bits, norm = struct.unpack_from("<HBf", data)
    if len(data) != 7 + packed_size(n, bits):
        raise ValueError("wrong length")
    return unpack(data[7:], n, bits), bits, norm


def half(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f2").astype(np.float32)


def bfloat(data: bytes) -> np.ndarray:
    return (np.frombuffer(data, "<u2").astype(np.uint32) << 16).view(np.float32)
