"""Parameters of quantizers, indexes and caches."""

from __future__ import annotations

from dataclasses import dataclass

HADAMARD, QR = "hadamard", "qr"
AUTO, IVF, HNSW, NONE = "auto", "ivf", "hnsw", "none"


@dataclass(frozen=True)
class QuantizerConfig:
    """Dimension, bits a coordinate, seed of the rotation, its kind, and the density that codebooks fit.

    ``exact_pdf`` fits the marginal of a uniformly random unit vector instead of its
    Gaussian limit, which differs for few dimensions.
    """

    dim: int
    bits: int = 4
    seed: int = 42
    rotation: str = HADAMARD
    exact_pdf: bool = False

    def __post_init__(self):
        if self.dim < 2:
            raise ValueError("dim must be 2 or more")
        if not 1 <= self.bits <= 8:
            raise ValueError("bits must be from 1 to 8")
        if self.rotation not in (HADAMARD, QR):
            raise ValueError(f"unknown rotation {self.rotation!r}")

    @property
    def work_dim(self) -> int:
        """Coordinates after the rotation: the next power of two for Hadamard."""
        return 1 << (self.dim - 1).bit_length() if self.rotation == HADAMARD else self.dim


@dataclass(frozen=True)
class IndexConfig:
    """How an index is built; 0 leaves a number to the data's size."""

    kind: str = AUTO
    partitions: int = 0
    probe: int = 0
    neighbours: int = 16
    build_width: int = 200
    seed: int = 42


@dataclass(frozen=True)
class CacheConfig:
    """An attention cache: heads' dimension and the quantizer of keys and values."""

    layers: int
    heads: int
    head_dim: int
    bits: int = 4
    seed: int = 42
    rotation: str = HADAMARD

    @property
    def quantizer(self) -> QuantizerConfig:
        return QuantizerConfig(self.head_dim, self.bits, self.seed, self.rotation)
