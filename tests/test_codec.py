"""Codecs against closed forms and round trips."""

import math

import numpy as np
import pytest

from veclith.config import HADAMARD, QR, QuantizerConfig
from veclith.functions import codec
from veclith.operators.quantize import Product, decode, encode

RNG = np.random.default_rng(5)


def test_config_bounds():
    for bad in ({"dim": 1}, {"dim": 8, "bits": 0}, {"dim": 8, "bits": 9}, {"dim": 8, "rotation": "x"}):
        with pytest.raises(ValueError):
            QuantizerConfig(**bad)
    assert QuantizerConfig(100).work_dim == 128 and QuantizerConfig(100, rotation=QR).work_dim == 100


@pytest.mark.parametrize("n", [4, 64, 1024])
def test_walsh_is_its_own_inverse(n):
    x = RNG.standard_normal((3, n))
    assert np.allclose(codec.walsh(codec.walsh(x)), x, atol=1e-10)


@pytest.mark.parametrize("kind", [HADAMARD, QR])
@pytest.mark.parametrize("dim", [16, 100])
def test_rotation_round_trip_and_length(kind, dim):
    r, x = codec.Rotation(QuantizerConfig(dim, rotation=kind)), RNG.standard_normal((5, dim))
    y = r.forward(x)
    assert np.allclose(r.back(y), x, atol=1e-9) and np.allclose(np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1))


def test_codebook_has_the_known_levels():
    c1, _ = codec.codebook(64, 1)
    c2, _ = codec.codebook(64, 2)
    assert np.allclose(c1 * 8, [-0.7979, 0.7979], atol=1e-4)
    assert np.allclose(c2 * 8, [-1.5104, -0.4528, 0.4528, 1.5104], atol=1e-4)
    for bits in range(1, 6):
        c, b = codec.codebook(128, bits)
        assert (np.diff(c) > 0).all() and np.allclose(c, -c[::-1])
        assert 128 * codec.distortion(128, bits) <= math.sqrt(3) * math.pi / 2 * 4.0**-bits
    exact, _ = codec.codebook(8, 3, True)
    assert np.abs(exact).max() < 1 and not np.allclose(exact, codec.codebook(8, 3)[0])


@pytest.mark.parametrize("bits", range(1, 9))
def test_packing(bits):
    for n in (1, 2, 3, 10, 100, 1001):
        codes = RNG.integers(0, 1 << bits, n).astype(np.uint8)
        data = codec.pack(codes, bits)
        assert len(data) == codec.packed_size(n, bits) and (codec.unpack(data, n, bits) == codes).all()
        back, b, norm = codec.unmarshal(codec.marshal(codes, bits, 2.5))
        assert (back == codes).all() and (b, norm) == (bits, 2.5)


def test_marshalled_sizes():
    for dim, bits, size in ((3072, 4, 1543), (3072, 2, 775), (3072, 3, 1159), (1536, 4, 775)):
        assert len(codec.marshal(np.zeros(dim, np.uint8), bits, 1.0)) == size


def test_half_floats():
    x = np.array([0, 1.5, -2, np.inf], np.float16)
    assert (codec.half(x.tobytes()) == x.astype(np.float32)).all()
    y = np.array([1.0, -3.5], np.float32)
    assert (codec.bfloat((y.view(np.uint32) >> 16).astype("<u2").tobytes()) == y).all()


@pytest.mark.parametrize(("bits", "least"), [(2, 0.88), (3, 0.96), (4, 0.995)])
def test_cosine_after_decoding(bits, least):
    config, x = QuantizerConfig(128, bits), RNG.standard_normal((500, 128))
    codes, norms = encode(x, config)
    y = decode(codes, norms, config)
    cos = (x * y).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
    assert cos.mean() >= least


def test_zero_vector():
    codes, norms = encode(np.zeros((1, 16)), QuantizerConfig(16))
    assert norms[0] == 0 and (decode(codes, norms, QuantizerConfig(16)) == 0).all()


@pytest.mark.parametrize("bits", [2, 3, 4])
def test_product_is_unbiased(bits):
    p = Product(QuantizerConfig(128, bits))
    x, q = RNG.standard_normal((2000, 128)), RNG.standard_normal((1, 128))
    assert abs((p.inner(q, *p.encode(x))[:, 0] - x @ q[0]).mean()) <= 0.5
    with pytest.raises(ValueError):
        Product(QuantizerConfig(128, 1))
