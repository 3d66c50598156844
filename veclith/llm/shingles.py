"""Hashed word shingles of many texts at once, in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that separate words, and A-Z to a-z.
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_CHUNK = 1 << 20
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < size:
        odd = np.uint64(_BASE)
        inverse = np.uint64(pow(_BASE, -1, 1 << 64))
        _powers = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, f)]).astype(np.uint64), dtype=np.uint64) for f in (odd, inverse))
    return _powers


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of texts that lie end to end, and the number of words of each text."""
    n = len(data)
    inside = ~_WHITE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # a text's first and last byte bound words too
    own = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[own] = inside[own]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = inside[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[_LOWER[data]] * power[:n], out=sums[1:], dtype=np.uint64)
    words = mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
    return words, np.diff(np.searchsorted(starts, offsets))


def shingles(texts, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct shingle hashes in ascending order) of each text of a pyarrow string array.

    Words are separated by blanks and compared with A-Z in lower case. A text of fewer than
    ``size`` words has one shingle, all its words; one without words, or null, has none.
    Texts are taken whole, in chunks of about a megabyte and at least one text.
    """
    import pyarrow as pa

    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    body = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(_STEP)) | np.uint64(1)
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + _CHUNK, "right")) - 1)
        words, sizes = _word_hashes(body[at[row] : at[stop]], at[row : stop + 1] - at[row])
        grams = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for k in range(size):
            grams += words[k : k + len(grams)] * factors[k]
        grams = mix(grams)
        begin = 0
        for i, count in enumerate(sizes.tolist()):
            if count >= size:
                yield row + i, np.unique(grams[begin : begin + count - size + 1])
            elif count:
                yield row + i, mix((words[begin : begin + count] * factors[:count]).sum(dtype=np.uint64, keepdims=True) + np.uint64(count))
            else:
                yield row + i, np.zeros(0, np.uint64)
            begin += count
        row = stop


def set_key(found: np.ndarray) -> int:
    """Signed 64-bit hash of a set of shingles."""
    return int(mix(found ^ np.uint64(_STEP)).sum(dtype=np.uint64).astype(np.int64))
