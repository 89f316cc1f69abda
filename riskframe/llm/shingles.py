"""Word shingles of whole texts as sorted arrays of 64-bit hashes, with bounded working memory."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa

#: A-Z to a-z on UTF-8 bytes; the bytes of other letters are not in that range.
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: Words hashed at a time.
PIECE = 1 << 16
_MULTIPLIER = 0x9E3779B97F4A7C15
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, n of each at least."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 4096)
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        for k, base in enumerate((_MULTIPLIER, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def span_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Hash of each run of width words (of all words, if fewer), joined by single spaces."""
    data = np.frombuffer(b" ".join(words), np.uint8)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    ends = np.append(np.flatnonzero(data == 32), len(data))
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    first, last = starts[: len(words) - width + 1], ends[width - 1 :]
    return mix((sums[last] - sums[first]) * down[first] + np.uint64(width))


def utf8(text: pa.StringScalar) -> bytes:
    """The bytes of a text, none of a null."""
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of UTF-8 text; A-Z lower-cased, words parted by ASCII white space."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= PIECE:
        return np.unique(span_hashes(words, width))
    pieces = [np.unique(span_hashes(words[i : i + PIECE + width - 1], width)) for i in range(0, len(words) - width + 1, PIECE)]
    return np.unique(np.concatenate(pieces))
