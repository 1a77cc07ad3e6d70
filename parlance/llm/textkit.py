"""Word hashes, shingles and SimHash on NumPy; used inside Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_K = U(0x9E3779B97F4A7C15)
_xx = xxhash.xxh3_64_intdigest


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all others."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words between ASCII white space, with A-Z lower-cased."""
    words = text.lower().split()
    return np.fromiter(map(_xx, words), U, len(words))


def hashed(words: list) -> np.ndarray:
    return np.fromiter(map(_xx, words), U, len(words))


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of each run of k words, in order; of the whole sequence if it is shorter."""
    n = len(h)
    if n == 0:
        return h
    w = min(k, n)
    acc = np.full(n - w + 1, U(w), U)
    for i in range(w):
        acc = acc * _K + h[i : n - w + 1 + i]
    return mix(acc)


_LANES = np.array([sum(1 << (8 * b) for b in range(8) if v >> b & 1) for v in range(256)], U)


def simhash(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHash of each segment of h: a bit is set if over half of the segment's hashes have it.

    Bits are summed eight to a word in byte lanes; segments beyond 255 hashes are summed in pieces.
    """
    if len(starts) == 0:
        return np.empty(0, U)
    if len(h) == 0:
        return np.zeros(len(starts), U)
    pieces = np.maximum(1, -(-sizes // 255))
    owner = np.repeat(np.arange(len(starts)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = starts[owner] + nth * 255
    full = np.zeros((len(h) + 1, 8), U)
    np.take(_LANES, h.view(np.uint8).reshape(-1, 8), out=full[:-1])
    ends = np.minimum(at + 255, starts[owner] + sizes[owner])
    sums = np.add.reduceat(full, np.stack([at, ends], 1).ravel(), axis=0)[::2]
    sums[at >= ends] = 0
    lanes = np.ascontiguousarray(sums).view(np.uint8).reshape(len(owner), 64).astype(np.int32)
    if len(owner) > len(starts):
        lanes = np.add.reduceat(lanes, np.cumsum(pieces) - pieces, axis=0)
    return np.packbits(2 * lanes > sizes[:, None], axis=1, bitorder="little").view(U).ravel()
