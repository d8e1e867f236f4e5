"""Hashes of all words of a text at once."""

from __future__ import annotations

import numpy as np
import xxhash

from docmill.llm.common import SPACES

SPACE = np.isin(np.arange(256), list(SPACES.encode()))
_MASK = np.array([2 ** (8 * k) - 1 for k in range(9)], dtype=np.uint64)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
LONG = 1024  # bytes from which a word is hashed by itself


def word_edges(flat: bytes, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words of ``flat``; ``gaps`` marks the bytes between words."""
    gap = np.frombuffer((flat + b"\n").translate(gaps.tobytes()), dtype=bool)
    edges = np.flatnonzero(np.concatenate([~gap[:1], gap[1:] != gap[:-1]]))
    return edges[::2], edges[1::2] - edges[::2]


def word_hashes(flat: bytes, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes and starts of the words of ``flat``, eight bytes of all words a step.
    ``gaps`` marks the bytes between words; a new line is one of them."""
    starts, sizes = word_edges(flat, gaps)
    return hashes_at(flat, starts, sizes), starts


def hashes_at(flat: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """:func:`word_hashes` of some words of ``flat``."""
    data = np.frombuffer(flat + b"\n" + bytes(8), dtype=np.uint8)
    window = np.ndarray((len(flat) + 1,), dtype="<u8", buffer=data, strides=(1,))
    h = sizes.astype(np.uint64) * _C2
    long = np.flatnonzero(sizes > LONG)
    live = np.flatnonzero(sizes <= LONG) if len(long) else slice(None)
    at, left = starts[live], sizes[live]
    while len(left):
        x = (h[live] ^ (window[at] & _MASK[np.minimum(left, 8)])) * _C1
        x = (x ^ (x >> np.uint64(29))) * _C2
        h[live] = x ^ (x >> np.uint64(32))
        more = np.flatnonzero(left > 8)
        live, at, left = more if isinstance(live, slice) else live[more], at[more] + 8, left[more] - 8
    for i, a, n in zip(long.tolist(), starts[long].tolist(), sizes[long].tolist(), strict=True):
        h[i] = xxhash.xxh3_64_intdigest(flat[a : a + n])
    return (h >> np.uint64(16)).astype(np.int64)
