"""Hashes of words and word shingles, for many texts at a time.

Words are separated by ASCII white space. A word's 64-bit hash is made of its bytes, eight at a
step for all words at once; a shingle's of its words' hashes, each place with an odd factor of
its own, so order counts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

ODD = 0x9E3779B97F4A7C15
#: Words of more bytes are hashed one by one.
LONG = 64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def factor(place: int) -> np.uint64:
    return np.uint64(ODD * (2 * place + 1) & 0xFFFFFFFFFFFFFFFF)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finish for 64-bit hashes."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~IS_SPACE[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, length = edges[::2], edges[1::2] - edges[::2]
    padded = raw + bytes(8)
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    h = length.astype(np.uint64) * np.uint64(ODD)
    todo = np.flatnonzero(length <= LONG)
    at, left = start[todo], length[todo]
    while len(todo):
        # A last piece of fewer than eight bytes: the others are shifted out.
        piece = eight[at] << (np.uint64(8) * np.maximum(8 - left, 0).astype(np.uint64))
        h[todo] = mixed(h[todo] ^ piece)
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(length > LONG):
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : start[i] + length[i]])
    return h, start


def combined(own: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all shingles of ``size`` words in order; fewer words are one shingle, none none."""
    if not len(own):
        return np.zeros(0, np.uint64)
    size = min(size, len(own))
    n = len(own) - size + 1
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total += own[i : n + i] * factor(i)
    return mixed(total)


def shingles_of(texts: Sequence[bytes], size: int) -> list[np.ndarray]:
    """``combined`` of each text."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    words, start = word_hashes(b"\n".join(texts))
    every = combined(words, size) if len(words) >= size else words
    cuts = np.concatenate([[0], np.searchsorted(start, ends)])
    return [every[a : b - size + 1] if b - a >= size else combined(words[a:b], size) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
