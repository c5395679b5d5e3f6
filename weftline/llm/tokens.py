"""Vectorised words: 64-bit hashes of lower-cased, white-space separated words.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. All bytes of a block are
hashed at once with numpy; no per-word Python runs.
"""

from __future__ import annotations

import numpy as np

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.Generator(np.random.PCG64(20_240_601)).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, over uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each text's number of words."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    data = np.frombuffer(b"\n".join(raw).translate(_LOWER) + b"\n", dtype=np.uint8)
    solid = ~_SPACE[data]
    edge = np.diff(solid.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(raw), np.int64)
    length = ends - starts
    at = np.cumsum(length) - length
    place = np.arange(int(length.sum()), dtype=np.int32) - np.repeat(at.astype(np.int32), length)
    part = _BYTE[data[solid]] * _powers(int(length.max()))[place]
    hashes = mix(np.add.reduceat(part, at) + length.astype(np.uint64))
    first = np.concatenate(([0], np.cumsum(sizes + 1)))
    return hashes, np.diff(np.searchsorted(starts, first))


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words has its whole sequence as one shingle; one without
    words has an empty set.
    """
    words, counts = word_hashes(texts)
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    for k in range(min(width, n)):  # the sum is over the words of the shingle, each with the weight of its place
        weight = mix(np.array([k + 1], np.uint64)) | np.uint64(1)
        rolled[: n - k] += mix(words[k:] * weight + np.uint64(k))
    rolled = mix(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(rolled[at : at + c - width + 1]))
        elif c:
            own = words[at : at + c]
            weights = mix(np.arange(1, c + 1, dtype=np.uint64)) | np.uint64(1)
            short = mix(own * weights + np.arange(c, dtype=np.uint64)).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + np.array([c], np.uint64) * _BASE))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out
