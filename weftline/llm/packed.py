"""Numbers in binary columns, byte planes apart so that they compress in shuffles and files."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(values: np.ndarray) -> bytes:
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def unpack(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def squeeze(values: np.ndarray) -> bytes:
    """As ``pack``, entropy-coded."""
    return zstandard.compress(pack(values), 1)


def unsqueeze(raw: bytes, kind: str) -> np.ndarray:
    return unpack(zstandard.decompress(raw), kind)


def squeeze_keys(keys: np.ndarray, bits: int) -> bytes:
    """The leading ``bits`` bits of sorted 64-bit keys, as differences."""
    return squeeze(np.diff(keys >> np.uint64(64 - bits), prepend=np.uint64(0)))


def unsqueeze_keys(raw: bytes, bits: int) -> np.ndarray:
    """The keys, whose other bits are 0."""
    return np.cumsum(unsqueeze(raw, "<u8"), dtype=np.uint64) << np.uint64(64 - bits)


def slices_by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted 64-bit keys: the buckets that occur, and where each begins and ends. Buckets are ranges of keys."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(keys) else np.empty(0, np.int64)
    return bucket[starts].astype(np.int64), starts, np.append(starts[1:], len(keys))
