"""Arrays of 64-bit integers as compressed bytes, for rows that carry many numbers."""

from __future__ import annotations

import numpy as np
import zstandard

U = np.uint64


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit integers, byte planes apart."""
    head = np.array([len(arrays), *map(len, arrays)], np.int64).tobytes()
    planes = [np.ascontiguousarray(np.asarray(a).astype(U).view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpack(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    out, at = [], 8 * (n + 1)
    for size in np.frombuffer(raw, np.int64, n, 8).tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * 8, at).reshape(8, size).T).view(U).reshape(-1))
        at += size * 8
    return out
