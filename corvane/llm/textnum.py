"""Array kernels over Arrow text columns: words, shingles, fingerprints.

All kernels work on whole texts.  They cut a batch into chunks of 256 KB between documents (one
document longer than that is a chunk of its own), so memory follows the longest document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
U64 = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_MUL = _rng.integers(1, 1 << 62, 8, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_P = U64(0x9E3779B97F4A7C15)
_P_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's constants)."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw[:0], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK):
    """Ranges of documents whose texts hold about limit bytes together."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


_pow: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for k, base in enumerate((_P, _P_INV)):
            p = np.full(n, base, U64)
            p[0] = 1
            _pow[k] = np.multiply.accumulate(p)
    return _pow[0], _pow[1]


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of documents i..: (hash of each word, words before each document).

    A word is a run of bytes other than space and 0x09-0x0D; documents never share a word."""
    n = len(off) - 1
    buf = np.full(len(raw) + n + 1, 0x20, np.uint8)
    lengths = np.diff(off)
    if len(raw):
        buf[np.arange(len(raw)) + np.repeat(np.arange(n), lengths) + 1] = LOWER[raw]
    gap = SPACE[buf]
    start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    up, down = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    words = mix((total[end] - total[start]) * down[start] + (end - start).astype(U64) * _MUL[7])
    first = np.searchsorted(start, off + np.arange(n + 1))
    return words, first


def shingle_sets(raw: np.ndarray, off: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each document's word shingles; a shorter document is one shingle; no words: empty."""
    words, first = word_hashes(raw, off)
    rolled = np.zeros(max(0, len(words) - width + 1), U64)
    for j in range(width):
        rolled += words[j : j + len(rolled)] * _MUL[j % 7]
    rolled = mix(rolled + U64(width))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            v = U64(b - a) + sum((words[a + j : a + j + 1] * _MUL[j % 7] for j in range(b - a)), np.zeros(1, U64))
            out.append(mix(v))
        else:
            out.append(rolled[:0])
    return out


def set_key(s: np.ndarray) -> int:
    """One signed 64-bit key for a set of hashes."""
    x = np.array([len(s)], U64)
    if len(s):
        x = x * _MUL[0] + np.bitwise_xor.reduce(s, keepdims=True) * _MUL[1] + mix(s ^ _MUL[2]).sum(dtype=U64, keepdims=True)
    return int(mix(x).view(np.int64)[0])


def doubled(x: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of the length-byte strings at each position, by prefix doubling: the name of 2m bytes is made of
    the names of m bytes at i and i + m; the last step overlaps.  x: bytes."""
    h, m = _BYTE[x], 1
    while m < length:
        step = min(m, length - m)
        a = h[: len(h) - step] if len(h) > step else h[:0]
        h = a * _MUL[3] + (h[step:] ^ (h[step:] >> U64(29))) * _MUL[4]
        h ^= h >> U64(32)
        m += step
    return h


def leftmost_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of width values, the position of its smallest value (the leftmost of equal ones)."""
    at, val, m = np.arange(len(h), dtype=np.int32), h, 1
    while m < width:
        step = min(m, width - m)
        if len(val) <= step:
            return at[:0]
        right = val[step:] < val[:-step]
        at = np.where(right, at[step:], at[:-step])
        val = np.where(right, val[step:], val[:-step])
        m += step
    return at
