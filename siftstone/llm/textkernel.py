"""Vectorised numpy kernels over Arrow string arrays: words, hashes, shingles, winnowing.

A word is a maximal run of letters, digits and other characters that aren't punctuation; ASCII capitals count as small
letters. In scripts that are written without spaces (Han, kana, Thai, Lao, Burmese, Khmer) each character is a word. White
space, ASCII punctuation and the punctuation of Latin-1, general, CJK and full-width blocks separate words. A null text
has no words.

Hashes have no algebraic structure that texts could exploit: bytes and neighbouring hashes are combined by a nonlinear
mixer at every step, never by a polynomial modulo 2**64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from siftstone.llm.common import string_offsets

U = np.uint64
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1

#: Bytes of text handled at once in a worker; arrays of some 50 times this size are alive meanwhile.
SLICE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * U(_Q) + b)


_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    if _b >= 128 or (_c.isascii() and _c.isalnum()):
        _CLASS[_b] = ord(_c.lower()) if _b < 128 else _b

#: Code points that separate words, and those that are words of their own; from first to last.
SEPARATORS = (
    (0xA0, 0xA9), (0xAB, 0xB1), (0xB4, 0xB4), (0xB6, 0xB8), (0xBB, 0xBB), (0xBF, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x206F), (0x2E00, 0x2E7F), (0x3000, 0x3004), (0x3008, 0x303F), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20),
    (0xFF3B, 0xFF40), (0xFF5B, 0xFF65),
)
SOLO = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
#: Regular expression (Java and Python) of one character of SOLO.
SOLO_CLASS = "".join(f"\\u{a:04X}-\\u{b:04X}" if b < 0x10000 else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in SOLO)
_KIND = np.zeros(0x40000, np.uint8)
for _kind, _ranges in ((1, SEPARATORS), (2, SOLO)):
    for _a, _z in _ranges:
        _KIND[_a : _z + 1] = _kind
_MASK = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], U)


@dataclass
class Words:
    """Words of a batch of texts: byte ranges in raw, their text's number, hashes, and the first word of each text."""

    raw: np.ndarray
    folded: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def prefix_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return byte_hashes(self.folded, start, end)


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from each start to its end: eight bytes at a time, each mixed with its place, summed and mixed."""
    if not len(start):
        return np.zeros(0, U)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    length = end - start
    chunks = np.maximum((length + 7) >> 3, 1)
    if chunks.max() == 1:
        x = eights[start] & _MASK[length]
        return mix(mix(x + U(_P)) + length.astype(U) * U(_Q))
    begin = np.cumsum(chunks) - chunks
    k = np.arange(chunks.sum()) - np.repeat(begin, chunks)
    at = np.repeat(start, chunks) + 8 * k
    x = eights[at] & _MASK[np.minimum(np.repeat(end, chunks) - at, 8)]
    x = mix(x + (k + 1).astype(U) * U(_P))
    return mix(np.add.reduceat(x, begin) + length.astype(U) * U(_Q))


def raw_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values' bytes (nulls empty) and their offsets from 0."""
    if array.null_count:
        array = array.fill_null("")
    offsets = string_offsets(array)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _wide(raw: np.ndarray, folded: np.ndarray, forced: np.ndarray) -> None:
    """Clear separators of more than one byte in folded, and mark in forced where characters of SOLO and what follows them begin."""
    n = len(raw)
    for low, high, width in ((0xC2, 0xDF, 2), (0xE0, 0xEF, 3), (0xF0, 0xF4, 4)):
        at = np.flatnonzero((raw >= low) & (raw <= high))
        at = at[at + width <= n]
        if not len(at):
            continue
        point = raw[at].astype(np.int64) & (0x1F, 0x0F, 0x07)[width - 2]
        for k in range(1, width):
            point = (point << 6) | (raw[at + k] & 0x3F)
        kind = _KIND[np.minimum(point, len(_KIND) - 1)]
        gone, solo = at[kind == 1], at[kind == 2]
        for k in range(width):
            folded[gone + k] = 0
        forced[solo] = True
        forced[solo + width] = True


def words(array: pa.Array) -> Words:
    raw, offsets = raw_bytes(array)
    folded = _CLASS[raw]
    n = len(raw)
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    if n and raw.max() >= 0xC2:
        _wide(raw, folded, begins)
    inside = np.zeros(n + 1, bool)
    inside[:n] = folded != 0
    begins[1:n] |= ~inside[: max(n - 1, 0)]
    begins &= inside
    ends = inside[:n] & ~(inside[1:] & ~begins[1:])
    start, end = np.flatnonzero(begins[:n]), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(array)), np.diff(first))
    return Words(raw, folded, offsets, start, end, doc, byte_hashes(folded, start, end), first)


def _power(k: int) -> int:
    return k.bit_length() - 1


def _level(hashes: np.ndarray, p: int, low: np.ndarray | None = None, at: int = 0) -> np.ndarray:
    """Hash of each 2**p consecutive entries, from those of 2**at."""
    out = hashes if low is None else low
    for k in range(at, p):
        out = combine(out[: -(1 << k)], out[1 << k :]) if len(out) > 1 << k else out[:0]
    return out


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries, over all places i with i + k <= n: two overlapping runs of the largest power of two."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U)
    p = _power(k)
    runs = _level(hashes, p)
    return combine(runs[: n - k + 1], runs[k - (1 << p) :][: n - k + 1]) + U(k)


def range_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the entries from each start to its end (longer than nothing); equal to windows() for k entries."""
    out = np.zeros(len(start), U)
    length = end - start
    power = np.frexp(length.astype(np.float64))[1] - 1
    runs, p = hashes, 0
    for q in np.unique(power):
        runs, p = _level(hashes, int(q), runs, p), int(q)
        here = np.flatnonzero(power == q)
        out[here] = combine(runs[start[here]], runs[end[here] - (1 << p)]) + length[here].astype(U)
    return out


def whole(w: Words, k: int) -> np.ndarray:
    """Places whose k words lie in one text."""
    n = len(w.start)
    return np.flatnonzero(w.doc[: n - k + 1] == w.doc[k - 1 :]) if n >= k else np.zeros(0, np.int64)


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, ordered by (text, hash); a text of fewer words has one shingle of all of them."""
    at = whole(w, k)
    hashes, doc = windows(w.hash, k)[at], w.doc[at]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        total = range_hashes(w.hash, w.first[short], w.first[short + 1])
        hashes, doc = np.concatenate([hashes, total]), np.concatenate([doc, short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[keep], doc[keep]


def sliding(x: np.ndarray, w: int, op: np.ufunc, pad) -> np.ndarray:
    """op over each window x[i:i+w], by block prefixes and suffixes; len(x) - w + 1 values."""
    n = len(x)
    blocks = -(-n // w) * w
    y = np.full(blocks, pad, x.dtype)
    y[:n] = x
    y = y.reshape(-1, w)
    left = op.accumulate(y, axis=1).ravel()
    right = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - w + 1], left[w - 1 : n])


def winnow(x: np.ndarray, w: int) -> np.ndarray:
    """Places that are the least of some window of w; any w consecutive places hold at least one."""
    n = len(x)
    if n < w:
        return np.flatnonzero(x == x.min()) if n else np.zeros(0, np.int64)
    low = sliding(x, w, np.minimum, np.iinfo(x.dtype).max)
    high = sliding(np.concatenate([np.zeros(w - 1, x.dtype), low, np.zeros(w - 1, x.dtype)]), w, np.maximum, 0)
    return np.flatnonzero(x == high[:n])


def chars_before(raw: np.ndarray) -> np.ndarray:
    """Number of code points that begin before each byte place, from 0 to len(raw)."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out
