"""Word shingles and MinHash signatures of texts, on whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words are split at these ASCII characters; A-Z is lowered first.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE)] = True
#: Bytes of text that are hashed in one go.
CHUNK = 1 << 21
#: 64-bit words of a parity bitmap.
WORDS = 16
_U = np.uint64


def _random64(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64)


_BYTE = _random64(101, 256)
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _random64(103, 8) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values over all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base, n):
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, start)`` of each word of ``data``."""
    raw = np.frombuffer(data.translate(_LOWER), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_IS_SPACE[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up = _powers(_BASE, len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up, out=sums[1:])
    down = _powers(_INVERSE, len(raw))
    words = (sums[ends] - sums[starts]) * down[starts]
    return mix(words ^ mix((ends - starts).astype(np.uint64))), starts


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes, sorted; a shorter text is one shingle, an empty one none."""
    at = 0
    while at < len(texts):
        parts, size, first = [], 0, at
        while at < len(texts) and (not parts or size < CHUNK):
            parts.append((texts[at] or "").encode("utf-8", "surrogatepass"))
            size += len(parts[-1]) + 1
            at += 1
        words, starts = word_hashes(b" ".join(parts))
        borders = np.searchsorted(starts, np.cumsum([0] + [len(p) + 1 for p in parts]))
        whole = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
        for j in range(width):
            whole += words[j : j + len(whole)] * _PLACE[j]
        whole = mix(whole)
        for i in range(at - first):
            a, b = borders[i], borders[i + 1]
            n = b - a
            if n >= width:
                yield np.unique(whole[a : b - width + 1])
            elif n:
                short = np.zeros(1, dtype=np.uint64)
                for j in range(n):
                    short += words[a + j : a + j + 1] * _PLACE[j]
                yield mix(short ^ _U(n))
            else:
                yield np.zeros(0, np.uint64)


def signature(hashes: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """MinHash coordinates of a non-empty set: for each random map the smallest of 32 bits."""
    low = np.full(len(factors), 2**32 - 1, dtype=np.uint64)
    for a in range(0, len(hashes), 4096):
        part = hashes[a : a + 4096, None]
        np.minimum(low, ((part * factors + shifts) >> _U(32)).min(axis=0), out=low)
    return low.astype(np.uint32)


def maps(n: int, seed: int = 107) -> tuple[np.ndarray, np.ndarray]:
    return _random64(seed, n) | _U(1), _random64(seed + 1, n)


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that equal sets share."""
    a, b = mix(hashes ^ _U(0x1234567)), mix(hashes + _U(0x89ABCDEF))
    return int(a.sum(dtype=np.uint64).astype(np.int64)), int(b.sum(dtype=np.uint64).astype(np.int64))


def parity_bits(hashes: np.ndarray) -> np.ndarray:
    """Bitmap of ``WORDS`` words that tells for each of its places whether an odd number of the set's hashes fall there.

    A hash that only one of two sets holds turns one place, so bitmaps differ in no more places than sets in hashes.
    """
    odd = np.bincount((hashes % _U(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)
