"""Word shingles of whole texts as sorted distinct 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

WORDS = 5

# Fixed value: the characters between words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 20
# Words of more bytes than this are hashed by xxh3.
LONG_WORD = 64


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a fixed bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACES = _mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _powers(base: int, n: int, kept: dict = {}) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    if len(kept.get(base, ())) < n:
        p = np.full(n, base, dtype=np.uint64)
        p[:1] = 1
        kept[base] = np.cumprod(p)
    return kept[base][:n]


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of lower-cased bytes.

    Polynomials modulo 2^64 collide by construction for some pairs of words
    of a thousand letters and more, so long words are hashed one by one.
    """
    b = np.frombuffer(text, dtype=np.uint8)
    inside = np.concatenate([[False], ~SPACE[b], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(b)), out=total[1:])
    value = (total[end] - total[start]) * _powers(_INVERSE, len(b) + 1)[start]
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        value[i] = xxhash.xxh3_64_intdigest(text[start[i] : end[i]])
    return _mix(value + (end - start).astype(np.uint64) * _PLACES[63]), start


def _combined(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for every run of ``k`` words."""
    n = len(words) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out += words[i : i + n] * _PLACES[i]
    return _mix(out)


def shingle_sets(texts: list[bytes | None], k: int = WORDS) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes, computed in chunks of many texts.

    Fewer than ``k`` words give one hash for the whole sequence; no words
    (or null) an empty set.
    """
    at = 0
    while at < len(texts):
        chunk, size = [], 0
        while at < len(texts) and (not chunk or size < _CHUNK):
            chunk.append((texts[at] or b"").lower())
            size += len(chunk[-1]) + 1
            at += 1
        begins = np.cumsum([0] + [len(t) + 1 for t in chunk])
        words, start = word_hashes(b"\n".join(chunk))
        cuts = np.searchsorted(start, begins)
        runs = _combined(words, k) if len(words) >= k else words[:0]
        for i in range(len(chunk)):
            a, z = cuts[i], cuts[i + 1]
            if z - a >= k:
                h = np.sort(runs[a : z - k + 1])
                yield h[np.concatenate([[True], h[1:] != h[:-1]])]
            elif z > a:
                yield _combined(words[a:z], z - a)
            else:
                yield words[:0]


def fingerprint(tokens: np.ndarray) -> bytes:
    """128-bit hash of a set: equal sets, equal fingerprints."""
    return xxhash.xxh3_128_digest(tokens.tobytes())


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union (neither set empty)."""
    if not len(a) or not len(b):
        return False
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
