"""64-bit hashes of the words of texts, vectorised over whole batches of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.RandomState(20240229).randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text hashed at once.
CHUNK = 1 << 17
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, CHUNK + 4096)
        with np.errstate(over="ignore"):
            _pow = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, _BASE, np.uint64), dtype=np.uint64)))
            _inv = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, _INV, np.uint64), dtype=np.uint64)))
    return _pow, _inv


def _hash_buffer(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, start offsets) of the words in a buffer."""
    buf = np.frombuffer(raw, np.uint8)
    gap = _SPACE[buf]
    edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, np.uint64), start
    power, inverse = _powers(len(buf))
    pref = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * power[: len(buf)], dtype=np.uint64)))
    h = (pref[end] - pref[start]) * inverse[start]
    return mix64(h + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)), start


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text (UTF-8) the hashes of its words, in order; equal words have equal hashes everywhere."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < CHUNK):
            size += len(texts[hi]) + 1
            hi += 1
        h, start = _hash_buffer(b"\n".join(texts[lo:hi]))
        ends = np.cumsum([len(t) + 1 for t in texts[lo:hi]])
        yield from np.split(h, np.searchsorted(start, ends)[:-1])
        lo = hi


def gram_hashes(words: np.ndarray, n: int, step: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all runs of n words (none if there are fewer words)."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(step)
        out += words[k : len(words) - n + 1 + k]
    return mix64(out)
