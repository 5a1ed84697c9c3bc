"""Hashes of all words of many texts at once, without an object for each word."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
PIECE = 1_000_000  # bytes that are cut into words at a time


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _random(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


#: a random number for each byte (the same for A-Z and a-z), white space, and powers of an odd number and of its inverse
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])
BYTE = _random(256, 1)[LOWER]
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
BASE = 0x9E6C63D0676A9A99
_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, PIECE + 1)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([[U64(1)], np.full(n - 1, U64(b))])) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS


def token_spans(raw: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every token of the bytes, a run of bytes that ``gap`` does not mark. A token's hash is the
    sum of its bytes' numbers times the powers of an odd base, taken from running sums over all bytes; pieces end at a
    gap, so a token is never cut."""
    hashes, starts, ends, lo = [], [], [], 0
    while lo < len(raw):
        hi = min(len(raw), lo + PIECE)
        while hi < len(raw):
            if len(at := np.flatnonzero(gap[raw[max(lo, hi - PIECE):hi]])):
                hi = max(lo, hi - PIECE) + int(at[-1]) + 1
                break
            hi = min(len(raw), hi + PIECE)
        x = raw[lo:hi]
        edge = np.diff(np.concatenate([[True], gap[x], [True]]).astype(np.int8))
        a, b = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = powers(len(x) + 1)
        run = np.concatenate([[U64(0)], np.cumsum(BYTE[x] * up[:len(x)])])
        hashes.append(mix64((run[b] - run[a]) * down[a] + (b - a).astype(U64)))
        starts.append(a + lo)
        ends.append(b + lo)
        lo = hi
    none = np.zeros(0, np.int64)
    return np.concatenate([np.zeros(0, U64), *hashes]), np.concatenate([none, *starts]), np.concatenate([none, *ends])


def token_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every token between white space."""
    return token_spans(raw)[:2]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of anything but ASCII white space, A-Z like a-z, and where each text's begin."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    at = np.cumsum([0, *(len(p) + 1 for p in parts)])
    h, starts = token_hashes(np.frombuffer(b"\n".join(parts), np.uint8))
    return h, np.searchsorted(starts, at)
