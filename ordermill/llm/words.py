"""Words of many texts at once, as 64-bit hashes in numpy arrays.

Texts are joined into one byte buffer; a word's hash is the difference of a polynomial
prefix sum (modulo 2**64) at its two ends, finalised by a bijective mix.  No Python object
is made per word.  The hash does not depend on where the sum begins, so it is taken over one
window of words after the other: 64-bit arrays are as long as a window, not as the buffer.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

_BASE = 0x9E3779B97F4A7C55 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
KEPT = 1 << 18  # powers kept between calls
WINDOW = 1 << 17  # bytes hashed at once, unless a word is longer
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64, grown by doubling."""
    have = _powers[kind]
    base = _BASE if kind == "up" else _INVERSE
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    if len(have) <= KEPT:  # a longer text's table goes again
        _powers[kind] = have
    return have[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(hash, start, end, buffer): words of all texts in order, with byte places in the buffer,
    in which the texts are joined by a newline."""
    buf = b"\n".join(texts)
    raw = np.frombuffer(buf, np.uint8)
    if not raw.size:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, buf
    blank = _SPACE[raw]
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    start, end = edge[0::2], edge[1::2]
    h, lo = np.empty(len(start), np.uint64), 0
    while lo < len(start):
        first = int(start[lo])
        hi = max(lo + 1, int(np.searchsorted(end, first + WINDOW, side="right")))
        part = raw[first:int(end[hi - 1])]
        sums = np.zeros(part.size + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power("up", part.size), out=sums[1:])
        at, to = start[lo:hi] - first, end[lo:hi] - first
        h[lo:hi] = mix64((sums[to] - sums[at]) * _power("down", part.size + 1)[at] + (to - at).astype(np.uint64))
        lo = hi
    return h, start, end, buf


def starts_of(texts: list[bytes]) -> np.ndarray:
    """Byte place in the joined buffer at which each text starts."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    return np.concatenate([[0], np.cumsum(sizes)[:-1]])


def combined(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` neighbouring word hashes (len(h) - n + 1 of them)."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k:k + size]
    return mix64(out)
