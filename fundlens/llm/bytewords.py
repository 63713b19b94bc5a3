"""Words and their 64-bit hashes straight from UTF-8 bytes, vectorised over many texts.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; A-Z count as a-z. Both rules
touch ASCII only, so working on bytes equals working on characters.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
PUNCT = SPACE.copy()  # separators when punctuation does not belong to words
PUNCT[[c for c in range(128) if not chr(c).isalnum()]] = True
_T = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
LONG, PIECE = 1 << 20, 1 << 19
_pow: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        m = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_P, _PINV)):
                a = np.full(m, base, U)
                a[0] = 1
                _pow[k] = np.multiply.accumulate(a)
    return _pow[0][:n], _pow[1][:n]


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, hash) of each word, and the n+1 word offsets of the texts."""
    return _words_in_pieces(data, offsets, space) if len(data) > LONG else _words(data, offsets, space)


def _words(data, offsets, space):
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U), np.zeros(len(offsets), np.int64)
    w = ~space[data]
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = w[inner]
    last[inner - 1] = w[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        c = np.zeros(n + 1, U)
        np.cumsum(_T[LOWER[data]] * up, out=c[1:])
        h = mix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))
    return starts, ends, h, np.searchsorted(starts, offsets)


def _words_in_pieces(data, offsets, space):
    """The same over pieces that end at a separator or a text's end, so a long text costs no more
    memory a byte than a short one."""
    parts, a, n = [], 0, len(data)
    while a < n:
        b = min(n, a + PIECE)
        while b < n:        # on to the next separator, looking at one piece more at a time
            gap = np.flatnonzero(space[data[b:b + PIECE]])[:1]
            if len(gap):
                b += int(gap[0])
                break
            b = min(n, b + PIECE)
        inner = offsets[(offsets > a) & (offsets < b)] - a
        s, e, h, _ = _words(data[a:b], np.concatenate([[0], inner, [b - a]]), space)
        parts.append((s + a, e + a, h))
        a = b
    starts, ends, h = (np.concatenate([p[i] for p in parts]) for i in range(3))
    return starts, ends, h, np.searchsorted(starts, offsets)


def ngrams(h: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word runs inside each text, and the n+1 run offsets of the texts.

    Run j of text d covers the words woff[d]+j .. woff[d]+j+k-1; shorter texts have none.
    """
    if len(h) < k:
        return np.zeros(0, U), np.zeros(len(woff), np.int64)
    with np.errstate(over="ignore"):
        acc = h[:len(h) - k + 1].copy()
        for i in range(1, k):
            acc = acc * U(0xFF51AFD7ED558CCD) + h[i:len(h) - k + 1 + i]
        acc = mix(acc)
    n = np.maximum(np.diff(woff) - k + 1, 0)
    off = np.concatenate([[0], np.cumsum(n)])
    take = np.arange(off[-1]) + np.repeat(woff[:-1] - off[:-1], n)
    return acc[take], off


def whole(h: np.ndarray) -> np.uint64:
    """One hash of a short word sequence (its length is part of it)."""
    with np.errstate(over="ignore"):
        acc = U(len(h)) * U(0xC2B2AE3D27D4EB4F)
        for x in h:
            acc = acc * U(0x9FB21C651E98DF25) + x
        return mix(np.array([acc], U))[0]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Per text its sorted distinct k-word shingles; fewer words: the sequence as one; none: empty."""
    _, _, h, woff = words(data, offsets)
    g, goff = ngrams(h, woff, k)
    out = []
    for d in range(len(offsets) - 1):
        if goff[d + 1] > goff[d]:
            out.append(np.unique(g[goff[d]:goff[d + 1]]))
        elif woff[d + 1] > woff[d]:
            out.append(np.array([whole(h[woff[d]:woff[d + 1]])], U))
        else:
            out.append(np.zeros(0, U))
    return out
