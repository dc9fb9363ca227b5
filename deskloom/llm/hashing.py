"""Words, lines and shingles of many texts at once, as 64-bit hashes in numpy.

A word's hash is a polynomial over random values of its bytes, taken from one running sum over the
block, so nothing is done word by word. Equal hashes stand for equal words and shingles.
"""

from __future__ import annotations

import numpy as np

from deskloom.llm.common import BLOCK_BYTES

_SPACES = (0x20, *range(0x09, 0x0E))
#: Bytes of words between white space.
SPACED = np.ones(256, bool)
SPACED[list(_SPACES)] = False
#: Bytes of words between anything but letters, digits and characters beyond ASCII.
TERMS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _VALUES[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _edges(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs; a run never crosses a bound."""
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    inner = bounds[bounds < len(inside)]
    before[inner] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[inner[inner > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(
    data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED, fold: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, first byte and end byte of every word of the texts, in order.

    ``offsets`` bound the texts within ``data``. Long texts are taken in pieces that end between
    words. ``fold``: A-Z count as a-z.
    """
    values = _FOLDED if fold else _VALUES
    found, at, last = [], int(offsets[0]), int(offsets[-1])
    while at < last:
        end = min(at + BLOCK_BYTES, last)
        if end < last:  # on to the end of the word
            step = 1 << 10
            while end < last and (rest := kind[data[end : end + step]]).all() and len(rest):
                end += len(rest)
            end = min(last, end + int(np.argmin(kind[data[end : end + step]])) if end < last else last)
        piece = data[at:end]
        inside = kind[piece]
        low, high = np.searchsorted(offsets, (at, end), side="left")
        starts, ends = _edges(inside, offsets[low : high + 1] - at)
        if len(starts):
            power, inverse = _tables(len(piece) + 1)
            total = np.empty(len(piece) + 1, np.uint64)
            total[0] = 0
            np.cumsum(values[piece] * power[: len(piece)], out=total[1:])
            hashes = (total[ends] - total[starts]) * inverse[starts]
            found.append((mix(hashes), starts + at, ends + at))
        at = end
    if not found:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found))
    return hashes, np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def shingles(hashes: np.ndarray, group: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words within a group, and the number of its first word."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(hashes) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= np.uint64(0xD1342543DE82EF95)
        out += hashes[i : i + n]
    at = np.flatnonzero(group[:n] == group[k - 1 :])
    return mix(out[at]), at


def sets_of(hashes: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each group, ascending, and the bounds of the groups among them."""
    order = np.lexsort((hashes, group))
    h, g = hashes[order], group[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    h, g = h[keep], g[keep]
    return h, np.searchsorted(g, np.arange(groups + 1))


def shingle_sets(hashes: np.ndarray, group: np.ndarray, groups: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each group; a shorter group has its whole sequence as one."""
    found, at = shingles(hashes, group, k)
    owner = group[at]
    bounds = np.searchsorted(group, np.arange(groups + 1))
    size = np.diff(bounds)
    extra, extra_owner = [], []
    for length in range(1, k):
        short = np.flatnonzero(size == length)
        if len(short):
            rows = bounds[short][:, None] + np.arange(length)
            whole, _ = shingles(hashes[rows].ravel(), np.repeat(short, length), length)
            extra.append(mix(whole + np.uint64(length)))
            extra_owner.append(short)
    if extra:
        found, owner = np.concatenate([found, *extra]), np.concatenate([owner, *extra_owner])
    return sets_of(found, owner, groups)


def set_digest(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each set, the same for the same elements."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)))))
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def min_hashes(h: np.ndarray, bounds: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """(sets, n) smallest hashes under n permutations; an empty set has the largest number."""
    sets = len(bounds) - 1
    out = np.full((sets, n), np.uint64((1 << 64) - 1))
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        starts = bounds[:-1][full]
        salts = np.random.default_rng(77 + seed).integers(1, 1 << 63, n, dtype=np.uint64)
        for k in range(n):
            # One multiplication after the xor is enough: the input is mixed already.
            out[full, k] = np.minimum.reduceat((h ^ salts[k]) * np.uint64(0xFF51AFD7ED558CCD), starts)
    return out


def bands(minima: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands) hashes of ``rows`` neighbouring minima each."""
    sets, n = minima.shape
    out = np.zeros((sets, n // rows), np.uint64)
    for i in range(rows):
        out = out * np.uint64(0xD1342543DE82EF95) + minima[:, i::rows][:, : n // rows]
    return mix(out).view(np.int64)
