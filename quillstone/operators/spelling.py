"""Match ratios of many short texts at once: Ratcliff and Obershelp's, as difflib has it, over arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np

#: Characters up to which a text is compared in arrays (bits of a number). Longer ones are compared one by one.
SHORT = 63
#: Rows multiplied at once, and pairs compared at once.
TILE, BATCH = 1024, 4096

Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def near(texts: list[str], rank: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[Pairs]:
    """Pairs (a, b, ratio) of a row of ``left`` and one of ``right`` whose texts match at least ``threshold`` of 100; ``rank`` is lower in ``a``.

    Every pair is bounded by the characters the two have in common, then by their longest common subsequence, and what is left is matched.
    ``left`` and ``right`` are the same rows or have none in common. ``wanted`` may leave out pairs; it is asked again as results are used.
    """
    once = left is right
    wanted = wanted or (lambda a, b: np.ones(len(a), bool))
    share = threshold / 100
    length = np.array([len(t) for t in texts], np.int64)
    brief = length <= SHORT

    def ordered(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        on = (rank[x] < rank[y] if once else rank[x] != rank[y]) & (2 * np.minimum(length[x], length[y]) >= share * (length[x] + length[y]) - 1e-6)
        x, y = x[on], y[on]
        swap = rank[x] > rank[y]
        a, b = np.where(swap, y, x), np.where(swap, x, y)
        on = wanted(a, b)
        return a[on], b[on]

    some = Texts([t if short else "" for t, short in zip(texts, brief, strict=True)])
    for x, y in common(some, left[brief[left]], right[brief[right]], share):
        a, b = ordered(x, y)
        on = in_order(some, a, b, share)
        a, b = a[on], b[on]
        for k in range(0, len(a), 8 * BATCH):
            x, y = a[k : k + 8 * BATCH], b[k : k + 8 * BATCH]
            on = wanted(x, y)
            x, y = x[on], y[on]
            value = 100.0 * (2.0 * matched(some, x, y) / (length[x] + length[y]))
            on = value >= threshold
            yield x[on], y[on], value[on]
    for k in range(0, len(left)):
        others = right if not brief[left[k]] else right[~brief[right]]
        a, b = ordered(np.full(len(others), left[k]), others)
        if len(a):
            value = np.array([ratio(texts[x], texts[y], threshold) for x, y in zip(a, b, strict=True)])
            on = value >= threshold
            yield a[on], b[on], value[on]


class Texts:
    """Short texts as rows of character numbers (0 is no character), with what bounds their ratio."""

    def __init__(self, texts: list[str]) -> None:
        self.length = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        known, number = np.unique(points, return_inverse=True)
        self.width, self.kinds = int(self.length.max(initial=0)), len(known) + 1
        kind = np.uint8 if self.kinds <= 256 else np.uint32
        self.codes = np.zeros((len(texts), self.width), kind)
        filled = np.arange(self.width) < self.length[:, None]
        self.codes[filled] = number + 1
        row, place = np.nonzero(filled)
        counts = np.bincount(row * self.kinds + number + 1, minlength=len(texts) * self.kinds).reshape(-1, self.kinds)
        most = counts.max(axis=0, initial=0)
        #: A column for the first, second, ... of each character, so that a product counts the characters in common.
        self.unary = np.concatenate([counts[:, [c]] > np.arange(most[c]) for c in range(self.kinds)], axis=1).astype(np.float32)
        #: The places of each character in each text, as bits.
        self.places = np.zeros(len(texts) * self.kinds, np.uint64)
        np.bitwise_or.at(self.places, row * self.kinds + number + 1, np.uint64(1) << place.astype(np.uint64))


def common(texts: Texts, left: np.ndarray, right: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a row of ``left`` and one of ``right`` with at least ``share`` of the mean length of characters in common: every pair of that ratio, and others."""
    side = lambda rows, first: np.c_[texts.unary[rows], *((-share / 2 * texts.length[rows], np.ones(len(rows))) if first else (np.ones(len(rows)), -share / 2 * texts.length[rows]))].astype(np.float32)
    other = side(right, False).T.copy()
    for k in range(0, len(left), TILE):
        x, y = np.nonzero(side(left[k : k + TILE], True) @ other >= -0.01)
        yield left[k + x], right[y]


def in_order(texts: Texts, a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Whether the longest common subsequence of each pair, which bounds the match, reaches ``share``."""
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), 16 * BATCH):
        x, y = a[k : k + 16 * BATCH], b[k : k + 16 * BATCH]
        at, left = x * texts.kinds, np.full(len(x), np.uint64(0xFFFFFFFFFFFFFFFF))
        for j in range(int(texts.length[y].max(initial=0))):
            hit = left & texts.places.take(at + texts.codes[:, j].take(y))
            left = (left + hit) | (left - hit)
        longest = np.bitwise_count(~left)
        out[k : k + 16 * BATCH] = 2 * longest >= share * (texts.length[x] + texts.length[y]) - 1e-6
    return out


def matched(texts: Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Characters matched of each pair: the longest common run (the first in ``a``, then in ``b``), and so on left and right of it."""
    total = np.zeros(len(a), np.int64)
    pair, i0, i1, j0, j1 = np.arange(len(a)), np.zeros(len(a), np.int64), texts.length[a], np.zeros(len(a), np.int64), texts.length[b]
    while len(pair):
        by = np.lexsort((j1 - j0, i1 - i0))
        parts = []
        for k in range(0, len(by), BATCH):
            p, s0, s1, t0, t1 = (x[by[k : k + BATCH]] for x in (pair, i0, i1, j0, j1))
            size, s, t = _longest(_cut(texts.codes, a[p], s0, s1), _cut(texts.codes, b[p], t0, t1))
            total += np.bincount(p, size, len(a)).astype(np.int64)
            s, t = s0 + s, t0 + t
            parts += [np.c_[p, s0, s, t0, t][(size > 0) & (s > s0) & (t > t0)], np.c_[p, s + size, s1, t + size, t1][(size > 0) & (s + size < s1) & (t + size < t1)]]
        pair, i0, i1, j0, j1 = np.concatenate(parts).T
    return total


def _cut(codes: np.ndarray, rows: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The characters from ``start`` to ``stop`` of each row, a column for each row."""
    width = int((stop - start).max(initial=0))
    at = start + np.arange(width)[:, None]
    return np.where(at < stop, codes[rows, np.minimum(at, codes.shape[1] - 1)], 0)


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and starts of the longest common run of each column."""
    n = a.shape[1]
    run, same, step = np.zeros((len(b) + 1, n), np.int8), np.empty(b.shape, bool), np.empty(b.shape, np.int8)
    best, end = np.zeros(n, np.int8), np.zeros(n, np.int64)
    filled = a != 0
    for i in range(len(a)):
        np.equal(b, a[i], out=same)
        same &= filled[i]
        np.add(run[:-1], 1, out=step)
        np.bitwise_and(step, np.negative(same.view(np.int8)), out=run[1:])
        top = run.max(axis=0)
        better = top > best
        end[better] = i
        best[better] = top[better]
    size = best.astype(np.int64)
    fits = np.ones(b.shape, bool)
    column = np.arange(n)
    for k in range(int(size.max(initial=0))):
        over = size <= k
        fits[k:] &= (b[: len(b) - k] == a[np.maximum(end - k, 0), column]) | over
        fits[:k] &= over
    last = fits.argmax(axis=0)
    return size, end - size + 1, last - size + 1


def ratio(a: str, b: str, threshold: float) -> float:
    """The match ratio, or 0 where the characters in common already keep it under the threshold."""
    match = SequenceMatcher(None, a, b, autojunk=False)
    return 100.0 * match.ratio() if 100.0 * match.quick_ratio() >= threshold else 0.0
