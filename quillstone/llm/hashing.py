"""Hashes of words and of runs of words, for whole batches of texts at once.

Words are the maximal runs of letters and digits of the lower-cased text. A word's hash is a polynomial over its code points, taken
from running sums, so that one pass over the characters of a batch gives all words. Texts of ``CHUNK`` characters or more are
taken in parts that end between words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

CHUNK = 1 << 20


@lru_cache(1)
def letters() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    for c in range(0x110000):
        if chr(c).isalnum():
            table[c] = True
    return table


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(CHUNK, base, dtype=np.uint64))
        down = np.cumprod(np.full(CHUNK, inverse, dtype=np.uint64))
    return np.concatenate([[np.uint64(1)], up]), np.concatenate([[np.uint64(1)], down])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a lower-cased text of less than CHUNK characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.concatenate([[False], letters()[codes], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = powers()
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)])])
        return mix((total[ends] - total[starts]) * down[starts]), starts


def shingle_hashes(texts: list[str], run: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``run`` words, and the text each is of."""
    hashes, owners = [], []
    group: list[str] = []
    size, first = 0, 0

    def flush(upto: int) -> None:
        nonlocal group, size, first
        if group:
            # One pass over many texts; a separator keeps words apart.
            lengths = np.array([len(t) + 1 for t in group])
            words, starts = word_hashes("\n".join(group))
            hashes.append(words), owners.append(first + np.searchsorted(np.cumsum(lengths), starts, side="right"))
        group, size, first = [], 0, upto

    for i, text in enumerate(t.lower() for t in texts):
        if size + len(text) + 1 >= CHUNK:
            flush(i)
        if len(text) + 1 >= CHUNK:
            at = 0
            while at < len(text):  # parts of a very long text, ending between words
                end = min(len(text), at + CHUNK - 1)
                while end < len(text) and end > at + 1 and text[end - 1].isalnum():
                    end -= 1
                words, _ = word_hashes(text[at:end])
                hashes.append(words), owners.append(np.full(len(words), i))
                at = end
            first = i + 1
            continue
        group.append(text)
        size += len(text) + 1
    flush(len(texts))
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    words, owner = np.concatenate(hashes), np.concatenate(owners)
    n = len(words) - run + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        runs = np.zeros(n, dtype=np.uint64)
        for k in range(run):
            runs = runs * np.uint64(0x9E3779B97F4A7C15) + words[k : n + k]
    whole = owner[:n] == owner[run - 1 :]
    return mix(runs[whole]), owner[:n][whole]
