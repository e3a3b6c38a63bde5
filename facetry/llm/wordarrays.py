"""Words and word shingles of a batch of texts as flat numpy arrays.

Small helpers for Arrow kernels: a batch of texts becomes one array of code points, words become
(start, end, row) triples and 64-bit hashes.  Texts are whole; a batch is cut between texts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_CHARS = 1 << 19  # code points handled at once, unless one text alone is longer


def chunks(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` code points each."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def code_points(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, a line feed after each; first position of each text)."""
    parts = [t or "" for t in texts]
    points = np.frombuffer(("\n".join(parts) + "\n").encode("utf-32-le"), np.uint32)
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    return points, np.cumsum(sizes) - sizes


def is_space(points: np.ndarray) -> np.ndarray:
    """The six ASCII separators U+0020 and U+0009 to U+000D."""
    return (points == 32) | ((points >= 9) & (points <= 13))


def lower_ascii(points: np.ndarray) -> np.ndarray:
    return points + (((points >= 65) & (points <= 90)).astype(np.uint32) << 5)


def word_spans(separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of runs without a separator."""
    edge = np.flatnonzero(np.diff(np.concatenate(([1], separator.astype(np.int8), [1]))))
    return edge[0::2], edge[1::2]


def spread(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (multiply and shift, public domain mixing constants)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def odd_numbers(count: int, seed: int) -> np.ndarray:
    """Odd 64-bit multipliers drawn from a seed."""
    return spread(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def word_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each word."""
    if not len(start):
        return np.empty(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    taken = points[within + np.repeat(start, size)].astype(np.uint64) + np.uint64(1)
    power = odd_numbers(int(size.max()), 7)
    return spread(np.add.reduceat(taken * power[within], first) + size.astype(np.uint64))


def shingle_hashes(words: np.ndarray, row: np.ndarray, n_rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each shingle in text order; a row with fewer words than ``width`` gives them all as one.

    A row without words gives none.
    """
    count = np.bincount(row, minlength=n_rows)
    factor = odd_numbers(width, 11)
    long = max(0, len(words) - width + 1)
    total = np.zeros(long, np.uint64)
    for k in range(width):
        total += words[k:k + long] * factor[k]
    inside = row[:long] == row[width - 1:width - 1 + long]
    value, owner = total[inside], row[:long][inside]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = (np.cumsum(count) - count)[short]
        extra = count[short].astype(np.uint64)
        for k in range(width - 1):
            has = count[short] > k
            extra[has] += words[first[has] + k] * factor[k]
        value, owner = np.concatenate((value, extra)), np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return spread(value), owner
