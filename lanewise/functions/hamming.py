"""Numbers of 64 bits that differ in few of them: pairs and links, many numbers in one vector operation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Numbers compared at once, and the size from which a group is compared as a matrix.
_AT_ONCE, _MATRIX = 1 << 20, 33


def _close(a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= threshold


def across(x: np.ndarray, y: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all x[i] and y[j] at most ``threshold`` bits apart."""
    step = max(1, _AT_ONCE // max(1, len(y)))
    for lo in range(0, len(x), step):
        i, j = np.nonzero(_close(x[lo : lo + step, None], y[None, :], threshold))
        yield i + lo, j


def _neighbours(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of close numbers in small groups: all at one distance of places together."""
    behind = np.repeat(starts + sizes, sizes) - 1
    i = np.concatenate([np.empty(0, np.int64), np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)])
    for d in range(1, int(sizes.max(initial=0))):
        keep = i + d <= behind
        i, behind = i[keep], behind[keep]
        hit = i[_close(x[i], x[i + d], threshold)]
        yield hit, hit + d


def within(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of all numbers of one group at most ``threshold`` bits apart."""
    small = sizes < _MATRIX
    yield from _neighbours(x, starts[small], sizes[small], threshold)
    for start, size in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
        group, lo = x[start : start + size], 0
        while lo < size:
            step = max(1, _AT_ONCE // (size - lo))
            i, j = np.nonzero(_close(group[lo : lo + step, None], group[None, lo:], threshold))
            keep = i < j
            yield i[keep] + start + lo, j[keep] + start + lo
            lo += step


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest one that the edges (i, j) reach."""
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, further := label[label]):
            label = further


def linked(x: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) that link all numbers of one group which chains of close ones connect: each to the first of its class.

    A number is compared only with those that no chain has reached yet, so a dense group takes few comparisons.
    """
    rest, first, member = np.arange(len(x)), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(rest) > 1:
        seed, queue, rest = rest[0], [rest[:1]], rest[1:]
        while queue and len(rest):
            near = queue.pop()
            step = max(1, _AT_ONCE // len(rest))
            if len(near) > step:
                queue.append(near[step:])
            hit = _close(x[near[:step], None], x[None, rest], threshold).any(axis=0)
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                queue.append(found)
                first.append(np.full(len(found), seed))
                member.append(found)
    return np.concatenate(first), np.concatenate(member)


def links(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) that connect the same numbers of one group as all its pairs at most ``threshold`` bits apart, one for each number at most."""
    small = sizes < _MATRIX
    found = list(_neighbours(x, starts[small], sizes[small], threshold))
    label = roots(len(x), *map(np.concatenate, zip(*found, strict=True))) if found else np.arange(len(x))
    moved = np.flatnonzero(label != np.arange(len(x)))
    yield label[moved], moved
    for start, size in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
        i, j = linked(x[start : start + size], threshold)
        yield i + start, j + start
