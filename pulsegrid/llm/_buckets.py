"""Bucket-pointer refinement of the windows of some byte strings.

Every position starts in the bucket of its first q bytes; a bucket's pointer is
where it begins in the sorted order of all positions. A round takes the
positions whose bucket holds others too, sorts each bucket by the pointers of
the positions ``h`` further on, and writes the pointers of the parts over the
old ones. Buckets of depth h become buckets of depth 2 h: a pointer that a
round has written is what the next one sorts by. What is alone in its bucket
is done and keeps its pointer, and only its pointer is read from then on.
"""

from __future__ import annotations

import numpy as np

#: Bytes that the first buckets are made of: they fit a 64-bit number, so these buckets are exact.
Q = 8


def _firsts(sorted_: np.ndarray) -> np.ndarray:
    """For each place of a sorted array, the place of the first equal value."""
    new = np.r_[len(sorted_) > 0, sorted_[1:] != sorted_[:-1]][: len(sorted_)]
    return np.maximum.accumulate(np.where(new, np.arange(len(sorted_)), 0))


def refined(data: np.ndarray, lens: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window fits into its string, and the pointers of their buckets.

    ``data`` holds the strings one after the other. Two windows are equal if and
    only if their pointers are.
    """
    total = len(data)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(total)
    depth = min(Q, window)
    at = np.flatnonzero(left >= depth)
    gram = np.zeros(max(0, total - depth + 1), np.uint64)
    for k in range(depth):
        gram = (gram << np.uint64(8)) | data[k : len(gram) + k]
    pointer = np.full(total, -1, np.int64)
    order = np.argsort(gram[at])
    at = at[order]
    pointer[at] = _firsts(gram[at])
    while depth < window:
        step = min(depth, window - depth)
        # positions of this depth that are not alone
        p = pointer[at]
        many = np.r_[p[1:] == p[:-1], False] | np.r_[False, p[1:] == p[:-1]][: len(p)] if len(p) else np.zeros(0, bool)
        at = at[many]
        at = at[left[at] >= depth + step]
        key = pointer[at] * np.int64(total + 1) + pointer[at + step]
        order = np.argsort(key)
        at, key = at[order], key[order]
        whole = pointer[at]
        pointer[at] = whole + _firsts(key) - _firsts(whole)
        depth += step
    windows = np.flatnonzero(left >= window)
    return windows, pointer[windows]
