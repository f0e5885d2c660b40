"""Small image routines on NumPy arrays."""

from __future__ import annotations

import numpy as np


def label(mask: np.ndarray) -> np.ndarray:
    """Numbers of 4-connected regions of a mask from 1, in scan order; 0 outside. Any number of axes."""
    out = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        low = out.copy()
        for axis in range(mask.ndim):
            a = np.moveaxis(low, axis, 0)
            m = np.moveaxis(mask, axis, 0)
            for step in (range(1, len(a)), range(len(a) - 2, -1, -1)):
                for i in step:
                    j = i - 1 if step.step == 1 else i + 1
                    both = m[i] & m[j]
                    a[i] = np.where(both, np.minimum(a[i], a[j]), a[i])
        if (low == out).all():
            break
        out = low
    ids, inverse = np.unique(out, return_inverse=True)
    return (inverse.reshape(mask.shape) + (0 if ids[0] == 0 else 1)).astype(np.int64)


def gaussian_filter(image: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Separable Gaussian with reflected edges."""
    r = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = np.asarray(image, float)
    for axis in range(out.ndim):
        pad = [(r, r) if a == axis else (0, 0) for a in range(out.ndim)]
        x = np.moveaxis(np.pad(out, pad, mode="symmetric"), axis, -1)
        y = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), -1, x)
        out = np.moveaxis(y, -1, axis)
    return out


def laplace(image: np.ndarray) -> np.ndarray:
    x = np.pad(np.asarray(image, float), 1, mode="symmetric")
    mid = x[1:-1, 1:-1]
    return x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * mid


def reconstruct(seed: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Greyscale reconstruction of ``seed`` by dilation under ``mask``."""
    now = np.minimum(seed, mask)
    while True:
        x = np.pad(now, 1, constant_values=-np.inf)
        up = np.max([x[i : i + now.shape[0], j : j + now.shape[1]] for i in range(3) for j in range(3)], axis=0)
        new = np.minimum(up, mask)
        if (new == now).all():
            return new
        now = new


def place_fields(rate: np.ndarray, min_rate: float = 1.0, thresh: float = 0.2, min_size: int = 100, max_size: int = 200, sigma: float | None = None) -> np.ndarray:
    """Fields around descending peaks: the region above ``thresh`` of the peak, and ``min_rate``, that holds it, if its size is right.

    Works in the box of the region only, so each peak costs what its field
    covers. Numbers are by descending peak.
    """
    image = np.nan_to_num(np.asarray(rate, float))
    if sigma:
        image = gaussian_filter(image, sigma)
    left = image.copy()
    out = np.zeros(image.shape, np.int64)
    n = 0
    while True:
        at = np.unravel_index(np.argmax(left), left.shape)
        top = left[at]
        if top < min_rate or top <= 0:
            return out
        mask = (left > max(thresh * top, min_rate)) & (out == 0)
        region = _flood(mask, at)
        size = int(region.sum())
        if min_size <= size <= max_size:
            n += 1
            out[region] = n
        left[region] = 0
        left[at] = 0


def _flood(mask: np.ndarray, at: tuple[int, ...]) -> np.ndarray:
    region = np.zeros(mask.shape, bool)
    region[at] = True
    edge = region.copy()
    while edge.any():
        x = np.pad(edge, 1)
        grown = x[:-2, 1:-1] | x[2:, 1:-1] | x[1:-1, :-2] | x[1:-1, 2:] if mask.ndim == 2 else x[:-2] | x[2:]
        edge = grown & mask & ~region
        region |= edge
    return region & (mask | region)


def place_fields_1d(rate: np.ndarray, threshold: float = 0.1, min_size: int = 5, max_size: int | None = None, min_peak: float = 1.0, sigma: float | None = None, min_ratio: float = 2.0) -> tuple[np.ndarray, list[dict]]:
    """Labels and (size share, peak, mean) of fields taken out one by one from the highest peak down."""
    z = np.nan_to_num(np.asarray(rate, float)).copy()
    if sigma:
        z = gaussian_filter(z, sigma)
    whole, labels, stats = z.copy(), np.zeros(len(z), np.int64), []
    max_size = len(z) if max_size is None else max_size
    while len(z) and z.max() >= min_peak:
        peak = int(np.argmax(z))
        a = b = peak
        while a > 0 and z[a - 1] > threshold * z[peak]:
            a -= 1
        while b < len(z) - 1 and z[b + 1] > threshold * z[peak]:
            b += 1
        field = slice(a, b + 1)
        size, low = b - a + 1, whole[field].min()
        if min_size <= size <= max_size and (low <= 0 or whole[peak] / low >= min_ratio):
            labels[field] = len(stats) + 1
            stats.append({"size": size / len(z), "peak": float(whole[peak]), "mean": float(whole[field].mean())})
        z[field] = 0
    return labels, stats
