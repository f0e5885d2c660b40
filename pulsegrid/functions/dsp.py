"""Signal processing on NumPy arrays: filter design, zero-phase filtering, spectra, wavelets, tapers.

These run inside grouped Arrow functions, one (session, channel) at a time.
"""

from __future__ import annotations

import numpy as np


def butter_sos(order: int, band, fs: float, kind: str = "bandpass") -> np.ndarray:
    """Second-order sections of a Butterworth filter, by the bilinear transform of its analogue poles."""
    band = np.atleast_1d(np.asarray(band, float))
    warped = 2 * fs * np.tan(np.pi * band / fs)
    k = np.arange(1, order + 1)
    poles = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    zeros = np.zeros(0, complex)
    gain = 1.0
    if kind == "lowpass":
        poles, gain = poles * warped[0], warped[0] ** order
    elif kind == "highpass":
        gain = float(np.real(1 / np.prod(-poles)))
        poles, zeros = warped[0] / poles, np.zeros(order, complex)
    else:
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        if kind == "bandpass":
            low = poles * width / 2
            root = np.sqrt(low**2 - centre**2)
            poles, zeros, gain = np.r_[low + root, low - root], np.zeros(order, complex), width**order
        else:
            gain = float(np.real(1 / np.prod(-poles)))
            low = (width / 2) / poles
            root = np.sqrt(low**2 - centre**2)
            poles, zeros = np.r_[low + root, low - root], np.r_[np.full(order, 1j * centre), np.full(order, -1j * centre)]
    return zpk_to_sos(*bilinear(zeros, poles, gain, fs))


def cheby2_sos(order: int, ripple: float, band, fs: float) -> np.ndarray:
    """Band-pass Chebyshev filter of the second kind with ``ripple`` dB in the stop band."""
    warped = 2 * fs * np.tan(np.pi * np.asarray(band, float) / fs)
    de = 1 / np.sqrt(10 ** (0.1 * ripple) - 1)
    mu = np.arcsinh(1 / de) / order
    m = np.arange(-order + 1, order, 2)
    zeros = -np.conj(1j / np.sin(m[m != 0] * np.pi / (2 * order)))
    p = -np.exp(1j * np.pi * m / (2 * order))
    p = 1 / (np.sinh(mu) * p.real + 1j * np.cosh(mu) * p.imag)
    gain = float(np.real(np.prod(-p) / np.prod(-zeros)))
    width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
    degree = len(p) - len(zeros)
    spread = lambda r: np.r_[r * width / 2 + np.sqrt((r * width / 2) ** 2 - centre**2 + 0j), r * width / 2 - np.sqrt((r * width / 2) ** 2 - centre**2 + 0j)]
    return zpk_to_sos(*bilinear(np.r_[spread(zeros), np.zeros(degree)], spread(p), gain * width**degree, fs))


def bilinear(zeros, poles, gain: float, fs: float):
    f = 2 * fs
    extra = len(poles) - len(zeros)
    k = gain * np.real(np.prod(f - zeros) / np.prod(f - poles))
    return np.r_[(f + zeros) / (f - zeros), -np.ones(extra)], (f + poles) / (f - poles), k


def _pairs(roots: np.ndarray) -> list[np.ndarray]:
    """Conjugate pairs, then real roots by twos."""
    roots = np.asarray(roots, complex)
    up = sorted(roots[roots.imag > 1e-12], key=lambda r: -abs(r))
    real = sorted(roots[np.abs(roots.imag) <= 1e-12].real)
    out = [np.array([r, np.conj(r)]) for r in up]
    while real:
        out.append(np.array([real.pop(0), real.pop() if real else 0.0], complex))
    return out


def zpk_to_sos(zeros, poles, gain: float) -> np.ndarray:
    zs, ps = _pairs(zeros), _pairs(poles)
    while len(zs) < len(ps):
        zs.append(np.zeros(2, complex))
    sos = np.array([np.r_[np.real(np.poly(z)), np.real(np.poly(p))] for z, p in zip(zs, ps, strict=True)])
    sos[0, :3] *= gain
    return sos


def sos_filter(sos: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """Cascade of sections, each a two-pole recursion solved in blocks by its impulse response."""
    y = np.asarray(x, float)
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        z = (0.0, 0.0) if state is None else state[i]
        y = _section(y, b0, b1, b2, a1, a2, z[0], z[1])
    return y


def _section(x, b0, b1, b2, a1, a2, z1, z2, block: int = 256):
    """y[n] = b0 x[n] + s1, in blocks: a block is a product with a lower triangular matrix and the state that enters it."""
    n = len(x)
    m = min(block, max(n, 1))
    h = np.zeros(m)
    s1, s2 = 0.0, 0.0
    free = np.zeros((m, 2))
    for k in range(m):
        xi = 1.0 if k == 0 else 0.0
        y = b0 * xi + s1
        s1, s2 = b1 * xi - a1 * y + s2, b2 * xi - a2 * y
        h[k] = y
    for j in range(2):
        s1, s2 = float(j == 0), float(j == 1)
        for k in range(m):
            y = s1
            s1, s2 = -a1 * y + s2, -a2 * y
            free[k, j] = y
    at = np.arange(m)[:, None] - np.arange(m)[None, :]
    lower = np.where(at >= 0, h[np.maximum(at, 0)], 0.0)
    out = np.empty(n)
    for i in range(0, n, m):
        u = x[i : i + m]
        k = len(u)
        y = lower[:k, :k] @ u + free[:k] @ np.array([z1, z2])
        out[i : i + k] = y
        xa, xb = u[-1], (u[-2] if k > 1 else None)
        if k > 1:
            z2n = b2 * xa - a2 * y[-1]
            z1n = b1 * xa - a1 * y[-1] + (b2 * xb - a2 * y[-2])
        else:
            z2n = b2 * xa - a2 * y[-1]
            z1n = b1 * xa - a1 * y[-1] + z2
        z1, z2 = z1n, z2n
    return out


def steady_state(sos: np.ndarray) -> np.ndarray:
    """State of each section after a long run of ones."""
    out, scale = np.zeros((len(sos), 2)), 1.0
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        y = (b0 + b1 + b2) / (1 + a1 + a2)
        z2 = b2 - a2 * y
        out[i] = scale * (b1 - a1 * y + z2), scale * z2
        scale *= y
    return out


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward, with odd extension at both ends."""
    x = np.asarray(x, float)
    ntaps = 2 * len(sos) + 1 - min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum())
    edge = min(3 * int(ntaps), len(x) - 1)
    if edge < 1:
        return x.copy()
    ext = np.r_[2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2 : -edge - 2 : -1]]
    zi = steady_state(sos)
    y = sos_filter(sos, ext, zi * ext[0])
    y = sos_filter(sos, y[::-1], zi * y[-1])[::-1]
    return y[edge:-edge]


def firwin(taps: int, band, fs: float, kind: str = "bandpass") -> np.ndarray:
    """Windowed-sinc (Hamming) filter, unit gain in the middle of its pass band."""
    band = np.atleast_1d(np.asarray(band, float)) / (fs / 2)
    edges = {"lowpass": [(0, band[0])], "highpass": [(band[0], 1)], "bandpass": [(band[0], band[-1])], "bandstop": [(0, band[0]), (band[-1], 1)]}[kind]
    m = np.arange(taps) - (taps - 1) / 2
    h = sum(r * np.sinc(r * m) - l * np.sinc(l * m) for l, r in edges) * np.hamming(taps)
    l, r = edges[0]
    at = 0.0 if l == 0 else 1.0 if r == 1 else (l + r) / 2
    return h / (h * np.cos(np.pi * m * at)).sum()


def filter_signal(x: np.ndarray, fs: float, kind: str, band, design: str = "fir", cycles: int = 3, order: int = 4, drop_edges: bool = True) -> np.ndarray:
    """FIR in ``same`` mode with NaN ends, or zero-phase Butterworth."""
    band = [f for f in np.atleast_1d(band) if f is not None]
    if design == "iir":
        return zero_phase(butter_sos(order, band, fs, kind), x)
    taps = int(np.ceil(cycles * fs / band[0]))
    taps += 1 - taps % 2
    if taps > len(x):
        raise ValueError("the filter is longer than the signal")
    y = np.convolve(x, firwin(taps, band, fs, kind), "same")
    if drop_edges:
        y[: taps // 2] = y[len(y) - taps // 2 :] = np.nan
    return y


def analytic(x: np.ndarray) -> np.ndarray:
    """Signal with its Hilbert transform as imaginary part."""
    n = len(x)
    f = np.fft.fft(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0 and n:
        h[n // 2] = 1
    return np.fft.ifft(f * h)


def smooth(x: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Gaussian smoothing with reflected ends."""
    r = int(truncate * sigma + 0.5)
    if r < 1:
        return np.asarray(x, float)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, r, mode="symmetric"), k / k.sum(), "valid")


def envelope(x: np.ndarray, fs: float, band, sigma: float, order: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band-passed signal, its smoothed envelope, and its unwrapped phase."""
    y = zero_phase(butter_sos(order, band, fs), x)
    a = analytic(y)
    return y, smooth(np.abs(a), sigma * fs), np.unwrap(np.angle(a))


def instantaneous_frequency(phase: np.ndarray, t: np.ndarray, kernel: int = 13) -> np.ndarray:
    p = np.unwrap(phase)
    half = kernel // 2
    pad = np.pad(p, half, mode="edge")
    med = np.median(np.lib.stride_tricks.sliding_window_view(pad, kernel), axis=1)
    return np.gradient(med, t) / (2 * np.pi)


def yule_walker(x: np.ndarray, order: int = 1, unbiased: bool = True) -> tuple[np.ndarray, float]:
    """Coefficients of an autoregression and the deviation of its noise."""
    x = np.asarray(x, float) - np.mean(x)
    n = len(x)
    r = np.array([(x[: n - k] * x[k:]).sum() / (n - k if unbiased else n) for k in range(order + 1)])
    toeplitz = r[np.abs(np.arange(order)[:, None] - np.arange(order)[None, :])]
    rho = np.linalg.solve(toeplitz, r[1:])
    s2 = r[0] - (r[1:] * rho).sum()
    return rho, float(np.sqrt(s2)) if s2 > 0 else float("nan")


def whiten(x: np.ndarray, order: int = 2) -> np.ndarray:
    """Prediction errors of an autoregression; the first samples are kept as far as they go."""
    rho, _ = yule_walker(x, order)
    return np.convolve(x, np.r_[1, -rho])[: len(x)]


def morlet(x: np.ndarray, fs: float, freqs, bandwidth: float = 1.5, centre: float = 0.5) -> np.ndarray:
    """Complex Morlet transform, a row for each frequency, by FFT convolution with unit-energy wavelets."""
    out = np.empty((len(freqs), len(x)), complex)
    for i, f in enumerate(freqs):
        s = centre * fs / f
        half = int(np.ceil(8 * s / 2))
        t = np.arange(-half, half + 1) / s
        w = np.exp(-(t**2) / bandwidth) * np.exp(2j * np.pi * centre * t) / np.sqrt(np.pi * bandwidth) / np.sqrt(s)
        n = len(x) + len(w) - 1
        y = np.fft.ifft(np.fft.fft(x, n) * np.fft.fft(np.conj(w[::-1]), n))
        out[i] = y[half : half + len(x)]
    return out


def dpss(n: int, bandwidth: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First k Slepian sequences (rows, unit norm) and their concentrations, by the commuting tridiagonal matrix."""
    w = bandwidth / n
    i = np.arange(n)
    diagonal = ((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * w)
    off = i[1:] * (n - i[1:]) / 2
    m = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    _, v = np.linalg.eigh(m)
    v = v[:, ::-1][:, :k].T
    for j, row in enumerate(v):
        sign = row.sum() if j % 2 == 0 else row[np.argmax(np.abs(row) > 1e-8)]
        if sign < 0:
            row *= -1
    d = i[:, None] - i[None, :]
    kernel = 2 * w * np.sinc(2 * w * d)
    return v, np.einsum("ki,ij,kj->k", v, kernel, v)


def frequency_grid(fs: float, nfft: int, band) -> tuple[np.ndarray, np.ndarray]:
    f = np.arange(nfft) * fs / nfft
    keep = (f >= band[0]) & (f <= band[-1])
    return f[keep], keep


def tapers(n: int, bandwidth: float, fs: float = 1.0, least: float = 0.95, count: int | None = None) -> np.ndarray:
    """Tapers of a half bandwidth (Hz) with at least a concentration, columns scaled by sqrt(fs)."""
    nw = bandwidth * n / fs
    v, lam = dpss(n, nw, max(1, int(2 * nw) - 1) if count is None else count)
    v = v[lam > least]
    if not len(v):
        raise ValueError("no taper is concentrated enough")
    return v.T * np.sqrt(fs)


def spectrum_continuous(x: np.ndarray, fs: float, band, tap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and the mean power over tapers."""
    n = len(x)
    nfft = max(2 ** int(np.ceil(np.log2(n))), n)
    f, keep = frequency_grid(fs, nfft, band)
    j = np.fft.fft(x[:, None] * tap, nfft, axis=0) / fs
    return f, (np.abs(j[keep]) ** 2).mean(axis=1)


#: Phases that are held at a time.
_PHASES = 1 << 20


def transform_points(times: np.ndarray, tap: np.ndarray, grid_t: np.ndarray, f: np.ndarray, spectrum_of_tapers: np.ndarray) -> np.ndarray:
    """Tapered Fourier transform of points, less that of their mean rate: frequencies x tapers."""
    inside = (times >= grid_t[0]) & (times <= grid_t[-1])
    x = times[inside]
    rate = len(x) / len(grid_t)
    if not len(x):
        return np.zeros((len(f), tap.shape[1]), complex)
    at = np.stack([np.interp(x, grid_t, tap[:, k]) for k in range(tap.shape[1])], axis=1)
    x = x - grid_t[0]
    step = max(1, _PHASES // len(x))  # frequencies at a time, so that memory does not grow with their product with the points
    out = np.concatenate([np.exp(-2j * np.pi * np.outer(f[i : i + step], x)) @ at for i in range(0, len(f), step)]) if len(f) else np.zeros((0, tap.shape[1]), complex)
    return out - spectrum_of_tapers * rate


def spectrum_points(times: np.ndarray, fs: float, band, nw: float = 2.5, count: int = 4, support=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, mean power, and transforms (frequencies x tapers) of a point process."""
    lo, hi = support if support is not None else (times.min(), times.max())
    n = max(int(np.floor(fs * (hi - lo))) + 1, 8)
    t = lo + np.arange(n) / fs
    tap = slepian(n, nw, count) * np.sqrt(fs)
    nfft = max(2 ** int(np.ceil(np.log2(n))), n)
    f, keep = frequency_grid(fs, nfft, band)
    h = np.fft.fft(tap, nfft, axis=0)[keep]
    j = transform_points(np.asarray(times, float), tap, t, f, h)
    return f, (np.abs(j) ** 2).mean(axis=1), j


def slepian(n: int, nw: float, count: int, dense: int = 512) -> np.ndarray:
    """The first Slepian sequences as columns of unit norm, for any length.

    Above ``dense`` samples those of that many, stretched, are the start of
    Rayleigh quotient iterations with the tridiagonal matrix of the full length.
    """
    if n <= dense:
        return dpss(n, nw, count)[0].T
    start = dpss(dense, nw, count)[0]
    i = np.arange(n)
    diagonal = ((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * nw / n)
    off = i[1:] * (n - i[1:]) / 2.0
    out = []
    for row in start:
        v = np.interp(np.linspace(0, dense - 1, n), np.arange(dense), row)
        v /= np.linalg.norm(v)
        for _ in range(4):
            tv = diagonal * v
            tv[:-1] += off * v[1:]
            tv[1:] += off * v[:-1]
            mu = float(v @ tv)
            if np.linalg.norm(tv - mu * v) < 1e-14 * abs(diagonal).max():
                break
            w = _tridiagonal(off, diagonal - mu, v)
            w /= np.linalg.norm(w)
            v = w if w @ v >= 0 else -w
        out.append(v)
    return np.stack(out, axis=1)


def _tridiagonal(off: np.ndarray, diagonal: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution of a symmetric tridiagonal system, by elimination."""
    d, y, e = diagonal.tolist(), b.tolist(), off.tolist()
    tiny = 1e-14 * float(np.abs(diagonal).max())
    for i in range(1, len(d)):
        p = d[i - 1] if abs(d[i - 1]) > tiny else tiny
        m = e[i - 1] / p
        d[i] -= m * e[i - 1]
        y[i] -= m * y[i - 1]
    x = [0.0] * len(d)
    x[-1] = y[-1] / (d[-1] if abs(d[-1]) > tiny else tiny)
    for i in range(len(d) - 2, -1, -1):
        x[i] = (y[i] - e[i] * x[i + 1]) / (d[i] if abs(d[i]) > tiny else tiny)
    return np.array(x)


def coherence_points(a: np.ndarray, b: np.ndarray, fs: float, band, nw: float = 2.5, count: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, real cross-spectrum and coherence of two point processes."""
    support = min(a.min(), b.min()), max(a.max(), b.max())
    f, pa_, ja = spectrum_points(a, fs, band, nw, count, support)
    _, pb, jb = spectrum_points(b, fs, band, nw, count, support)
    cross = (np.conj(ja) * jb).mean(axis=1)
    return f, cross.real, np.abs(cross) ** 2 / np.maximum(pa_ * pb, 1e-300)


def precession(phase: np.ndarray, x: np.ndarray, bounds=(-3 * np.pi, 3 * np.pi)) -> tuple[float, float, float]:
    """Slope (rad per unit), offset and circular-linear correlation, by the largest resultant over slopes."""
    x = (x - x.min()) / max(np.ptp(x), 1e-12)
    r = lambda s: np.abs(np.exp(1j * (phase[None, :] - np.outer(np.atleast_1d(s), x))).mean(axis=1))
    grid = np.linspace(*bounds, 601)
    at = int(np.argmax(r(grid)))
    lo, hi = grid[max(at - 1, 0)], grid[min(at + 1, 600)]
    g = (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        if r(c)[0] > r(d)[0]:
            hi = d
        else:
            lo = c
    slope = (lo + hi) / 2
    offset = float(np.angle(np.exp(1j * (phase - slope * x)).mean()) % (2 * np.pi))
    theta = np.mod(np.abs(slope) * x, 2 * np.pi)
    ma, mb = np.angle(np.exp(1j * phase).mean()), np.angle(np.exp(1j * theta).mean())
    sa, sb = np.sin(phase - ma), np.sin(theta - mb)
    rho = (sa * sb).sum() / max(np.sqrt((sa**2).sum() * (sb**2).sum()), 1e-12)
    return float(slope), offset, float(np.sign(slope) * abs(rho))


def hollow_prediction(cch: np.ndarray, width: int = 30, hollow: float = 0.6) -> np.ndarray:
    """Correlogram smoothed by a Gaussian with part of its centre taken out, mirrored at the ends."""
    n = 6 * width // 2 * 2 + 1
    i = np.arange(n) - n // 2
    k = np.exp(-(i**2) / (2 * width**2))
    k[n // 2] *= 1 - hollow
    k /= k.sum()
    pad = np.pad(cch, n // 2, mode="reflect") if n // 2 < len(cch) else np.pad(cch, n // 2, mode="wrap")
    return np.convolve(pad, k, "valid")


def symmetric_acf(forward: np.ndarray, cut_peak: bool = True) -> np.ndarray:
    """Both sides of an autocorrelation from its counts at positive lags; the value at zero is that of the first lag, or 0."""
    forward = np.asarray(forward, float)
    mid = 0.0 if cut_peak else (forward[0] if len(forward) else 0.0)
    return np.r_[forward[::-1], mid, forward]


def acf_power(acf: np.ndarray, norm: bool = True) -> np.ndarray:
    """Half of the power spectrum of an autocorrelation, of unit area on request."""
    p = np.abs(np.fft.fft(acf)) ** 2
    p = p[: len(p) // 2]
    area = np.trapezoid(p) if norm and len(p) else 1.0
    return p / area if area else p


def nonspatial_precession(phases: np.ndarray, width: float = 8 * np.pi, step: float = np.pi / 3, limits: tuple[float, float] = (0.65, 1.55), upsample: int = 4, sigma: float = 1.0) -> tuple[float, float]:
    """Frequency of spiking relative to the rhythm, and its modulation, from unwrapped spike phases."""
    phases = np.sort(np.asarray(phases, float))
    n = int(round(width / step))
    counts = np.zeros(n)
    hi = np.searchsorted(phases, phases + n * step)
    for i, j in enumerate(hi):
        counts += np.bincount(np.minimum(((phases[i + 1 : j] - phases[i]) / step).astype(int), n - 1), minlength=n)[:n]
    acf = symmetric_acf(counts)
    acf = acf - acf.mean()
    padded = np.r_[acf, np.zeros(len(acf) * (upsample - 1))]
    power = smooth(acf_power(padded), sigma)
    f = np.arange(len(power)) / len(padded) * (2 * np.pi / step)
    keep = (f >= limits[0]) & (f <= limits[1])
    if not keep.any() or not power[keep].any():
        return float("nan"), float("nan")
    top = int(np.argmax(power[keep]))
    return float(f[keep][top]), float(power[keep][top] / power.mean() if power.mean() else np.nan)
