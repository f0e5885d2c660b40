"""Sampled signals (session, channel, sample_idx, t, value): filters, spectra, cleaning and detectors.

Dense work runs in grouped functions, one (session, channel) at a time; runs,
merging and gates on what they find are window functions and range joins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import dsp
from . import intervals as iv
from .grid import zscore

K = ("session", "channel")


def _each(signal: DataFrame, keys: Sequence[str], add: Callable[[pd.DataFrame], dict[str, np.ndarray]], columns: Sequence[str], block: float | None = None, margin: float = 0.0) -> DataFrame:
    """New double columns from the rows of a key in order of time.

    With ``block`` (seconds) a key goes in blocks of time, each with ``margin``
    seconds of its neighbours on either side, so that a task holds a block and
    not a recording; what a filter remembers for longer than the margin is lost.
    """
    if block is not None:
        at = lambda by: F.floor((F.col("t") + by) / block)
        own = F.array_distinct(F.array(at(-margin), at(0.0), at(margin)))
        got = _each(signal.withColumn("_block", F.explode(own)), [*keys, "_block"], add, columns)
        return got.where(F.col("_block") == at(0.0)).drop("_block")
    ddl = ", ".join([f"`{n}` {t}" for n, t in signal.dtypes if n not in columns] + [f"`{c}` double" for c in columns])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        return g.assign(**add(g))

    return signal.groupBy(*keys).applyInPandas(run, ddl)


def band_pass(signal: DataFrame, fs: float, band: tuple[float, float], order: int = 3, kernel: int = 13, keys: Sequence[str] = K, block: float | None = None, margin: float | None = None) -> DataFrame:
    """Adds filtered, phase, amplitude, amplitude_filtered and frequency of a band; by blocks of time on request, with margins of 20 of its slowest cycles."""
    sos = dsp.butter_sos(order, band, fs)

    def add(g: pd.DataFrame) -> dict[str, np.ndarray]:
        y = dsp.zero_phase(sos, g["value"].to_numpy(float))
        a = dsp.analytic(y)
        amp = np.abs(a)
        return {"filtered": y, "phase": np.angle(a), "amplitude": amp, "amplitude_filtered": dsp.zero_phase(sos, amp), "frequency": dsp.instantaneous_frequency(np.angle(a), g["t"].to_numpy(float), kernel)}

    return _each(signal, keys, add, ["filtered", "phase", "amplitude", "amplitude_filtered", "frequency"], block, 20 / band[0] if margin is None else margin)


def filter_signal(signal: DataFrame, fs: float, kind: str, band, design: str = "fir", keys: Sequence[str] = K, block: float | None = None, margin: float = 10.0, **options) -> DataFrame:
    """Adds ``filtered``; ends that an FIR filter cannot reach are null. By blocks of time on request: exact for FIR filters shorter than the margin."""
    out = _each(signal, keys, lambda g: {"filtered": dsp.filter_signal(g["value"].to_numpy(float), fs, kind, band, design, **options)}, ["filtered"], block, margin)
    return out.withColumn("filtered", F.nanvl("filtered", F.lit(None).cast("double")))


def whiten(signal: DataFrame, order: int = 2, keys: Sequence[str] = K) -> DataFrame:
    """Adds ``white``: prediction errors of an autoregression, whose lag products are one aggregate."""
    w = Window.partitionBy(*keys).orderBy("t")
    m = signal.groupBy(*keys).agg(F.avg("value").alias("_m"))
    x = signal.join(m, list(keys)).withColumn("_x", F.col("value") - F.col("_m"))
    lags = [F.col("_x"), *[F.lag("_x", k).over(w) for k in range(1, order + 1)]]
    for k, c in enumerate(lags):
        x = x.withColumn(f"_l{k}", c)
    r = x.groupBy(*keys).agg(*[F.avg(F.when(F.col(f"_l{k}").isNotNull(), F.col("_x") * F.col(f"_l{k}"))).alias(f"r{k}") for k in range(order + 1)])

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        rs = g[[f"r{k}" for k in range(order + 1)]].to_numpy(float)[0]
        at = np.abs(np.arange(order)[:, None] - np.arange(order)[None, :])
        a = np.linalg.lstsq(rs[at], rs[1:], rcond=None)[0]
        return g[list(keys)].assign(_a=[a.tolist()])

    kinds = dict(signal.dtypes)
    a = r.groupBy(*keys).applyInPandas(solve, ", ".join([f"{k} {kinds[k]}" for k in keys] + ["_a array<double>"]))
    raw = [F.coalesce(F.lag("value", k).over(w), F.lit(0.0)) * F.col("_a")[k - 1] for k in range(1, order + 1)]
    return signal.join(a, list(keys)).withColumn("white", F.col("value") - sum(raw[1:], raw[0])).drop("_a")


def clean(signal: DataFrame, thresholds: tuple[float, float] = (5.0, 10.0), expand: tuple[float, float] = (0.25, 0.1), keys: Sequence[str] = K) -> tuple[DataFrame, DataFrame]:
    """Signal with artefacts interpolated over, and their intervals: large values and large steps, widened and merged."""
    from .grid import interpolate_nulls

    w = Window.partitionBy(*keys).orderBy("t")
    z = zscore(signal, "value", keys)
    z = z.withColumn("_d", F.lead("z").over(w) - F.col("z"))
    dz = zscore(z, "_d", keys, out="_dz")
    big = iv.runs(dz, F.abs("z") > thresholds[0], "t", keys).select(*keys, (F.col("first") - expand[0]).alias("start"), (F.col("last") + expand[0]).alias("stop"))
    steps = iv.runs(dz, F.abs("_dz") > thresholds[1], "t", keys).select(*keys, (F.col("first") - expand[1]).alias("start"), (F.col("last") + expand[1]).alias("stop"))
    bad = iv.union(big, steps, list(keys))
    inside = iv.restrict(signal.select(*keys, "t"), bad, "t", 1.0, list(keys)).withColumn("_bad", F.lit(True))
    holes = signal.join(inside, [*keys, "t"], "left").withColumn("value", F.when(F.col("_bad").isNull(), F.col("value"))).drop("_bad")
    return interpolate_nulls(holes, "value", "t", keys), bad


def wavelet_around(signal: DataFrame, refs: DataFrame, fs: float, freqs: Sequence[float], before: float, after: float) -> DataFrame:
    """(freq, lag_idx, power): mean magnitude of a Morlet transform around references (ref_id, r); incomplete windows are left out."""
    from .perievent import around

    rows = around(signal.select("t", "value"), refs, before, after)
    n = int(round((after - before) * fs))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        if len(g) < n:
            return pd.DataFrame({"freq": [], "lag_idx": [], "power": []})
        p = np.abs(dsp.morlet(g["value"].to_numpy(float)[:n], fs, freqs))
        return pd.DataFrame({"freq": np.repeat(np.asarray(freqs, float), n), "lag_idx": np.tile(np.arange(n), len(freqs)), "power": p.ravel()})

    each = rows.groupBy("ref_id").applyInPandas(run, "freq double, lag_idx int, power double")
    return each.groupBy("freq", "lag_idx").agg(F.avg("power").alias("power"))


def point_spectrum(points: DataFrame, fs: float, band: tuple[float, float], nw: float = 2.5, tapers: int = 4, unit: str = "unit") -> DataFrame:
    """(unit, freq, power) of point processes by multitapers."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        f, p, _ = dsp.spectrum_points(np.sort(g["t"].to_numpy(float)), fs, band, nw, tapers)
        return pd.DataFrame({unit: g[unit].iloc[0], "freq": f, "power": p})

    return points.select(unit, "t").groupBy(unit).applyInPandas(run, f"{unit} {dict(points.dtypes)[unit]}, freq double, power double")


def signal_spectrum(signal: DataFrame, fs: float, band: tuple[float, float], nw: float = 2.5, tapers: int = 4, keys: Sequence[str] = K) -> DataFrame:
    """(keys, freq, power) of sampled signals by multitapers."""
    kinds = dict(signal.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values("t")["value"].to_numpy(float)
        tap = dsp.slepian(len(x), nw, tapers) * np.sqrt(fs)
        f, p = dsp.spectrum_continuous(x, fs, band, tap)
        return pd.DataFrame({**{k: g[k].iloc[0] for k in keys}, "freq": f, "power": p})

    return signal.select(*keys, "t", "value").groupBy(*keys).applyInPandas(run, ", ".join([f"{k} {kinds[k]}" for k in keys] + ["freq double", "power double"]))


def coherence(a: DataFrame, b: DataFrame, fs: float, band: tuple[float, float], key: str = "session") -> DataFrame:
    """(key, freq, cross, coherence) of two point processes of a key."""

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if len(x) == 0 or len(y) == 0:
            return pd.DataFrame({key: [], "freq": [], "cross": [], "coherence": []})
        f, c, h = dsp.coherence_points(np.sort(x["t"].to_numpy(float)), np.sort(y["t"].to_numpy(float)), fs, band)
        return pd.DataFrame({key: x[key].iloc[0], "freq": f, "cross": c, "coherence": h})

    return a.groupBy(key).cogroup(b.groupBy(key)).applyInPandas(run, f"{key} {dict(a.dtypes)[key]}, freq double, cross double, coherence double")


def phase_precession(rows: DataFrame, unit: str = "unit") -> DataFrame:
    """(unit, slope, offset, rho) of phase against place."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        s, o, r = dsp.precession(g["phase"].to_numpy(float), g["x"].to_numpy(float))
        return pd.DataFrame({unit: [g[unit].iloc[0]], "slope": [s], "offset": [o], "rho": [r]})

    return rows.select(unit, "phase", "x").groupBy(unit).applyInPandas(run, f"{unit} {dict(rows.dtypes)[unit]}, slope double, offset double, rho double")


def current_source_density(signal: DataFrame, spacing: float, sigma: float = 0.3) -> DataFrame:
    """(session, sample_idx, channel, csd): minus the second difference over neighbouring channels."""
    w = Window.partitionBy("session", "sample_idx").orderBy("channel")
    second = F.lag("value").over(w) - 2 * F.col("value") + F.lead("value").over(w)
    return signal.select("session", "sample_idx", "channel", (-sigma * second / spacing**2).alias("csd")).where("csd is not null")


def potentials_of_planes(depths: Sequence[float], diameter: float, sigma: float = 0.3, sigma_top: float | None = None) -> np.ndarray:
    """Potential at each depth (rows) of a disc of current of unit density at each depth, as thick as the contacts are apart (Pettersen et al. 2006).

    Lengths in millimetres and conductivities in siemens a metre; with another
    conductivity above the first contact each disc has its image there.
    """
    z = np.asarray(depths, float)
    h, r2 = abs(z[1] - z[0]), (diameter / 2) ** 2
    gap = lambda d: np.sqrt(d**2 + r2) - np.abs(d)
    top = sigma if sigma_top is None else sigma_top
    return h / (2 * sigma) * (gap(z[:, None] - z[None]) + (sigma - top) / (sigma + top) * gap(z[:, None] + z[None]))


def inverse_current_source_density(signal: DataFrame, depths: dict[int, float], diameter: float = 0.5, sigma: float = 0.3, sigma_top: float | None = None, keys: Sequence[str] = ("session",)) -> DataFrame:
    """(keys, sample_idx, channel, csd): current sources that give the potentials of all channels, by the inverse of the forward matrix.

    ``depths`` names the channels and their depth. The matrix is inverted once
    and applied to blocks of samples; samples that lack a channel are left out,
    repeated ones count by their mean.
    """
    order = sorted(depths, key=lambda c: (depths[c], c))
    inverse = np.linalg.inv(potentials_of_planes([depths[c] for c in order], diameter, sigma, sigma_top))
    at = [F.avg(F.when(F.col("channel") == c, F.col("value").cast("double"))) for c in order]
    x = signal.where(F.col("channel").isin(order)).groupBy(*keys, "sample_idx").agg(F.array(*at).alias("csd")).where(F.forall("csd", lambda v: v.isNotNull()))

    def apply(batches):
        for b in batches:
            v = b.column(b.num_columns - 1)
            flat = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(order)) @ inverse.T
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(np.arange(0, flat.size + 1, len(order), dtype=np.int32), pa.array(flat.ravel()))], b.schema.names)

    y = x.mapInArrow(apply, x.schema)
    place = F.element_at(F.array(*map(F.lit, order)), F.col("_i") + 1)
    return y.select(*keys, "sample_idx", F.posexplode("csd").alias("_i", "csd")).select(*keys, "sample_idx", place.alias("channel"), "csd")


# detectors


def ripples(signal: DataFrame, fs: float, band: tuple[float, float] = (80.0, 250.0), low: float = 1.0, high: float = 3.0, merge_gap: float = 0.02, shortest: float = 0.02, longest: float = 0.3, apart: float = 0.0, sigma: float = 0.0125, keys: Sequence[str] = K, epochs: DataFrame | None = None, block: float | None = None, margin: float = 2.0) -> DataFrame:
    """(keys, start, stop, peak, duration, amplitude, frequency, peak_normed_power) of bursts in a band; filtered by blocks of time on request.

    A grouped function gives the envelope; its standard score, the runs above
    ``low``, their merging, and the gates on length and peak are windows.
    """

    def add(g: pd.DataFrame) -> dict[str, np.ndarray]:
        y, e, p = dsp.envelope(g["value"].to_numpy(float), fs, band, sigma)
        return {"envelope": e, "phase": p, "filtered": y}

    x = zscore(_each(signal, keys, add, ["envelope", "phase", "filtered"], block, margin), "envelope", keys)
    r = iv.runs(x, F.col("z") > low, "t", keys).select(*keys, F.col("first").alias("start"), F.col("last").alias("stop"))
    m = iv.merge(r, list(keys), merge_gap)
    m = m.where((F.col("stop") - F.col("start")).between(shortest, longest))
    if epochs is not None:
        e = epochs.select(F.col("start").alias("_s"), F.col("stop").alias("_e"))
        m = iv.range_join(m.withColumn("t", F.col("start")), e, "t", "_s", "_e", 60.0).where(F.col("stop") <= F.col("_e")).select(*keys, "start", "stop").dropDuplicates()
    w = Window.partitionBy(*keys).orderBy("t")
    x = x.withColumn("_f", (F.col("phase") - F.lag("phase").over(w)) * fs / (2 * np.pi))
    e = m.withColumnsRenamed({"start": "_lo", "stop": "_hi"})
    got = iv.range_join(x.select(*keys, "t", "z", "envelope", "_f"), e, "t", "_lo", "_hi", 1.0, list(keys))
    got = got.groupBy(*keys, "_lo", "_hi").agg(F.max_by("t", "z").alias("peak"), F.max("z").alias("peak_normed_power"), F.max("envelope").alias("amplitude"), F.percentile("_f", F.lit(0.5)).alias("frequency"))
    got = got.where(F.col("peak_normed_power") > high).withColumnsRenamed({"_lo": "start", "_hi": "stop"}).withColumn("duration", F.col("stop") - F.col("start"))
    return suppress(got, apart, keys) if apart > 0 else got


def suppress(events: DataFrame, apart: float, keys: Sequence[str] = K) -> DataFrame:
    """Events in order of power, each kept if no kept one is within ``apart`` of its peak; a key at a time."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        kept: list[float] = []
        rows = []
        for i, p in g.sort_values("peak_normed_power", ascending=False)["peak"].items():
            if all(abs(p - k) >= apart for k in kept):
                kept.append(p)
                rows.append(i)
        return g.loc[rows].sort_values("start")

    return events.groupBy(*keys).applyInPandas(run, events.schema)


def up_down_states(points: DataFrame, epochs: DataFrame, step: float = 0.01, sigma: float = 2.0, percentile: float = 20.0, shortest: float = 0.03, longest: float = 0.5, merge_bins: int = 2, threshold: float | None = None) -> DataFrame:
    """(epoch_id, state, start, stop) from the population rate in each epoch: DOWN are low runs of some length, UP the rest."""
    from .grid import smooth

    w = epochs.select("epoch_id", F.col("start").alias("_lo"), F.col("stop").alias("_hi"))
    n = F.floor((F.col("_hi") - F.col("_lo")) / step).cast("int")
    got = iv.range_join(points.select("t"), w, "t", "_lo", "_hi", 600.0).groupBy("epoch_id", F.floor((F.col("t") - F.col("_lo")) / step).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = w.withColumn("bin", F.explode(F.sequence(F.lit(0), n - 1)))
    rate = every.join(got, ["epoch_id", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))
    rate = smooth(rate, "n", "bin", sigma, ["epoch_id"], out="rate").withColumn("t", F.col("_lo") + F.col("bin") * step)
    cut = rate.groupBy("epoch_id").agg((F.percentile("rate", F.lit(percentile / 100)) if threshold is None else F.lit(threshold)).alias("_cut"))
    low = iv.runs(rate.join(cut, "epoch_id"), F.col("rate") <= F.col("_cut"), "t", ["epoch_id"])
    down = iv.merge(low.select("epoch_id", F.col("first").alias("start"), (F.col("last") + step).alias("stop")), ["epoch_id"], merge_bins * step)
    down = down.where((F.col("stop") - F.col("start")).between(shortest, longest))
    up = iv.complement(down, epochs.select("epoch_id", "start", "stop"), ["epoch_id"])
    return down.withColumn("state", F.lit("DOWN")).unionByName(up.withColumn("state", F.lit("UP")))


def dip(x: np.ndarray, n_boot: int = 100, seed: int = 0, null: int = 2000) -> tuple[float, float]:
    """Distance of the distribution from the nearest unimodal one on a grid of modes, and p against normal samples.

    All values count. The distance of n normal values falls with the root of n,
    so those of ``null`` values are scaled to n.
    """

    def distance(v: np.ndarray) -> float:
        v = np.sort(v)
        n = len(v)
        f = np.arange(1, n + 1) / n
        best = np.inf
        modes = np.unique(np.linspace(1, n - 2, min(50, max(n - 2, 1))).astype(int))
        left = _minorants(v, f, modes)
        right = _minorants(-v[::-1], -f[::-1], n - 1 - modes)  # the concave majorant of the rest, seen from its end
        for m in modes.tolist():
            a, b = left[m], n - 1 - right[n - 1 - m][::-1]
            best = min(best, max(np.abs(np.interp(v[i], v[k], f[k]) - f[i]).max() for i, k in ((slice(0, m + 1), a), (slice(m, n), b))))
        return float(best / 2)

    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    d = distance(x)
    rng = np.random.default_rng(seed)
    m = min(len(x), null)
    most = np.array([distance(rng.standard_normal(m)) for _ in range(n_boot)]) * np.sqrt(m / max(len(x), 1))
    return d, float((np.sum(most >= d) + 1) / (n_boot + 1))


def _minorants(x: np.ndarray, y: np.ndarray, ends: np.ndarray) -> dict[int, np.ndarray]:
    """The corners of the greatest convex minorant of the points up to each of ``ends``, from one pass over all."""
    keep: list[int] = []
    found, wanted = {}, set(ends.tolist())
    xs, ys = x.tolist(), y.tolist()
    for i in range(int(max(ends, default=-1)) + 1):
        while len(keep) > 1:
            a, b = keep[-2], keep[-1]
            if (xs[b] - xs[a]) * (ys[i] - ys[a]) - (ys[b] - ys[a]) * (xs[i] - xs[a]) > 0:
                break
            keep.pop()
        keep.append(i)
        if i in wanted:
            found[i] = np.array(keep)
    return found


def bimodal_threshold(x: np.ndarray, start_bins: int = 10, most_bins: int = 25, limit: float = np.inf, n_boot: int = 100, force: bool = False) -> float:
    """Trough between the two highest peaks of the histogram with just enough bins; NaN for one mode."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    if not force and dip(x, n_boot)[1] > 0.05:
        return float("nan")
    for bins in range(start_bins, most_bins + 1):
        h, e = np.histogram(x, bins)
        c = (e[:-1] + e[1:]) / 2
        p = [i for i in range(len(h)) if (i == 0 or h[i] > h[i - 1]) and (i == len(h) - 1 or h[i] >= h[i + 1])]
        if len(p) >= 2:
            a, b = sorted(sorted(p, key=lambda i: -h[i])[:2])
            if b - a > 1:
                return float(min(c[a + int(np.argmin(h[a : b + 1]))], limit))
    return float("nan")


def bimodal(rows: DataFrame, value: str, keys: Sequence[str], **options) -> DataFrame:
    """(keys, dip, p, threshold) of the values of each key; the threshold is null for one mode."""
    kinds = dict(rows.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = g[value].to_numpy(float)
        d, p = dip(x, options.get("n_boot", 100))
        cut = bimodal_threshold(x, force=p <= 0.05, **options) if p <= 0.05 else float("nan")
        return pd.DataFrame({**{k: [g[k].iloc[0]] for k in keys}, "dip": [d], "p": [p], "threshold": [cut]})

    got = rows.select(*keys, value).groupBy(*keys).applyInPandas(run, ", ".join([f"{k} {kinds[k]}" for k in keys] + ["dip double, p double, threshold double"]))
    return got.withColumn("threshold", F.nanvl("threshold", F.lit(None).cast("double")))


def dentate_spikes(signal: DataFrame, fs: float, hilus: int, molecular: int, z_hilus: float = 4.0, z_molecular: float = 2.0, band: tuple[float, float] = (5.0, 100.0)) -> DataFrame:
    """(session, start, stop, peak, amplitude): runs of a high hilus signal that meet a low molecular one."""

    def add(g: pd.DataFrame) -> dict[str, np.ndarray]:
        return {"filtered": dsp.zero_phase(dsp.cheby2_sos(4, 40, band, fs), g["value"].to_numpy(float))}

    x = zscore(_each(signal.where(F.col("channel").isin(hilus, molecular)), K, add, ["filtered"]), "filtered", K)
    hi = iv.runs(x.where(F.col("channel") == hilus), F.col("z") > z_hilus, "t", ["session"]).select("session", F.col("first").alias("start"), F.col("last").alias("stop"))
    lo = iv.runs(x.where(F.col("channel") == molecular), F.col("z") < -z_molecular, "t", ["session"])
    lo = lo.select("session", F.col("first").alias("start2"), F.col("last").alias("stop2"))
    both = iv.overlap_join(hi, lo, 1.0, ["session"], touching=True).select("session", "start", "stop").dropDuplicates()
    e = both.withColumnsRenamed({"start": "_lo", "stop": "_hi"})
    got = iv.range_join(x.where(F.col("channel") == hilus).select("session", "t", "filtered"), e, "t", "_lo", "_hi", 1.0, ["session"])
    return got.groupBy("session", "_lo", "_hi").agg(F.max_by("t", "filtered").alias("peak"), F.max("filtered").alias("amplitude")).withColumnsRenamed({"_lo": "start", "_hi": "stop"})


def dentate_spikes_by_difference(signal: DataFrame, fs: float, hilus: int, molecular: int, high: float = 5.0, low: float = 0.75, shortest: float = 0.005, longest: float = 0.05, busy: DataFrame | None = None, band: tuple[float, float] = (5.0, 100.0)) -> DataFrame:
    """(session, start, stop, peak, amplitude): runs of the channels' difference above ``low`` deviations that pass ``high`` ones, without those that meet a ``busy`` interval (session, start, stop)."""

    def add(g: pd.DataFrame) -> dict[str, np.ndarray]:
        return {"filtered": dsp.zero_phase(dsp.cheby2_sos(4, 40, band, fs), g["value"].to_numpy(float))}

    of = lambda c: F.max(F.when(F.col("channel") == c, F.col("filtered")))
    x = _each(signal.where(F.col("channel").isin(hilus, molecular)), K, add, ["filtered"])
    x = x.groupBy("session", "t").agg((of(hilus) - of(molecular)).alias("d"))
    x = zscore(x, "d", ["session"])
    r = iv.runs(x, F.col("z") > low, "t", ["session"]).select("session", F.col("first").alias("_lo"), F.col("last").alias("_hi"))
    got = iv.range_join(x, r, "t", "_lo", "_hi", 1.0, ["session"]).groupBy("session", "_lo", "_hi").agg(F.max("z").alias("_top"), F.max_by("t", "d").alias("peak"), F.max("d").alias("amplitude"))
    stop = F.col("_hi") + 1 / fs
    got = got.where((F.col("_top") > high) & (stop - F.col("_lo")).between(shortest, longest)).select("session", F.col("_lo").alias("start"), stop.alias("stop"), "peak", "amplitude")
    if busy is not None:
        b = busy.select("session", F.col("start").alias("start2"), F.col("stop").alias("stop2"))
        hit = iv.overlap_join(got.select("session", "start", "stop"), b, 1.0, ["session"]).distinct()
        got = got.join(hit, ["session", "start", "stop"], "left_anti")
    return got


def laps(position: DataFrame, threshold: float = 15.0, edge: float = 0.15, keys: Sequence[str] = ("session",)) -> DataFrame:
    """(keys, start, stop, direction): passes between the two ends of a linear track, a session at a time.

    A pass ends at its extreme once the animal has gone back by ``threshold``
    percent of the range.
    """
    kinds = dict(position.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna(subset=["lin"]).sort_values("t")
        t, x = g["t"].to_numpy(float), g["lin"].to_numpy(float)
        out = []
        if len(x) > 1 and np.ptp(x) > 0:
            x = (x - x.min()) / np.ptp(x)
            turn, at, direction = [0], 0, 0
            for i in range(1, len(x)):
                if direction >= 0 and x[i] > x[at] or direction <= 0 and x[i] < x[at]:
                    direction = direction or (1 if x[i] > x[at] else -1)
                    at = i
                elif abs(x[i] - x[at]) > threshold / 100:
                    turn.append(at)
                    direction, at = -direction, i
            turn.append(at)
            for a, b in zip(turn, turn[1:]):
                if min(x[a], x[b]) <= edge and max(x[a], x[b]) >= 1 - edge:
                    out.append((t[a], t[b], "outbound" if x[b] > x[a] else "inbound"))
        frame = pd.DataFrame(out, columns=["start", "stop", "direction"])
        for k in reversed(keys):
            frame.insert(0, k, g[k].iloc[0] if len(g) else None)
        return frame

    return position.groupBy(*keys).applyInPandas(run, ", ".join([f"{k} {kinds[k]}" for k in keys] + ["start double", "stop double", "direction string"]))


#: The spread of emissions by the deviation of coordinates, and the smoothness of steps by the length of the track, each below a limit.
SPREADS = ((1.0, 3.0), (3.0, 5.0), (8.0, 8.0), (math.inf, 12.0))
STAYS = ((10.0, 0.5), (30.0, 0.8), (80.0, 1.2), (math.inf, 1.5))


def track_scale(segments: Sequence[tuple[int, float, float, float, float]], spread_of: float) -> dict:
    """Parameters of :func:`track_states` for a track and the mean deviation of its coordinates: looser for what is tracked loosely, smoother on long tracks."""
    length = sum(float(np.hypot(x1 - x0, y1 - y0)) for _, x0, y0, x1, y1 in segments)
    below = lambda table, x: next(v for limit, v in table if x < limit)
    return {"spread": below(SPREADS, spread_of), "stay": below(STAYS, length)}


def track_distances(segments: Sequence[tuple[int, float, float, float, float]], states: Sequence[tuple[int, float]]) -> np.ndarray:
    """Distances between places (segment's position in the list, distance from its start) along the track, by its shortest ways; segments meet where their ends do."""
    ends, of = {}, []
    for _, x0, y0, x1, y1 in segments:
        of.append(tuple(ends.setdefault((round(x, 6), round(y, 6)), len(ends)) for x, y in ((x0, y0), (x1, y1))))
    length = [float(np.hypot(x1 - x0, y1 - y0)) for _, x0, y0, x1, y1 in segments]
    d = np.full((len(ends), len(ends)), np.inf)
    np.fill_diagonal(d, 0.0)
    for (a, b), n in zip(of, length, strict=True):
        d[a, b] = d[b, a] = min(d[a, b], n)
    for k in range(len(ends)):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1, :])
    seg, at = np.array([s for s, _ in states]), np.array([p for _, p in states])
    tail = np.array(length)[seg] - at
    node = np.array(of)[seg]
    ways = [x[:, None] + d[np.ix_(node[:, i], node[:, j])] + y[None, :] for i, x in enumerate((at, tail)) for j, y in enumerate((at, tail))]
    way = np.minimum.reduce(ways)
    same = seg[:, None] == seg[None, :]
    return np.where(same, np.minimum(way, np.abs(at[:, None] - at[None, :])), way)


def track_states(position: DataFrame, segments: Sequence[tuple[int, float, float, float, float]], per_segment: int = 20, spread: float = 5.0, stay: float = 2.0, keys: Sequence[str] = ("session",), smooth: int = 0) -> DataFrame:
    """Adds segment and lin by the most likely path over bins of the segments (Viterbi), a session at a time.

    Steps cost by distance along the track, so a path goes from one segment to
    another where their ends meet. Samples without coordinates take the path's
    prediction. ``smooth`` samples on either side vote for each state.
    """
    states, places, before = [], [], 0.0
    for nth, (seg, x0, y0, x1, y1) in enumerate(segments):
        length = float(np.hypot(x1 - x0, y1 - y0))
        for k in range(per_segment):
            s = (k + 0.5) / per_segment
            states.append((seg, before + s * length, x0 + s * (x1 - x0), y0 + s * (y1 - y0)))
            places.append((nth, s * length))
        before += length
    place = np.array([s[2:] for s in states])
    seg_of, lin = np.array([s[0] for s in states]), np.array([s[1] for s in states])
    step = np.exp(-track_distances(segments, places) / stay)
    log_t = np.log(step / step.sum(axis=1, keepdims=True) + 1e-12)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        xy = g[["x", "y"]].to_numpy(float)
        e = -((xy[:, None, :] - place[None, :, :]) ** 2).sum(axis=2) / (2 * spread**2)
        e[np.isnan(e)] = 0.0
        score, back = e[0], np.zeros((len(xy), len(place)), np.int32)
        for i in range(1, len(xy)):
            v = score[:, None] + log_t
            back[i] = v.argmax(axis=0)
            score = v[back[i], np.arange(len(place))] + e[i]
        path = np.empty(len(xy), int)
        path[-1] = int(score.argmax())
        for i in range(len(xy) - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        if smooth:  # the most frequent state around, the smallest of equals
            around = np.lib.stride_tricks.sliding_window_view(np.pad(path, smooth, mode="edge"), 2 * smooth + 1)
            path = np.array([np.bincount(v).argmax() for v in around])
        return g.assign(segment=seg_of[path].astype("int32"), lin=lin[path])

    ddl = ", ".join([f"`{n}` {t}" for n, t in position.dtypes] + ["segment int", "lin double"])
    return position.groupBy(*keys).applyInPandas(run, ddl)
