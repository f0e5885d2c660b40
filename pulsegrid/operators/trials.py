"""Trials of mazes and open fields from positions and epochs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import intervals as iv, sequences as sq, signals as sg

K = Sequence[str]


def linear_maze(position: DataFrame, keys: K = ("session",)) -> DataFrame:
    """Outbound and inbound laps of linear tracks."""
    return sg.laps(position, keys=keys)


def t_maze(position: DataFrame, keys: K = ("session",), width: float = 60.0) -> DataFrame:
    """Outbound laps with the side (``state``) that most of their samples name."""
    lap = sg.laps(position, keys=keys).where("direction = 'outbound'")
    w = lap.withColumnsRenamed({"start": "_lo", "stop": "_hi"})
    got = iv.range_join(position.where("state is not null").select(*keys, "t", "state"), w, "t", "_lo", "_hi", width, list(keys))
    n = got.groupBy(*keys, "_lo", "_hi", "state").agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*keys, "_lo", "_hi").agg(F.max_by("state", F.struct("_n", "state")).alias("side")).withColumnsRenamed({"_lo": "start", "_hi": "stop"})


def w_maze(position: DataFrame, wells: Sequence[tuple[int, float, float]], names: dict[int, str], radius: float = 20.0, least: float = 50.0, keys: K = ("session",)) -> DataFrame:
    """Paths between wells with a ``trajectory`` such as Center_Left."""
    s = sq.segment_path(position, wells, radius, keys=keys).where((F.col("distance") > least) & F.col("from_well").isNotNull() & F.col("to_well").isNotNull() & (F.col("from_well") != F.col("to_well")))
    name = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    return s.withColumn("trajectory", F.concat_ws("_", name[F.col("from_well")], name[F.col("to_well")]))


def cheeseboard(position: DataFrame, home: tuple[float, float], least: float = 15.0, longest: float = 600.0, shortest: float = 5.0, kernel: int = 2, z: float = 6.0, keys: K = ("session",)) -> DataFrame:
    """(keys, start, stop) of stays away from home: median-filtered distance above ``least``, of a length, reaching beyond ``z`` deviations of the rest at home."""
    w = Window.partitionBy(*keys).orderBy("t")
    d = F.hypot(F.col("x") - home[0], F.col("y") - home[1])
    x = position.withColumn("_d0", d).withColumn("_d", F.percentile("_d0", F.lit(0.5)).over(w.rowsBetween(-kernel, kernel)))
    rest = x.where(F.col("_d") <= least).groupBy(*keys).agg(F.avg("_d").alias("_m"), F.stddev_pop("_d").alias("_s"))
    r = iv.runs(x, F.col("_d") > least, "t", keys).select(*keys, F.col("first").alias("_lo"), F.col("last").alias("_hi")).where((F.col("_hi") - F.col("_lo")).between(shortest, longest))
    got = iv.range_join(x.select(*keys, "t", "_d"), r, "t", "_lo", "_hi", longest, list(keys)).groupBy(*keys, "_lo", "_hi").agg(F.max("_d").alias("_far")).join(rest, list(keys), "left")
    far = F.coalesce(F.try_divide(F.col("_far") - F.col("_m"), F.col("_s")) > z, F.lit(True))
    return got.where(far).select(*keys, F.col("_lo").alias("start"), F.col("_hi").alias("stop"))


def open_field(position: DataFrame, bin_size: float = 3.0, step: float = 60.0, share: float = 0.5, keys: K = ("session",), method: str = "correlation", correlation: float = 0.6, n_bins: int | None = None, epochs: DataFrame | None = None) -> DataFrame:
    """(keys, start, stop): spans of time in which the animal has been to enough of the places of the whole key.

    A key's time, from ``epochs`` (keys, start, stop; by default from its first
    sample to its last), is cut into equal stretches of about ``step`` seconds,
    or into ``n_bins`` of whole seconds. A span grows by stretches until its
    map of visited places correlates with that of the whole key by more than
    ``correlation`` ("correlation"), or until it holds more than ``share`` of
    the places ("proportion"); the next one starts after it.

    Samples are reduced to the places of each stretch where they stand; a key
    is brought together as those, never as its samples.
    """
    if method not in ("correlation", "proportion"):
        raise ValueError(method)
    kinds = dict(position.dtypes)
    x = position.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select(*keys, "t", "x", "y")
    if epochs is None:
        span = x.groupBy(*keys).agg(F.min("t").alias("_from"), F.max("t").alias("_to"))
    else:
        span = epochs.select(*keys, F.col("start").alias("_from"), F.col("stop").alias("_to"))
    length = F.col("_to") - F.col("_from")
    if n_bins is None:
        n = F.ceil(length / step) - 1
        width = F.try_divide(length, n)
    else:
        width = F.floor(length / n_bins)
        n = F.ceil(F.try_divide(length, width)) - 1
    span = span.withColumns({"_n": n, "_width": width})
    x = x.join(span, list(keys)).where(F.col("t").between(F.col("_from"), F.col("_to")))
    # the last stretch ends with its last moment; what lies behind it counts for the whole key alone
    nth = F.floor((F.col("t") - F.col("_from")) / F.col("_width"))
    nth = F.when(F.col("t") == F.col("_from") + F.col("_n") * F.col("_width"), F.col("_n") - 1).otherwise(nth)
    edges = x.groupBy(*keys).agg(*[f(F.min(c) if f is F.floor else F.max(c)).alias(f"_{c}{k}") for c in ("x", "y") for k, f in ((0, F.floor), (1, F.ceil))])
    cells = lambda c: F.greatest(F.ceil((F.col(f"_{c}1") - F.col(f"_{c}0")) / bin_size), F.lit(1))
    x = x.join(edges, list(keys))
    cell = lambda c: F.least(F.floor((F.col(c) - F.col(f"_{c}0")) / bin_size), cells(c) - 1)
    visited = x.select(*keys, "_from", "_width", "_n", (cells("x") * cells("y")).alias("_cells"), nth.alias("_nth"), (cell("x") * cells("y") + cell("y")).alias("_cell")).distinct()

    def grow(g: pd.DataFrame) -> pd.DataFrame:
        total, every = int(g["_cells"].iloc[0]), g["_cell"].nunique()
        begin, width, n = float(g["_from"].iloc[0]), float(g["_width"].iloc[0] or 0), int(g["_n"].iloc[0] or 0)
        own = {k: set(v) for k, v in g.groupby("_nth")["_cell"]}
        out, seen, first = [], set(), 0
        for i in range(n):
            seen |= own.get(i, set())
            k = len(seen)
            if method == "correlation":  # of two maps of which one holds the other
                enough = 0 < k < total and every < total and np.sqrt(k * (total - every) / (every * (total - k))) > correlation
            else:
                enough = k > share * every
            if enough:
                out.append((begin + first * width, begin + (i + 1) * width))
                seen, first = set(), i + 1
        frame = pd.DataFrame(out, columns=["start", "stop"])
        for k in reversed(keys):
            frame.insert(0, k, g[k].iloc[0])
        return frame

    return visited.groupBy(*keys).applyInPandas(grow, ", ".join([f"{k} {kinds[k]}" for k in keys] + ["start double", "stop double"]))


def theta_cycles(signal: DataFrame, fs: float, band: tuple[float, float] = (6.0, 10.0), lowpass: float = 48.0, steady: float = 0.4, keys: K = ("session", "channel"), block: float | None = None) -> DataFrame:
    """(keys, start, peak, stop, duration, amplitude, is_burst): trough to trough of the low-passed signal.

    With ``block`` (seconds) a key goes in blocks of time with margins of 20 of
    the slowest cycles, and a cycle counts in the block where it starts. A cycle is part of a burst if its length lies in the band and its length
    and amplitude differ from its neighbours' by less than the share ``steady``.
    """
    from ..functions import dsp

    kinds = dict(signal.dtypes)
    by = keys
    signal = signal.select(*keys, "t", "value")
    if block is not None:
        margin = 20 / band[0]
        own = F.array_distinct(F.array(*[F.floor((F.col("t") + d) / block) for d in (-margin, 0.0, margin)]))
        signal, by = signal.withColumn("_block", F.explode(own)), [*keys, "_block"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        t, x = g["t"].to_numpy(float), dsp.zero_phase(dsp.butter_sos(4, [lowpass], fs, "lowpass"), g["value"].to_numpy(float))
        slow = dsp.zero_phase(dsp.butter_sos(3, list(band), fs), x)
        up = np.flatnonzero((slow[:-1] < 0) & (slow[1:] >= 0))
        down = np.flatnonzero((slow[:-1] >= 0) & (slow[1:] < 0))
        rows = []
        trough = [d + int(np.argmin(x[d : u + 1])) for d, u in ((d, up[np.searchsorted(up, d)]) for d in down if np.searchsorted(up, d) < len(up))]
        for a, b in zip(trough, trough[1:]):
            if b - a > 1:
                p = a + int(np.argmax(x[a:b]))
                rows.append((t[a], t[p], t[b], t[b] - t[a], x[p] - (x[a] + x[b]) / 2))
        frame = pd.DataFrame(rows, columns=["start", "peak", "stop", "duration", "amplitude"])
        if block is not None:
            frame = frame[np.floor(frame["start"] / block) == g["_block"].iloc[0]]
        for k in reversed(keys):
            frame.insert(0, k, g[k].iloc[0])
        return frame

    got = signal.groupBy(*by).applyInPandas(run, ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{c} double" for c in ("start", "peak", "stop", "duration", "amplitude")]))
    w = Window.partitionBy(*keys).orderBy("start")
    near = lambda c: F.greatest(*[F.coalesce(F.abs(F.try_divide(f(c).over(w) - F.col(c), F.greatest(f(c).over(w), F.col(c)))), F.lit(1.0)) for f in (F.lag, F.lead)]) < steady
    in_band = F.col("duration").between(1 / band[1], 1 / band[0])
    return got.withColumn("is_burst", in_band & near("duration") & near("amplitude"))


def burst_epochs(cycles: DataFrame, keys: K = ("session", "channel")) -> DataFrame:
    """Runs of burst cycles as epochs."""
    r = iv.runs(cycles, F.col("is_burst"), "start", keys)
    last = cycles.select(*keys, F.col("start").alias("last"), "stop")
    return r.join(last, [*keys, "last"]).select(*keys, F.col("first").alias("start"), "stop", "n")
