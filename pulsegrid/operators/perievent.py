"""Peri-event operators: points, signals and counts around reference events.

``points`` has (keys, t); ``refs`` has (keys, ref_id, r). Every operator is a
bucketed range join, followed by at most one aggregation; counts of lags look
their bins up instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .grid import histogram_bin, smooth, spine, zscore
from .joins import bucket, interpolate_at, nearest_join, range_join


def odd(n_bins: int) -> int:
    return n_bins if n_bins % 2 else n_bins + 1


def around(points: DataFrame, refs: DataFrame, before: float, after: float, keys: Sequence[str] = (), ends: str = "closed", in_order: bool = False) -> DataFrame:
    """Points with r + before .. r + after of each reference: all columns of both and ``lag`` = t - r."""
    w = refs.withColumn("_lo", F.col("r") + before).withColumn("_hi", F.col("r") + after)
    got = range_join(points, w, "t", "_lo", "_hi", max(after - before, 1e-9), keys, ends, in_order=in_order)
    return got.withColumn("lag", F.col("t") - F.col("r")).drop("_lo", "_hi")


def sync(samples: DataFrame, refs: DataFrame, before: float, after: float, keys: Sequence[str] = ()) -> DataFrame:
    """Samples in the closed window of each reference, on the reference's clock."""
    return around(samples, refs, before, after, keys, in_order=True)


def raster(points: DataFrame, refs: DataFrame, before: float, after: float, keys: Sequence[str] = ()) -> DataFrame:
    """(ref_id, lag) of points strictly inside the window."""
    return around(points, refs, before, after, keys, "open", in_order=True)


def lag_counts(points: DataFrame, refs: DataFrame, width: float, n_bins: int, keys: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Counts of lags in an odd number of bins centred on zero, left-closed, for each of ``by`` that has any.

    Where ``by`` is of one side alone, its rows look up how many of the other
    side's times lie below the edge of each bin, so the work grows with the
    rows and bins, not with the pairs of rows.
    """
    n = odd(n_bins)
    half = n / 2 * width
    for mine, x, other, y in ((points, "t", refs, "r"), (refs, "r", points, "t")):
        if set(by) <= set(mine.columns):
            return _looked_up(mine, x, other, y, width, n, keys, by)
    got = around(points, refs, -half, half, keys, "closed")
    k = F.floor((F.col("t") - (F.col("r") - half)) / width).cast("int")
    return got.withColumn("bin", k).where((F.col("bin") >= 0) & (F.col("bin") < n)).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


#: Times that a task looks up together.
_AT_ONCE = 1 << 15


def _counts_of_bins(x, of_points: bool, y, size, width: float, n: int):
    """(len(x), n) counts of lags of times x, of points or of references, to the distinct rising times y of the others, each there ``size`` times."""
    import numpy as np

    half = n / 2 * width
    j = np.arange(n + 1)
    below = np.r_[0, np.cumsum(size)]
    out = np.empty((len(x), n), np.int64)
    for at in range(0, len(x), _AT_ONCE):
        z = x[at : at + _AT_ONCE, None]

        def first(v):
            """Whether v is of the times before an edge: references that a point is beyond bin j of, or points below bin j."""
            t, r = (z, v) if of_points else (v, z)
            beyond = (np.floor((t - (r - half)) / width) >= j) | (t > r + half)
            return beyond if of_points else ~beyond

        i = np.searchsorted(y, z + half - j * width if of_points else z - half + j * width)
        while True:  # the edge itself may be off by rounding; the bin's own formula says where it is
            up = (i < len(y)) & first(y[np.minimum(i, len(y) - 1)])
            down = (i > 0) & ~first(y[np.maximum(i - 1, 0)])
            if not (up.any() or down.any()):
                break
            i = i + up - (down & ~up)
        c = below[i]
        out[at : at + _AT_ONCE] = c[:, :-1] - c[:, 1:] if of_points else c[:, 1:] - c[:, :-1]
    return out


def _looked_up(mine: DataFrame, x: str, other: DataFrame, y: str, width: float, n: int, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    size, reach = n * width, (n / 2 + 1) * width  # a bin more than the window reaches
    kinds, cols = dict(mine.dtypes), [f"_{i}" for i in range(n)]
    ddl = ", ".join([f"{b} {kinds[b]}" for b in by] + [f"{c} long" for c in cols])
    none = pa.Table.from_batches([], schema=to_arrow_schema(StructType.fromDDL(ddl)))

    def times(d: DataFrame, t: str, *names: str) -> DataFrame:
        d = d.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *names, F.col(t).cast("double").alias("_x"))
        good = F.col("_x").isNotNull() & ~F.isnan("_x")
        for k in keys:
            good &= F.col(f"_k_{k}").isNotNull()
        return d.where(good)

    a = times(mine, x, *by).withColumn("_b", bucket("_x", size))
    b = times(other, y).withColumn("_b", F.explode(F.sequence(bucket(F.col("_x") - reach, size), bucket(F.col("_x") + reach, size))))
    on = [*[f"_k_{k}" for k in keys], "_b"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return none
        at, back = np.unique(a["_x"].to_numpy(), return_inverse=True)
        counts = _counts_of_bins(at, x == "t", *np.unique(b["_x"].to_numpy(), return_counts=True), width, n)
        hit = np.flatnonzero(counts.any(axis=1)[back])
        counts = counts[back[hit]]
        if not by:
            counts = counts.sum(axis=0, keepdims=True)
            return pa.table({c: pa.array(counts[:, i]) for i, c in enumerate(cols)})
        got = pa.table({c: a[c].take(pa.array(hit)) for c in by} | {c: pa.array(counts[:, i]) for i, c in enumerate(cols)})
        got = got.group_by(list(by)).aggregate([(c, "sum") for c in cols])
        return got.select([*by, *[f"{c}_sum" for c in cols]]).rename_columns([*by, *cols]).cast(none.schema)

    got = a.groupBy(*on).cogroup(b.groupBy(*on)).applyInArrow(run, ddl).groupBy(*by).agg(*[F.sum(c).alias(c) for c in cols])
    return got.select(*by, F.posexplode(F.array(*cols)).alias("bin", "n")).where("n > 0")


def psth(points: DataFrame, refs: DataFrame, width: float, n_bins: int, by: Sequence[str] = ("unit",), window: tuple[float, float] | None = None) -> DataFrame:
    """Rate of each unit around the references: (unit, bin, lag, rate), empty bins as zero.

    An asymmetric ``window`` is mirrored for the count and cropped after it.
    """
    if window is not None:
        n_bins = int(round(2 * max(abs(window[0]), abs(window[1])) / width))
    n = odd(n_bins)
    counts = lag_counts(points, refs, width, n, by=by)
    n_refs = refs.agg(F.count(F.lit(1)).alias("n_refs"))
    every = points.select(*by).distinct().select(*by, spine(n)).join(F.broadcast(n_refs), F.lit(True))  # one row
    got = every.join(counts, [*by, "bin"], "left")
    lag = (F.col("bin") - n // 2) * width
    got = got.select(*by, "bin", lag.alias("lag"), F.try_divide(F.coalesce("n", F.lit(0)), F.col("n_refs") * width).alias("rate"))
    if window is not None:
        got = got.where(F.col("lag").between(window[0] - 1e-9, window[1] + 1e-9))
    return got


def peth_matrix(points: DataFrame, refs: DataFrame, width: float, n_bins: int) -> DataFrame:
    """Rate for each reference and bin, empty ones as zero: (ref_id, bin, rate)."""
    got = lag_counts(points, refs, width, n_bins, by=("ref_id",))
    every = refs.select("ref_id").distinct().select("ref_id", spine(odd(n_bins)))
    return every.join(got, ["ref_id", "bin"], "left").select("ref_id", "bin", (F.coalesce("n", F.lit(0)) / width).alias("rate"))


def joint_peth(peth_1: DataFrame, peth_2: DataFrame) -> DataFrame:
    """(bin_1, bin_2, joint, expected, difference) of two tables (ref_id, bin, rate), by event; roots of the means."""
    a, b = (p.select("ref_id", F.col("bin").alias(f"bin_{i}"), F.col("rate").alias(f"rate_{i}")) for i, p in ((1, peth_1), (2, peth_2)))
    n = peth_1.select("ref_id").unionByName(peth_2.select("ref_id")).agg(F.countDistinct("ref_id").alias("n"))
    joint = a.where("rate_1 <> 0").join(b.where("rate_2 <> 0"), "ref_id").groupBy("bin_1", "bin_2").agg(F.sum(F.col("rate_1") * F.col("rate_2")).alias("s"))
    m1, m2 = (p.groupBy(f"bin_{i}").agg(F.sum(f"rate_{i}").alias(f"m_{i}")) for i, p in ((1, a), (2, b)))
    got = m1.crossJoin(m2).join(joint, ["bin_1", "bin_2"], "left").join(F.broadcast(n), F.lit(True))  # bins x bins, and one row
    got = got.select("bin_1", "bin_2", F.sqrt(F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("joint"), F.sqrt(F.col("m_1") * F.col("m_2")).alias("_e"), "n")
    got = got.withColumn("expected", F.col("_e") / F.col("n"))
    return got.select("bin_1", "bin_2", "joint", "expected", (F.col("joint") - F.col("expected")).alias("difference"))


def count_in_intervals(points: DataFrame, epochs: DataFrame, width: float, by: str = "epoch_id", unit: str = "unit") -> DataFrame:
    """(unit, epoch, n, active, rate) for all units and epochs; points on an end do not count."""
    w = epochs.select(by, F.col("start").alias("_lo"), F.col("stop").alias("_hi"))
    got = range_join(points, w, "t", "_lo", "_hi", width, ends="open").groupBy(unit, by).agg(F.count(F.lit(1)).alias("n"))
    every = points.select(unit).distinct().join(epochs.select(by, "start", "stop"))  # the result has a row for each pair
    got = every.join(got, [unit, by], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return got.select(unit, by, "n", (F.col("n") > 0).cast("int").alias("active"), F.try_divide("n", F.col("stop") - F.col("start")).alias("rate"))


def count_events(points: DataFrame, refs: DataFrame, before: float, after: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ref_id, n) of points strictly inside each reference's window, zero included."""
    got = around(points, refs, before, after, keys, "open").groupBy(*keys, "ref_id").agg(F.count(F.lit(1)).alias("n"))
    return refs.select(*keys, "ref_id").join(got, [*keys, "ref_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def nearest_delay(points: DataFrame, others: DataFrame, keys: Sequence[str] = (), width: float = 3600.0) -> DataFrame:
    """Points with the ``nearest`` other point (of two, the later) and ``delay`` = t - nearest."""
    got = nearest_join(points, others, "t", keys=keys, width=width)
    return got.withColumn("delay", F.col("t") - F.col("nearest"))


def average_irregular(samples: DataFrame, refs: DataFrame, value: str, width: float, n_bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """(bin, lag, mean, std, n) of samples pooled over references; both edges belong to a bin."""
    half = n_bins * width / 2
    got = around(samples, refs, -half, half, keys, "open").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    lo = -half + F.col("bin") * width
    got = got.where((F.col("lag") >= lo) & (F.col("lag") <= lo + width))
    return got.groupBy("bin").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(F.lit(1)).alias("n")).withColumn("lag", -half + (F.col("bin") + 0.5) * width)


def average_regular(signal: DataFrame, refs: DataFrame, value: str, rate: float, before: float, after: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, lag_idx, lag, mean, n) of a regular signal (sample_idx, value) around references; incomplete windows are left out.

    The look-up is an equi-join on the sample index.
    """
    a, b = int(round(before * rate)), int(round(after * rate))
    wanted = refs.select("ref_id", F.round(F.col("r") * rate).cast("long").alias("_at"), F.explode(F.sequence(F.lit(a), F.lit(b - 1))).alias("lag_idx"))
    got = wanted.join(signal.withColumn("_at", F.col("sample_idx") - 0).select(*keys, F.col("sample_idx").alias("_s"), value), F.col("_at") + F.col("lag_idx") == F.col("_s"))
    full = F.count(F.lit(1)).over(Window.partitionBy(*keys, "ref_id")) == b - a
    got = got.withColumn("_full", full).where("_full")
    return got.groupBy(*keys, "lag_idx").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).withColumn("lag", F.col("lag_idx") / rate)


def average_interpolated(signal: DataFrame, refs: DataFrame, value: str, rate: float, before: float, after: float, keys: Sequence[str] = (), width: float = 3600.0) -> DataFrame:
    """Like :func:`average_regular` for a signal (t, value) of irregular samples, interpolated at the lags."""
    n = int(-(-(after - before) * rate // 1))
    grid = refs.select("ref_id", *keys, "r", spine(n, "lag_idx")).withColumn("t", F.col("r") + before + F.col("lag_idx") / rate)
    got = interpolate_at(grid, signal, "t", value, keys, width)
    whole = F.count(value).over(Window.partitionBy(*keys, "ref_id")) == n
    return got.withColumn("_whole", whole).where("_whole").groupBy(*keys, "lag_idx").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def rank_order(points: DataFrame, epochs: DataFrame, width: float, by: str = "epoch_id", unit: str = "unit", ref: str = "cells", min_units: int = 1) -> DataFrame:
    """(epoch, unit, order) by first point in the epoch: the rank over active units, or the relative time in the epoch."""
    w = epochs.select(by, F.col("start").alias("_lo"), F.col("stop").alias("_hi"))
    first = range_join(points, w, "t", "_lo", "_hi", width).groupBy(by, unit, "_lo", "_hi").agg(F.min("t").alias("first"))
    p = Window.partitionBy(by)
    n = F.count(F.lit(1)).over(p)
    if ref == "cells":
        order = (F.row_number().over(p.orderBy("first", unit)) - 1) / n
    else:
        order = (F.col("first") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return first.withColumn("_n", n).withColumn("order", F.when(F.col("_n") >= min_units, order)).select(by, unit, "order")


def median_rank(ranks: DataFrame, unit: str = "unit") -> DataFrame:
    return ranks.groupBy(unit).agg(F.percentile("order", F.lit(0.5)).alias("rank"))


def spiking_threshold(points: DataFrame, refs: DataFrame, step: float, lo: float, n: int, size: float, threshold: float = 0.0, sigma: float = 2.0) -> DataFrame:
    """(ref_id, z, passes): the standardised smoothed population rate within ``size`` of each reference against a threshold."""
    counts = points.withColumn("bin", histogram_bin("t", lo, step, n)).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    base = points.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    rate = base.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))
    # the series of one population; chunks of bins keep the smoothing window bounded
    halo, chunk = int(4 * sigma + 0.5), 4096
    part = F.explode(F.array_distinct(F.array(*[F.floor((F.col("bin") + d) / chunk) for d in (-halo, 0, halo)])))
    own = F.floor(F.col("bin") / chunk)
    rate = smooth(rate.withColumn("_c", part), "n", "bin", sigma, ["_c"], out="rate").where(own == F.col("_c")).drop("_c")
    z = zscore(rate, "rate")
    wanted = refs.select("ref_id", F.explode(F.sequence(F.floor((F.col("r") - size - lo) / step), F.floor((F.col("r") + size - lo) / step))).alias("bin"))
    got = wanted.join(z, "bin").groupBy("ref_id").agg(F.avg("z").alias("z"))
    return refs.select("ref_id").join(got, "ref_id", "left").withColumn("passes", F.coalesce(F.col("z") > threshold, F.lit(False)))


def active_units(points: DataFrame, epoch_sets: DataFrame, width: float, least: int, unit: str = "unit", by: str = "set_id") -> DataFrame:
    """Units with ``least`` points or more in every set of epochs (set_id, start, stop)."""
    w = epoch_sets.select(by, F.col("start").alias("_lo"), F.col("stop").alias("_hi"))
    got = range_join(points, w, "t", "_lo", "_hi", width).groupBy(unit, by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    sets = epoch_sets.agg(F.countDistinct(by).alias("_sets"))
    return got.groupBy(unit).agg(F.count(F.lit(1)).alias("_ok")).join(F.broadcast(sets), F.col("_ok") == F.col("_sets")).select(unit)  # one row


def bursts(points: DataFrame, keys: Sequence[str] = ("unit",), mode: str = "bursts", isi_burst: float = 0.006, isi_single: float = 0.02) -> DataFrame:
    """Points near a neighbour on either side, or (``single``) far from both."""
    w = Window.partitionBy(*keys).orderBy("t")
    a, b = F.col("t") - F.lag("t").over(w), F.lead("t").over(w) - F.col("t")
    if mode == "bursts":
        hit = F.coalesce(a < isi_burst, F.lit(False)) | F.coalesce(b < isi_burst, F.lit(False))
    else:
        hit = F.coalesce(a > isi_single, F.lit(False)) & F.coalesce(b > isi_single, F.lit(False))
    return points.withColumn("_hit", hit).where("_hit").drop("_hit")


def burst_index(correlogram: DataFrame, keys: Sequence[str] = ("unit",)) -> DataFrame:
    """(peak - base) / max(peak, base) of autocorrelograms (lag, rate): peak in 2-9 ms, base the mean of 40-50 ms, added up in order of lag; null if equal."""
    near = lambda a, b: F.col("lag").between(a - 1e-9, b + 1e-9)
    late = F.array_sort(F.collect_list(F.when(near(0.04, 0.05), F.struct("lag", "rate"))))  # eleven bins
    total = F.aggregate(late, F.lit(0.0), lambda s, e: s + e["rate"])
    got = correlogram.groupBy(*keys).agg(F.max(F.when(near(0.002, 0.009), F.col("rate"))).alias("peak"), F.try_divide(total, F.size(late)).alias("base"))
    return got.withColumn("index", F.when(F.col("peak") != F.col("base"), F.try_divide(F.col("peak") - F.col("base"), F.greatest("peak", "base"))))


def to_arrays(points: DataFrame, unit: str = "unit") -> DataFrame:
    return points.groupBy(unit).agg(F.array_sort(F.collect_list("t")).alias("times"))


def from_arrays(units: DataFrame, unit: str = "unit") -> DataFrame:
    return units.select(unit, F.explode("times").alias("t"))


