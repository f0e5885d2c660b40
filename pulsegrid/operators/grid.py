"""Bins, spines with zeros, kernel smoothing, and array-like reshaping of long tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def spine(n: int, name: str = "bin"):
    """Column that explodes into 0 .. n-1."""
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)


def histogram_bin(x: Column | str, lo: float, step: float, n: int) -> Column:
    """Bin of n equal ones from lo; the last is closed on the right, outside is null."""
    x = F.col(x) if isinstance(x, str) else x
    b = F.floor((x - lo) / step).cast("int")
    return F.when((x >= lo) & (x <= lo + n * step), F.least(b, F.lit(n - 1)))


def bin_counts(points: DataFrame, t: str, step: float, lo: float, n: int, keys: Sequence[str] = ("unit",)) -> DataFrame:
    """Counts of points for each key and bin, zeros included, for all keys of the table."""
    got = points.withColumn("bin", histogram_bin(t, lo, step, n)).where("bin is not null").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    every = points.select(*keys).distinct().select(*keys, spine(n))
    return every.join(got, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def gaussian(sigma: float, truncate: float = 4.0) -> list[float]:
    """Weights at 0, 1, ... bins from the centre."""
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(r + 1)]
    total = w[0] + 2 * sum(w[1:])
    return [x / total for x in w]


def smooth(rows: DataFrame, value: str, index: str, sigma: float, keys: Sequence[str] = (), renormalise: bool = True, truncate: float = 4.0, out: str | None = None) -> DataFrame:
    """Gaussian smoothing along an integer index without gaps, by lags inside one window per key.

    Weights that fall outside the ends are left out and, with ``renormalise``,
    made up for.
    """
    w = Window.partitionBy(*keys).orderBy(index)
    g = gaussian(sigma, truncate)
    terms, weights = F.lit(g[0]) * F.col(value), F.lit(g[0])
    for k, x in enumerate(g[1:], 1):
        for c in (F.lag(value, k).over(w), F.lead(value, k).over(w)):
            terms = terms + F.coalesce(c * x, F.lit(0.0))
            weights = weights + F.when(c.isNotNull(), F.lit(x)).otherwise(0.0)
    return rows.withColumn(out or value, terms / weights if renormalise else terms)


def zscore(rows: DataFrame, value: str, keys: Sequence[str] = (), ddof: int = 0, out: str = "z", constant: float | None = 0.0) -> DataFrame:
    """Standard scores within each key; a constant key gives ``constant``.

    The moments are aggregated and joined back, so a key's rows are never
    sorted into one window.
    """
    std = F.stddev_pop(value) if ddof == 0 else F.stddev_samp(value)
    m = rows.groupBy(*keys).agg(F.avg(value).alias("_m"), std.alias("_s"))
    joined = rows.join(m, list(keys)) if keys else rows.join(F.broadcast(m), F.lit(True))  # one row
    z = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(F.when(F.col(value).isNotNull(), F.lit(constant)))
    return joined.withColumn(out, z).drop("_m", "_s")


def shrink(cells: DataFrame, row: str, col: str, value: str, rows_per: int, cols_per: int, n_rows: int, n_cols: int) -> DataFrame:
    """Means of blocks; a shape that does not divide is padded evenly on both sides with nothing."""
    pad = lambda n, k: ((-n) % k) // 2
    r = F.floor((F.col(row) + pad(n_rows, rows_per)) / rows_per).cast("int")
    c = F.floor((F.col(col) + pad(n_cols, cols_per)) / cols_per).cast("int")
    return cells.groupBy(r.alias(row), c.alias(col)).agg(F.avg(value).alias(value))


def border_zeros_to_null(rows: DataFrame, value: str, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """Zeros before the first and after the last non-zero value become null."""
    w = Window.partitionBy(*keys).orderBy(order)
    on = F.sum(F.when(F.col(value) != 0, 1).otherwise(0))
    before = on.over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = on.over(Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))  # a frame that only grows
    return rows.withColumn(value, F.when((before > 0) & (after > 0), F.col(value)))


def terminal_true(rows: DataFrame, flag: Column, index: str, keys: Sequence[str] = ()) -> DataFrame:
    """First and last index where the flag holds, for each key; -1 if nowhere."""
    on = F.when(flag, F.col(index))
    return rows.groupBy(*keys).agg(F.coalesce(F.min(on), F.lit(-1)).alias("first"), F.coalesce(F.max(on), F.lit(-1)).alias("last"))


def average_diagonal(cells: DataFrame, row: str, col: str, value: str) -> DataFrame:
    return cells.groupBy((F.col(col) - F.col(row)).alias("diagonal")).agg(F.avg(value).alias("mean"))


def circular_shift(rows: DataFrame, index: str, n: int, by: Column | int) -> DataFrame:
    """Rolls an integer index of 0 .. n-1."""
    by = by if isinstance(by, Column) else F.lit(by)
    return rows.withColumn(index, F.pmod(F.col(index) + by, F.lit(n)).cast("int"))


def image_spread(cells: DataFrame, row: str, col: str, value: str, keys: Sequence[str] = (), exponent: float = 2.0, normalise: bool = True) -> DataFrame:
    """Moment of distance from the centre of mass, relative to that of a flat image, and its root; null for an empty one."""
    total = F.sum(value)
    m = cells.groupBy(*keys).agg(total.alias("_t"), F.sum(F.col(value) * F.col(row)).alias("_r"), F.sum(F.col(value) * F.col(col)).alias("_c"), F.avg(row).alias("_fr"), F.avg(col).alias("_fc"))
    x = cells.join(m, list(keys)) if keys else cells.join(F.broadcast(m), F.lit(True))  # one row
    away = lambda a, b: F.pow(F.sqrt(F.pow(F.col(row) - a, F.lit(2)) + F.pow(F.col(col) - b, F.lit(2))), F.lit(exponent))
    d = away(F.try_divide("_r", "_t"), F.try_divide("_c", "_t"))
    flat = away(F.col("_fr"), F.col("_fc"))
    got = x.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * d), F.sum(value)).alias("moment"), F.avg(flat).alias("_flat"))
    if normalise:
        got = got.withColumn("moment", F.try_divide("moment", "_flat"))
    return got.withColumn("spread", F.pow(F.col("moment"), F.lit(1.0 / exponent))).drop("_flat")


def interpolate_nulls(rows: DataFrame, value: str, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """Nulls become linear between the known values around; the ends take the nearest one."""
    w = Window.partitionBy(*keys).orderBy(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("t"), F.col(value).alias("v")))
    a = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # looking back from the end: a frame up to the last row would be read anew for every row
    b = F.last(known, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))
    x = rows.withColumn("_a", a).withColumn("_b", b)
    mid = F.col("_a.v") + F.try_divide(F.col(order) - F.col("_a.t"), F.col("_b.t") - F.col("_a.t")) * (F.col("_b.v") - F.col("_a.v"))
    return x.withColumn(value, F.coalesce(F.col(value), mid, F.col("_a.v"), F.col("_b.v"))).drop("_a", "_b")
