"""Occupancy-normalised maps and their fields, as long tables (unit, bx[, by], rate)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .grid import histogram_bin
from .joins import interpolate_at

#: axis: (column, lowest edge, step, number of bins)
Axis = tuple[str, float, float, int]


def _binned(rows: DataFrame, axes: Sequence[Axis], names: Sequence[str]) -> DataFrame:
    for (c, lo, step, n), name in zip(axes, names, strict=True):
        rows = rows.withColumn(name, histogram_bin(c, lo, step, n))
    for name in names:
        rows = rows.where(F.col(name).isNotNull())
    return rows


def names_of(axes: Sequence[Axis]) -> list[str]:
    return ["bx", "by", "bz", "bw"][: len(axes)]


def occupancy(position: DataFrame, axes: Sequence[Axis], rate: float, keys: Sequence[str] = ()) -> DataFrame:
    """Seconds in each visited bin of any number of axes: (keys, bx, ..., occ)."""
    names = names_of(axes)
    return _binned(position, axes, names).groupBy(*keys, *names).agg((F.count(F.lit(1)) / rate).alias("occ"))


def rate_map(at: DataFrame, occ: DataFrame, axes: Sequence[Axis], unit: str = "unit", keys: Sequence[str] = (), min_duration: float = 0.0, min_rate: float = 0.0, floor_first: bool = True) -> DataFrame:
    """(keys, unit, bx, ..., n, occ, rate) of points with coordinates, for all visited bins and all units of ``at``.

    Bins seen for less than ``min_duration`` have rate 0. ``floor_first``: the
    least rate is put in before that (as for one axis), else after it.
    """
    names = names_of(axes)
    got = _binned(at, axes, names).groupBy(*keys, unit, *names).agg(F.count(F.lit(1)).alias("n"))
    units = at.select(*keys, unit).distinct()
    every = units.join(occ, list(keys)) if keys else units.join(occ)  # the map has a row for each unit and bin
    got = every.join(got, [*keys, unit, *names], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rate = F.coalesce(F.try_divide("n", "occ"), F.lit(0.0))
    short = F.col("occ") < min_duration
    least = lambda c: F.when(c < min_rate, F.lit(min_rate)).otherwise(c)
    value = F.when(short, F.lit(0.0)).otherwise(least(rate)) if floor_first else least(F.when(short, F.lit(0.0)).otherwise(rate))
    return got.withColumn("rate", value)


def spike_positions(points: DataFrame, position: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), width: float = 10.0) -> DataFrame:
    """Points with linearly interpolated coordinates; outside the recording they are null."""
    for c in columns:
        points = interpolate_at(points, position, "t", c, keys, width)
    return points


def mean_map(rows: DataFrame, axes: Sequence[Axis], value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of a continuous value in each bin."""
    names = names_of(axes)
    return _binned(rows, axes, names).groupBy(*keys, *names).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def information(maps: DataFrame, unit: str = "unit", rate: str = "rate", occ: str = "occ") -> DataFrame:
    """(unit, information, information_rate, sparsity, selectivity) from the published definitions.

    information = sum p (r / m) log2(r / m); sparsity = m^2 / sum p r^2;
    selectivity = max r / m, with p the share of time and m the mean rate.
    """
    p = F.col(occ) / F.sum(occ).over(Window.partitionBy(unit))
    x = maps.withColumn("_p", p)
    m = x.groupBy(unit).agg(F.sum(F.col("_p") * F.col(rate)).alias("_m"))
    x = x.join(m, unit)
    r = F.try_divide(F.col(rate), F.col("_m"))
    term = F.when(r > 0, F.col("_p") * r * F.log2(r)).otherwise(0.0)
    got = x.groupBy(unit).agg(F.sum(term).alias("information"), F.first("_m").alias("_m"), F.sum(F.col("_p") * F.col(rate) * F.col(rate)).alias("_q"), F.max(rate).alias("_x"))
    return got.select(unit, "information", (F.col("information") * F.col("_m")).alias("information_rate"), F.try_divide(F.col("_m") * F.col("_m"), F.col("_q")).alias("sparsity"), F.try_divide("_x", "_m").alias("selectivity"))


def shuffle_information(rows: DataFrame, index: str, n: int, columns: Sequence[str], axes: Sequence[Axis], flag: Column, n_shuffles: int, rate: float, seed: int = 0) -> DataFrame:
    """(shuffle, information) with positions rolled against activity by a hashed offset; shuffle 0 is the observed one.

    ``rows`` has a position and ``flag`` (points at that sample) for each index
    0 .. n-1; the roll is an equi-join on the shifted index.
    """
    spark = rows.sparkSession
    shifts = spark.range(n_shuffles + 1).select(F.col("id").cast("int").alias("shuffle"), F.when(F.col("id") == 0, 0).otherwise(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n - 1)) + 1).alias("_by"))
    active = rows.withColumn("_k", flag).where("_k > 0").select(F.col(index).alias("_i"), "_k")
    rolled = active.join(F.broadcast(shifts), F.lit(True)).withColumn(index, F.pmod(F.col("_i") + F.col("_by"), F.lit(n)))  # n_shuffles + 1 rows
    names = names_of(axes)
    at = _binned(rolled.join(rows.select(index, *columns), index), axes, names).groupBy("shuffle", *names).agg(F.sum("_k").alias("n"))
    occ = occupancy(rows, axes, rate)
    got = occ.join(F.broadcast(shifts.select("shuffle")), F.lit(True)).join(at, ["shuffle", *names], "left")
    return information(got.withColumn("rate", F.coalesce(F.col("n"), F.lit(0)) / F.col("occ")), "shuffle")


def normalise(maps: DataFrame, unit: str = "unit") -> DataFrame:
    return maps.withColumn("rate", F.try_divide("rate", F.max("rate").over(Window.partitionBy(unit))))


def peak_order(maps: DataFrame, index: str = "bx", unit: str = "unit") -> DataFrame:
    """Units in order of the bin of their highest rate."""
    peak = maps.groupBy(unit).agg(F.max_by(index, F.struct("rate", -F.col(index))).alias("peak"))
    return peak.withColumn("order", F.row_number().over(Window.orderBy("peak", unit)) - 1)  # a row a unit


def spatial_correlation(maps: DataFrame, bins: Sequence[str], unit: str = "unit") -> DataFrame:
    """Pearson's r of all pairs of maps over the bins that both have."""
    a = maps.where("rate is not null").select(unit, *bins, F.col("rate").alias("x"))
    b = a.select(F.col(unit).alias("unit2"), *bins, F.col("x").alias("y"))
    got = a.join(b, list(bins)).where(F.col(unit) < F.col("unit2")).groupBy(unit, "unit2").agg(F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return got.select(unit, "unit2", F.try_divide("c", F.col("sx") * F.col("sy")).alias("r"))


# fields


def fields_1d(maps: DataFrame, threshold: float, min_length: int = 1, max_length: int = 20, max_mean: float | None = None, unit: str = "unit", index: str = "bx") -> DataFrame:
    """(unit, first, last, n, peak, mean): runs of bins above the threshold with a length and a mean within bounds."""
    w = Window.partitionBy(unit).orderBy(index)
    n = maps.withColumn("_i", F.row_number().over(w)).where(F.col("rate") > threshold)
    g = n.withColumn("_g", F.col("_i") - F.row_number().over(w))
    got = g.groupBy(unit, "_g").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count(F.lit(1)).alias("n"), F.max("rate").alias("peak"), F.avg("rate").alias("mean")).drop("_g")
    got = got.where(F.col("n").between(min_length, max_length))
    if max_mean is not None:
        means = maps.groupBy(unit).agg(F.avg("rate").alias("_all"))
        got = got.join(means.where(F.col("_all") < max_mean), unit).drop("_all")
    return got


def label_fields(maps: DataFrame, threshold: float, unit: str = "unit") -> DataFrame:
    """Cells above the threshold with ``field``, the number of their 4-connected region in the unit (NumPy, a unit at a time)."""
    import numpy as np
    import pandas as pd

    from ..functions.images import label

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x, y = g["bx"].to_numpy(), g["by"].to_numpy()
        image = np.zeros((x.max() + 1, y.max() + 1))
        image[x, y] = g["rate"].fillna(0)
        return g.assign(field=label(image > threshold)[x, y].astype("int32"))

    ddl = f"{unit} {dict(maps.dtypes)[unit]}, bx int, by int, rate double, field int"
    return maps.select(unit, "bx", "by", "rate").groupBy(unit).applyInPandas(run, ddl)


def _images(maps: DataFrame, make, unit: str, column: str = "field", kind: str = "int") -> DataFrame:
    """Cells with what ``make`` gives for the image of their unit; a unit at a time."""
    import numpy as np
    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x, y = g["bx"].to_numpy(), g["by"].to_numpy()
        image = np.zeros((x.max() + 1, y.max() + 1))
        image[x, y] = g["rate"].fillna(0)
        return g.assign(**{column: make(image)[x, y]})

    ddl = f"{unit} {dict(maps.dtypes)[unit]}, bx int, by int, rate double, {column} {kind}"
    return maps.select(unit, "bx", "by", "rate").groupBy(unit).applyInPandas(run, ddl)


def place_fields(maps: DataFrame, min_rate: float = 1.0, threshold: float = 0.2, smallest: int = 100, largest: int = 200, sigma: float | None = None, unit: str = "unit") -> DataFrame:
    """Cells with ``field``: regions around descending peaks (:func:`~pulsegrid.functions.images.place_fields`), 0 outside."""
    from ..functions.images import place_fields as found

    return _images(maps, lambda m: found(m, min_rate, threshold, smallest, largest, sigma).astype("int32"), unit)


def separate_fields(maps: DataFrame, method: str = "laplace", threshold: float = 0.0, sigma: float = 2.0, seed: float = 2.5, smallest: int | None = None, unit: str = "unit") -> DataFrame:
    """Cells with ``field``: regions of negative curvature, numbered by descending peak, 0 outside.

    ``laplace`` takes curvature below a share of its least value;
    ``laplace_of_gaussian`` that of the smoothed map; ``dilation`` that of what
    a reconstruction of the standardised map from ``seed`` below leaves.
    """
    from ..functions import images as im

    def regions(m):
        if method == "dilation":
            m = (m - m.mean()) / (m.std() or 1.0)
            m = m - im.reconstruct(m - seed, m)
        curve = im.laplace(m if method == "laplace" else im.gaussian_filter(m, sigma))
        return im.label(curve < (threshold * curve.min() if method == "laplace" else 0.0)).astype("int32")

    if method not in ("laplace", "laplace_of_gaussian", "dilation"):
        raise ValueError(method)
    cells = _images(maps, regions, unit)
    cells = remove_by_area(cells, smallest, unit=unit) if smallest else cells
    return sort_by_rate(cells, unit)


def blobs(maps: DataFrame, sigmas: Sequence[float], threshold: float, unit: str = "unit") -> DataFrame:
    """Cells where the scale-normalised curvature of the smoothed map is highest around them and over all scales, with ``strength`` and ``radius``."""
    import numpy as np

    from ..functions import images as im

    def scales(m):
        return np.stack([-(s**2) * im.laplace(im.gaussian_filter(m, s)) for s in sigmas])

    def tops(m):
        v = scales(m)
        pad = np.pad(v, 1, constant_values=-np.inf)
        near = np.max([pad[i : i + v.shape[0], j : j + v.shape[1], k : k + v.shape[2]] for i in range(3) for j in range(3) for k in range(3)], axis=0)
        best = np.where((v >= near) & (v > threshold), v, -np.inf)
        at = best.argmax(axis=0)
        return np.where(np.isfinite(best.max(axis=0)), np.asarray(sigmas)[at] * np.sqrt(2.0), 0.0)

    strength = _images(maps, lambda m: scales(m).max(axis=0), unit, "strength", "double").select(unit, "bx", "by", "strength")
    return _images(maps, tops, unit, "radius", "double").where("radius > 0").join(strength, [unit, "bx", "by"])


def linear_place_fields(maps: DataFrame, least: int = 5, min_rate: float = 1.0, threshold: float = 0.5, unit: str = "unit", index: str = "bx") -> DataFrame:
    """Bins with ``field``: in some window, from ``least`` bins up, that peaks above ``min_rate`` and stays above the share ``threshold`` of its peak.

    A window has to grow bin by bin from a start whose first ``least`` bins
    already hold, so all windows of a start end where the first one fails.
    """
    w = Window.partitionBy(unit).orderBy(index)
    values = F.collect_list("rate").over(w.rowsBetween(0, Window.unboundedFollowing))
    left = F.size("_v")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("ok"), F.lit(float("-inf")).alias("top"), F.lit(float("inf")).alias("low"), F.lit(True).alias("on"))

    def grow(acc: Column, v: Column) -> Column:
        top, low, n = F.greatest(acc["top"], v), F.least(acc["low"], v), acc["n"] + 1
        holds = acc["on"] & ((n < least) | ((top > min_rate) & (low > threshold * top)))
        return F.struct(n.alias("n"), F.when(holds & (n >= least), n).otherwise(acc["ok"]).alias("ok"), top.alias("top"), low.alias("low"), holds.alias("on"))

    # the last bin of the map never ends a window
    x = maps.withColumn("_v", values).withColumn("_k", F.when(left > least, F.aggregate(F.slice("_v", 1, F.greatest(left - 1, F.lit(1))), start, grow, lambda acc: acc["ok"])).otherwise(0))
    i = F.row_number().over(w)
    reach = F.max(i + F.col("_k")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("field", i < reach).drop("_v", "_k")


def remove_by_area(cells: DataFrame, smallest: int, largest: int | None = None, unit: str = "unit") -> DataFrame:
    """Fields of too few or too many cells become 0."""
    area = F.count(F.lit(1)).over(Window.partitionBy(unit, "field"))
    ok = (F.col("_a") >= smallest) & (F.col("_a") <= largest if largest is not None else F.lit(True))
    return cells.withColumn("_a", area).withColumn("field", F.when(ok, F.col("field")).otherwise(0)).drop("_a")


def sort_by_rate(cells: DataFrame, unit: str = "unit") -> DataFrame:
    """Fields numbered from 1 by descending highest rate; cells of no field keep 0."""
    peak = cells.where("field > 0").groupBy(unit, "field").agg(F.max("rate").alias("_p"))
    new = peak.withColumn("_new", F.row_number().over(Window.partitionBy(unit).orderBy(F.desc("_p"), "field"))).drop("_p")
    return cells.join(new, [unit, "field"], "left").withColumn("field", F.coalesce("_new", F.lit(0))).drop("_new")


def field_centres(cells: DataFrame, method: str = "maxima", unit: str = "unit") -> DataFrame:
    """(unit, field, x, y): the cell of the highest rate, or the centre of mass."""
    g = cells.where("field > 0").groupBy(unit, "field")
    if method == "maxima":
        return g.agg(F.max_by(F.struct("bx", "by"), F.struct("rate", -F.col("bx"), -F.col("by"))).alias("c")).select(unit, "field", F.col("c.bx").cast("double").alias("x"), F.col("c.by").cast("double").alias("y"))
    return g.agg(F.try_divide(F.sum(F.col("bx") * F.col("rate")), F.sum("rate")).alias("x"), F.try_divide(F.sum(F.col("by") * F.col("rate")), F.sum("rate")).alias("y"))


def which_field(rows: DataFrame, cells: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    """Rows with the field of the bin that they lie in; 0 outside."""
    fields = cells.where("field > 0").select("bx", "by", "field")
    x = rows
    for (c, lo, step, n), name in zip(axes, ("bx", "by"), strict=True):
        x = x.withColumn(name, histogram_bin(c, lo, step, n))
    return x.join(fields, ["bx", "by"], "left").withColumn("field", F.coalesce("field", F.lit(0))).drop("bx", "by")


def crossings(rows: DataFrame, field: str, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """Entries (+1) and exits (-1) of non-zero runs, at the first row of the new state."""
    on = (F.col(field) != 0).cast("int")
    step = on - F.coalesce(F.lag(on).over(Window.partitionBy(*keys).orderBy(order)), F.lit(0))
    return rows.withColumn("crossing", step).where("crossing <> 0")


def consecutive(rows: DataFrame, index: str, step: float, keys: Sequence[str] = ()) -> DataFrame:
    """Numbers the pieces of an index series that is cut where it jumps by more than ``step``."""
    w = Window.partitionBy(*keys).orderBy(index)
    new = F.coalesce((F.col(index) - F.lag(index).over(w) > step).cast("int"), F.lit(0))
    return rows.withColumn("_n", new).withColumn("piece", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_n")


def field_of_peak(maps: DataFrame, threshold: float, unit: str = "unit", index: str = "bx", relative: bool = False) -> DataFrame:
    """(unit, first, last) of the run above the threshold (or that share of the peak) that holds the highest rate."""
    cut = F.max("rate").over(Window.partitionBy(unit)) * threshold if relative else F.lit(threshold)
    w = Window.partitionBy(unit).orderBy(index)
    n = maps.withColumn("_i", F.row_number().over(w)).withColumn("_cut", cut).where(F.col("rate") > F.col("_cut"))
    g = n.withColumn("_g", F.col("_i") - F.row_number().over(w))
    runs = g.groupBy(unit, "_g").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.max("rate").alias("_p"))
    return runs.groupBy(unit).agg(F.max_by(F.struct("first", "last"), F.struct("_p", -F.col("first"))).alias("f")).select(unit, "f.first", "f.last")


def local_peaks(cells: DataFrame, unit: str = "unit", radius: int = 1) -> DataFrame:
    """Cells whose rate is the highest around them, by a join with the neighbours."""
    d = F.array(*[F.lit(k) for k in range(-radius, radius + 1)])
    near = cells.select(unit, F.col("bx"), F.col("by"), F.col("rate").alias("_r")).withColumn("_dx", F.explode(d)).withColumn("_dy", F.explode(d))
    near = near.groupBy(unit, (F.col("bx") + F.col("_dx")).alias("bx"), (F.col("by") + F.col("_dy")).alias("by")).agg(F.max("_r").alias("_top"))
    return cells.join(near, [unit, "bx", "by"]).where((F.col("rate") >= F.col("_top")) & (F.col("rate") > 0)).drop("_top")


def pass_on_unit_circle(rows: DataFrame, centre: tuple[float, float], edge: Column, keys: Sequence[str] = ("pass_id",), t: str = "t") -> DataFrame:
    """Adds r, theta, and along, the position on the pass's mean direction: a field mapped on the unit circle.

    ``edge`` is the distance from the centre to the field's edge in the
    direction ``angle``, a column that is there when it is evaluated.
    """
    dx, dy = F.col("x") - centre[0], F.col("y") - centre[1]
    x = rows.withColumn("angle", F.atan2(dy, dx)).withColumn("_d", F.hypot(dx, dy)).withColumn("r", F.least(F.try_divide("_d", edge), F.lit(1.0)))
    w = Window.partitionBy(*keys).orderBy(t)
    step_x, step_y = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    x = x.withColumn("_sx", step_x).withColumn("_sy", step_y)
    m = x.groupBy(*keys).agg(F.atan2(F.sum("_sy"), F.sum("_sx")).alias("_dir"))
    x = x.join(m, list(keys))
    theta = F.col("angle") - F.col("_dir")
    return x.withColumn("theta", F.atan2(F.sin(theta), F.cos(theta))).withColumn("along", F.col("r") * F.cos(theta)).drop("_d", "_sx", "_sy", "_dir")


def edge_distances(cells: DataFrame, x0: float, y0: float, unit: str = "unit", sectors: int = 36) -> DataFrame:
    """(unit, field, sector, distance): how far a field reaches from a centre, by direction."""
    angle = F.pmod(F.atan2(F.col("by") - y0, F.col("bx") - x0), F.lit(6.283185307179586))
    s = F.floor(angle / (6.283185307179586 / sectors)).cast("int")
    return cells.where("field > 0").groupBy(unit, "field", s.alias("sector")).agg(F.max(F.hypot(F.col("bx") - x0, F.col("by") - y0)).alias("distance"))
