"""Interval algebra: epochs are rows of (keys, start, stop)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import bucket, overlap_join, range_join



def _running(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)


def merge(epochs: DataFrame, keys: Sequence[str] = (), gap: float = 0.0) -> DataFrame:
    """Fuse epochs whose start is within ``gap`` of the latest stop before."""
    w = Window.partitionBy(*keys).orderBy("start", "stop")
    reach = F.max("stop").over(_running(keys))
    new = F.when(reach.isNull() | (F.col("start") - reach > gap), 1).otherwise(0)
    marked = epochs.select(*keys, "start", "stop").withColumn("_new", new)
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_island")


def union(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    cols = [*keys, "start", "stop"]
    return merge(a.select(*cols).unionByName(b.select(*cols)), keys)


def intersect(a: DataFrame, b: DataFrame, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Pieces of positive length that lie in an epoch of each side."""
    y = b.select(*keys, F.col("start").alias("start2"), F.col("stop").alias("stop2"))
    got = overlap_join(a.select(*keys, "start", "stop"), y, width, keys)
    return got.select(*keys, F.greatest("start", "start2").alias("start"), F.least("stop", "stop2").alias("stop"))


def complement(epochs: DataFrame, domain: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Gaps inside the domain rows (keys, start, stop), one domain a key; keys without epochs give their whole domain."""
    m = merge(epochs, keys).select(*keys, "start", "stop")
    d = domain.select(*keys, F.col("start").alias("_d0"), F.col("stop").alias("_d1"))
    if keys:
        m = d.join(m, list(keys), "left")
    else:
        m = d.join(m, F.lit(True), "left")
    m = m.withColumn("start", F.greatest("start", "_d0")).withColumn("stop", F.least("stop", "_d1"))
    w = Window.partitionBy(*keys).orderBy("start")
    before = F.coalesce(F.lag("stop").over(w), F.col("_d0"))
    last = F.lead("start").over(w).isNull()
    m = m.withColumn("_before", before).withColumn("_last", last)
    pieces = F.array(
        F.struct(F.col("_before").alias("start"), F.coalesce(F.col("start"), F.col("_d1")).alias("stop")),
        F.struct(F.when(F.col("_last"), F.col("stop")).alias("start"), F.col("_d1").alias("stop")),
    )
    return m.select(*keys, F.explode(pieces).alias("p")).select(*keys, "p.start", "p.stop").where("start < stop")


def expand(epochs: DataFrame, before: float, after: float | None = None) -> DataFrame:
    after = before if after is None else after
    return epochs.withColumn("start", F.col("start") - before).withColumn("stop", F.col("stop") + after)


def split_by_width(epochs: DataFrame, width: float) -> DataFrame:
    """Bins of ``width`` from the start; the last one ends at the stop. Adds ``bin``."""
    n = F.ceil((F.col("stop") - F.col("start")) / width).cast("int")
    rows = epochs.where("stop > start").withColumn("bin", F.explode(F.sequence(F.lit(0), n - 1)))
    lo = F.col("start") + F.col("bin") * width
    return rows.withColumn("_lo", lo).withColumn("stop", F.least(F.col("stop"), F.col("start") + (F.col("bin") + 1) * width)).withColumn("start", F.col("_lo")).drop("_lo")


def split_equal_parts(epochs: DataFrame, n_parts: int) -> DataFrame:
    step = (F.col("stop") - F.col("start")) / n_parts
    rows = epochs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))).withColumn("_step", step)
    return rows.withColumn("_lo", F.col("start") + F.col("part") * F.col("_step")).withColumn("stop", F.col("start") + (F.col("part") + 1) * F.col("_step")).withColumn("start", F.col("_lo")).drop("_lo", "_step")


def sliding_windows(epochs: DataFrame, width: float, step: float) -> DataFrame:
    """Windows start, start + step, ...; one that would end at the stop or beyond is left out. Adds ``win``."""
    n = F.ceil((F.col("stop") - F.col("start") - width) / step).cast("int")
    rows = epochs.withColumn("_n", n).where("_n > 0").withColumn("win", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.withColumn("start", F.col("start") + F.col("win") * step).withColumn("stop", F.col("start") + width).drop("_n")


def overlapping(epochs: DataFrame, others: DataFrame, width: float, keys: Sequence[str] = (), by: str = "epoch_id", other: str = "other_id") -> DataFrame:
    """Epochs that strictly overlap any other one, with the first such as ``first_other``."""
    y = others.select(*keys, F.col("start").alias("start2"), F.col("stop").alias("stop2"), F.col(other))
    hit = overlap_join(epochs, y, width, keys)
    return hit.groupBy(*keys, by, "start", "stop").agg(F.min_by(other, F.struct("start2", other)).alias("first_other"))


def overlap_length(epochs: DataFrame, others: DataFrame, width: float, keys: Sequence[str] = (), by: str = "epoch_id", other: str = "other_id") -> DataFrame:
    """Every epoch with ``overlap``, its common length with the first other epoch that touches it, else 0; ``inside``: all of it."""
    y = others.select(*keys, F.col("start").alias("start2"), F.col("stop").alias("stop2"), F.col(other))
    hit = overlap_join(epochs.select(*keys, by, "start", "stop"), y, width, keys, touching=True)
    length = F.greatest(F.lit(0.0), F.least("stop", "stop2") - F.greatest("start", "start2"))
    whole = (F.col("start2") <= F.col("start")) & (F.col("stop") <= F.col("stop2"))
    first = hit.groupBy(*keys, by).agg(F.min_by(F.struct(length.alias("o"), whole.alias("w")), F.struct("start2", other)).alias("f"))
    return epochs.join(first, [*keys, by], "left").withColumn("overlap", F.coalesce("f.o", F.lit(0.0))).withColumn("inside", F.coalesce("f.w", F.lit(False))).drop("f")


def runs(rows: DataFrame, flag: Column, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """First and last ``order`` of each run of rows where ``flag`` is true, and its number of rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = rows.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_i", F.row_number().over(w))
    on = numbered.where("_f").withColumn("_g", F.col("_i") - F.row_number().over(w))
    return on.groupBy(*keys, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("_g")


def run_epochs(samples: DataFrame, speed: str, at_least: float, order: str = "t", keys: Sequence[str] = (), max_gap: float | None = None, longer: float = 0.0) -> DataFrame:
    """(keys, start, stop): runs of samples at or above a speed; a pause between samples of more than ``max_gap`` ends a run."""
    w = Window.partitionBy(*keys).orderBy(order)
    on = F.coalesce(F.col(speed) >= at_least, F.lit(False))
    x = samples.where(F.col(speed).isNotNull()).withColumn("_on", on)
    new = F.col("_on") & (~F.coalesce(F.lag("_on").over(w), F.lit(False)) | (F.coalesce(F.col(order) - F.lag(order).over(w) > max_gap, F.lit(False)) if max_gap is not None else F.lit(False)))
    x = x.withColumn("_new", new.cast("int")).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_on")
    got = x.groupBy(*keys, "_g").agg(F.min(order).alias("start"), F.max(order).alias("stop")).drop("_g")
    return got.where(F.col("stop") - F.col("start") >= longer) if longer else got


def flattened(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Points of all units as one train."""
    return points.select(*keys, "t")


def hysteresis(rows: DataFrame, value: str, high: float, low: float, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``state``: true from a value above ``high`` until one below ``low``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    turn = F.when(F.col(value) > high, True).when(F.col(value) < low, False)
    return rows.withColumn("state", F.coalesce(F.last(turn, ignorenulls=True).over(w), F.lit(False)))


def membership(points: DataFrame, epochs: DataFrame, t: str, width: float, keys: Sequence[str] = (), by: str = "epoch_id") -> DataFrame:
    """Every point with ``interval``, the last (by start) of the closed epochs that hold it, null if none; equal points all stay."""
    own = {k: f"_e_{k}" for k in keys}
    e = epochs.where("start <= stop").select(*[F.col(k).alias(o) for k, o in own.items()], F.struct("start", F.col(by).alias("id")).alias("_epoch"), F.col("start").alias("_lo"), F.col("stop").alias("_hi"))
    e = e.withColumn("_wb", F.explode(F.sequence(bucket("_lo", width), bucket("_hi", width))))
    x = points.withColumn("_bucket", bucket(t, width)).withColumn("_row", F.monotonically_increasing_id())
    same = (F.col("_bucket") == F.col("_wb")) & F.col(t).between(F.col("_lo"), F.col("_hi"))
    for k, o in own.items():
        same &= F.col(k) == F.col(o)
    # a point's epochs come together where the join has put them, by the number of its row
    got = x.join(e, same, "left").groupBy(*keys, "_bucket", "_row").agg(*[F.first(c).alias(c) for c in points.columns if c not in keys], F.max("_epoch").alias("_epoch"))
    return got.select(*points.columns, F.col("_epoch.id").alias("interval"))


def restrict(points: DataFrame, epochs: DataFrame, t: str, width: float, keys: Sequence[str] = (), ends: str = "closed") -> DataFrame:
    """Points inside any epoch."""
    e = epochs.select(*keys, F.col("start").alias("_lo"), F.col("stop").alias("_hi"))
    return range_join(points, e, t, "_lo", "_hi", width, keys, ends, "left_semi")


def gap_offsets(epochs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Disjoint epochs with ``before``, the length of all earlier ones."""
    w = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return epochs.withColumn("before", F.coalesce(F.sum(F.col("stop") - F.col("start")).over(w), F.lit(0.0)))


def shifted(points: DataFrame, epochs: DataFrame, t: str, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Points inside disjoint epochs, with the time between the epochs taken out as ``shifted``."""
    e = gap_offsets(epochs.select(*keys, "start", "stop"), keys).select(*keys, F.col("start").alias("_lo"), F.col("stop").alias("_hi"), "before")
    got = range_join(points, e, t, "_lo", "_hi", width, keys, ends="left")
    return got.withColumn("shifted", F.col(t) - F.col("_lo") + F.col("before")).drop("_lo", "_hi", "before")


def shift_epochs(epochs: DataFrame, onto: DataFrame, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """The parts of epochs inside ``onto``, on a clock that runs only inside ``onto``."""
    e = gap_offsets(onto.select(*keys, "start", "stop"), keys).select(*keys, F.col("start").alias("start2"), F.col("stop").alias("stop2"), "before")
    got = overlap_join(epochs.select(*keys, "start", "stop"), e, width, keys)
    move = lambda c: F.greatest(F.least(F.col(c), F.col("stop2")), F.col("start2")) - F.col("start2") + F.col("before")
    return got.select(*keys, move("start").alias("s"), move("stop").alias("e")).select(*keys, F.col("s").alias("start"), F.col("e").alias("stop"))


def truncate(epochs: DataFrame, time: float, keys: Sequence[str] = ()) -> DataFrame:
    """Leading epochs up to a total length of ``time``; the one that crosses it is cut."""
    e = gap_offsets(epochs, keys).where(F.col("before") < time)
    return e.withColumn("stop", F.least(F.col("stop"), F.col("start") + (time - F.col("before")))).drop("before")


def randomize(epochs: DataFrame, domain: tuple[float, float], seed: int = 0, each: bool = True) -> DataFrame:
    """Epochs moved by a uniform amount (each by its own, or all by one) and wrapped inside the domain."""
    lo, hi = domain
    span = hi - lo
    if each:
        move = F.rand(seed) * span
    else:
        import random

        move = F.lit(random.Random(seed).uniform(0, span))
    length = F.col("stop") - F.col("start")
    start = lo + F.pmod(F.col("start") - lo + F.col("_m"), F.lit(span))
    moved = epochs.withColumn("_m", move).withColumn("_len", length).withColumn("start", start)
    return moved.withColumn("stop", F.least(F.col("start") + F.col("_len"), F.lit(hi))).drop("_m", "_len")


def relative_times(points: DataFrame, epochs: DataFrame, t: str, width: float, keys: Sequence[str] = (), by: str = "epoch_id", values: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Every point with ``interval`` and ``rel``, its place in the epoch scaled to ``values``; of two touching epochs the earlier."""
    e = epochs.select(*keys, F.col("start").alias("_lo"), F.col("stop").alias("_hi"), F.col(by).alias("_id"))
    got = range_join(points.select(*keys, t).distinct(), e, t, "_lo", "_hi", width, keys)
    rank = F.struct((F.col("_lo") < F.col(t)).cast("int").alias("a"), F.when(F.col("_lo") < F.col(t), F.col("_lo")).alias("b"))
    got = got.groupBy(*[F.col(c).alias(f"_m_{c}") for c in (*keys, t)]).agg(F.max_by(F.struct("_id", "_lo", "_hi"), rank).alias("e"))
    same = F.col(t) == F.col(f"_m_{t}")
    for k in keys:
        same &= F.col(k) == F.col(f"_m_{k}")
    cols, got = points.columns, points.join(got, same, "left")
    a, b = values
    rel = a + (b - a) * F.try_divide(F.col(t) - F.col("e._lo"), F.col("e._hi") - F.col("e._lo"))
    return got.select(*cols, F.col("e._id").alias("interval"), rel.alias("rel"))


