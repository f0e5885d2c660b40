"""Sequences of labelled epochs of a session, and behaviour in space, by window functions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

K = Sequence[str]


def _w(keys: K, order: str):
    return Window.partitionBy(*keys).orderBy(order)


def compress(epochs: DataFrame, label: str, keys: K = ("session",), order: str = "epoch_id", only: str | None = None, first: K = ()) -> DataFrame:
    """Merge neighbours of one label (or of one named label): first order, lowest start, highest stop, first of other columns."""
    w = _w(keys, order)
    same = F.col(label) == F.lag(label).over(w)
    if only is not None:
        same &= F.col(label) == only
    new = F.coalesce((~same).cast("int"), F.lit(1))
    g = epochs.withColumn("_n", new).withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    extra = [F.min_by(c, order).alias(c) for c in first]
    return g.groupBy(*keys, "_g").agg(F.min(order).alias(order), F.first(label).alias(label), F.min("start").alias("start"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("n"), *extra).drop("_g")


def pre_task_post(epochs: DataFrame, is_rest: Column, keys: K = ("session",), order: str = "epoch_id") -> DataFrame:
    """(keys, pre, task, post) of the first rest, other, rest in a row."""
    w = _w(keys, order)
    x = epochs.withColumn("_r", is_rest)
    a, b = F.lead("_r").over(w), F.lead("_r", 2).over(w)
    x = x.withColumn("_hit", F.col("_r") & ~a & b).withColumn("_t", F.lead(order).over(w)).withColumn("_p", F.lead(order, 2).over(w)).where("_hit")
    return x.groupBy(*keys).agg(F.min_by(F.struct(F.col(order).alias("pre"), F.col("_t").alias("task"), F.col("_p").alias("post")), order).alias("s")).select(*keys, "s.*")


def multitask_pre_post(epochs: DataFrame, is_rest: Column, is_task: Column, keys: K = ("session",), order: str = "epoch_id", flank: bool = False, common_pre: bool = False) -> DataFrame:
    """(keys, pre, task, post): each task epoch but the session's first with the nearest rests around it; all three must be there."""
    w = _w(keys, order)
    rest = F.when(is_rest, F.col(order))
    x = epochs.withColumn("pre", F.last(rest, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    back = Window.partitionBy(*keys).orderBy(F.desc(order))
    x = x.withColumn("post", F.last(rest, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("_i", F.row_number().over(w)).withColumn("_first", F.min(rest).over(Window.partitionBy(*keys)))
    if common_pre:
        x = x.withColumn("pre", F.when(F.col("_first") < F.col(order), F.col("_first")))
    x = x.withColumn("_before", F.lag(rest).over(w)).withColumn("_after", F.lead(rest).over(w)).where(is_task & (F.col("_i") > 1) & F.col("pre").isNotNull() & F.col("post").isNotNull())
    if flank:
        x = x.where(F.col("_after").isNotNull())
    return x.select(*keys, "pre", F.col(order).alias("task"), "post")


def pattern(epochs: DataFrame, label: str, labels: Sequence[str], keys: K = ("session",), order: str = "epoch_id") -> DataFrame:
    """(keys, first) where the sequence of labels occurs for the first time."""
    seen = F.collect_list(label).over(_w(keys, order).rowsBetween(0, len(labels) - 1))
    hit = epochs.withColumn("_s", seen).where(F.col("_s") == F.array(*map(F.lit, labels)))
    return hit.groupBy(*keys).agg(F.min(order).alias("first"))


def rolling_triples(epochs: DataFrame, matches: Column, keys: K = ("session",), order: str = "epoch_id") -> DataFrame:
    """Epochs that lie in three matching ones in a row."""
    w = _w(keys, order)
    x = epochs.withColumn("_m", F.coalesce(matches, F.lit(False)).cast("int"))
    x = x.withColumn("_3", F.sum("_m").over(w.rowsBetween(-2, 0)))
    return x.withColumn("_hit", F.max("_3").over(w.rowsBetween(0, 2))).where("_hit = 3").drop("_m", "_3", "_hit")


def triple_around_novel(epochs: DataFrame, is_rest: Column, is_novel: Column, keys: K = ("session",), order: str = "epoch_id") -> DataFrame:
    """(keys, pre, task, post): the triple around the first novel task if it has one, else the first triple."""
    w = _w(keys, order)
    x = epochs.withColumn("_r", is_rest).withColumn("_nov", is_novel)
    x = x.withColumn("pre", F.lag(order).over(w)).withColumn("post", F.lead(order).over(w)).withColumn("_ok", F.lag("_r").over(w) & ~F.col("_r") & F.lead("_r").over(w)).where("_ok")
    pick = F.struct((~F.coalesce(F.col("_nov"), F.lit(False))).cast("int").alias("a"), F.col(order).alias("b"))
    return x.groupBy(*keys).agg(F.min_by(F.struct("pre", F.col(order).alias("task"), "post"), pick).alias("s")).select(*keys, "s.*")


def experience_level(c: Column) -> Column:
    """1 for "novel", else the first whole number in the text, else null."""
    digits = F.regexp_extract(c.cast("string"), r"(\d+)", 1)
    return F.when(F.lower(c.cast("string")).contains("novel"), 1).when(digits != "", digits.cast("int"))


# motion


def gradient(value: str, t: str, keys: K, order: str | None = None) -> Column:
    """Second-order central difference on uneven samples, one-sided at the ends."""
    w = _w(keys, order or t)
    x, a, b = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    h, k = F.col(t) - F.lag(t).over(w), F.lead(t).over(w) - F.col(t)
    mid = F.try_divide(h * h * b + (k * k - h * h) * x - k * k * a, h * k * (h + k))
    return F.when(a.isNull(), F.try_divide(b - x, k)).when(b.isNull(), F.try_divide(x - a, h)).otherwise(mid)


def speed(rows: DataFrame, axes: Sequence[str], t: str = "t", keys: K = ("session",)) -> DataFrame:
    """Adds v_<axis> and ``speed``."""
    for a in axes:
        rows = rows.withColumn(f"v_{a}", gradient(a, t, keys))
    return rows.withColumn("speed", F.sqrt(sum((F.col(f"v_{a}") * F.col(f"v_{a}") for a in axes[1:]), F.col(f"v_{axes[0]}") * F.col(f"v_{axes[0]}"))))


def drop_jumps(rows: DataFrame, limit: float, t: str = "t", keys: K = ("session",)) -> DataFrame:
    """x and y become null on the first sample of each run that moves faster than the limit."""
    w = _w(keys, t)
    d = lambda c: F.col(c) - F.lag(c).over(w)
    v = F.try_divide(F.sqrt(d("x") * d("x") + d("y") * d("y")), d(t))
    x = rows.withColumn("_v", v).withColumn("_p", F.lag("_v").over(w))
    bad = F.coalesce((F.col("_v") > limit) & ~F.coalesce(F.col("_p") > limit, F.lit(False)), F.lit(False))
    return x.withColumn("_bad", bad).withColumn("x", F.when(~F.col("_bad"), F.col("x"))).withColumn("y", F.when(~F.col("_bad"), F.col("y"))).drop("_v", "_p", "_bad")


def linearize_pca(rows: DataFrame, keys: K = ("session",)) -> DataFrame:
    """x and y turned on their principal axes, the first one from zero, as ``lin`` and ``across``: closed form of a 2 x 2 covariance."""
    m = rows.groupBy(*keys).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.var_pop("x").alias("_a"), F.var_pop("y").alias("_c"), F.covar_pop("x", "y").alias("_b"))
    x = rows.join(m, list(keys)) if keys else rows.join(F.broadcast(m), F.lit(True))  # one row
    angle = 0.5 * F.atan2(2 * F.col("_b"), F.col("_a") - F.col("_c"))
    dx, dy = F.col("x") - F.col("_mx"), F.col("y") - F.col("_my")
    x = x.withColumn("lin", dx * F.cos(angle) + dy * F.sin(angle)).withColumn("across", -dx * F.sin(angle) + dy * F.cos(angle))
    low = x.groupBy(*keys).agg(F.min("lin").alias("_l"))
    x = (x.join(low, list(keys)) if keys else x.join(F.broadcast(low), F.lit(True))).withColumn("lin", F.col("lin") - F.col("_l"))
    return x.drop("_mx", "_my", "_a", "_b", "_c", "_l")


def linearize_circle(rows: DataFrame, keys: K = ("session",)) -> DataFrame:
    """theta in [0, 2 pi) about the mid-range centre, and ``lin`` = theta times the mean distance."""
    m = rows.groupBy(*keys).agg(((F.min("x") + F.max("x")) / 2).alias("_cx"), ((F.min("y") + F.max("y")) / 2).alias("_cy"))
    x = rows.join(m, list(keys)) if keys else rows.join(F.broadcast(m), F.lit(True))
    x = x.withColumn("theta", F.pmod(F.atan2(F.col("y") - F.col("_cy"), F.col("x") - F.col("_cx")), F.lit(6.283185307179586)))
    x = x.withColumn("_d", F.hypot(F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy")))
    r = x.groupBy(*keys).agg(F.avg("_d").alias("radius"))
    x = x.join(r, list(keys)) if keys else x.join(F.broadcast(r), F.lit(True))
    return x.withColumn("lin", F.col("theta") * F.col("radius")).drop("_cx", "_cy", "_d")


def enter_exit(rows: DataFrame, inside: Column, order: str, keys: K = ("session",)) -> DataFrame:
    """Adds ``step``: 1 where a target is entered, -1 where it is left, else 0 (the first row too)."""
    x = rows.withColumn("_in", inside.cast("int"))
    return x.withColumn("step", F.col("_in") - F.coalesce(F.lag("_in").over(_w(keys, order)), F.col("_in"))).drop("_in")


def shift_enters(rows: DataFrame, order: str, keys: K = ("session",)) -> DataFrame:
    """Entries move one row earlier."""
    nxt = F.coalesce(F.lead("step").over(_w(keys, order)), F.lit(0))
    return rows.withColumn("step", F.when(nxt == 1, 1).when(F.col("step") == 1, 0).otherwise(F.col("step")))


def segment_path(rows: DataFrame, wells: Sequence[tuple[int, float, float]], radius: float, order: str = "t", keys: K = ("session",)) -> DataFrame:
    """(keys, start, stop, duration, distance, from_well, to_well) of runs outside all wells."""
    w = _w(keys, order)
    near = F.coalesce(*[F.when(F.hypot(F.col("x") - a, F.col("y") - b) < radius, F.lit(i)) for i, a, b in wells])
    x = rows.withColumn("_well", near)
    x = x.withColumn("_d", F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0)))
    x = x.withColumn("_from", F.last("_well", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy(*keys).orderBy(F.desc(order))  # from the end: a frame up to the last row would be read anew for every row
    x = x.withColumn("_to", F.last("_well", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("_i", F.row_number().over(w)).where(F.col("_well").isNull())
    x = x.withColumn("_g", F.col("_i") - F.row_number().over(w))
    g = x.groupBy(*keys, "_g").agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.sum("_d").alias("distance"), F.first("_from").alias("from_well"), F.first("_to").alias("to_well")).drop("_g")
    return g.withColumn("duration", F.col("stop") - F.col("start"))


def score_alternation(segments: DataFrame, centre: int, least: float, keys: K = ("session",)) -> DataFrame:
    """Segments of some length between known wells with ``task`` (Inbound, Outbound) and ``is_correct``.

    Inbound segments start at an outer well and are right if they end at the
    centre; outbound ones start there and are right if they end at the outer
    well that was not visited last.
    """
    x = segments.where((F.col("distance") > least) & F.col("from_well").isNotNull() & F.col("to_well").isNotNull())
    outer = F.when(F.col("to_well") != centre, F.col("to_well"))
    last = F.last(outer, ignorenulls=True).over(_w(keys, "start").rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("last_outer", last).withColumn("task", F.when(F.col("from_well") == centre, "Outbound").otherwise("Inbound"))
    right = F.when(F.col("task") == "Inbound", F.col("to_well") == centre).otherwise((F.col("to_well") != centre) & F.coalesce(F.col("to_well") != F.col("last_outer"), F.lit(True)))
    return x.withColumn("is_correct", right)


def good_laps(rows: DataFrame, laps: DataFrame, lo: float, step: float, n: int, most_empty: float, width: float, lin: str = "lin") -> DataFrame:
    """Laps (lap_id, start, stop) whose share of empty bins is at most ``most_empty``."""
    from .grid import histogram_bin
    from .joins import range_join

    e = laps.select("lap_id", F.col("start").alias("_lo"), F.col("stop").alias("_hi"))
    got = range_join(rows, e, "t", "_lo", "_hi", width).withColumn("_b", histogram_bin(lin, lo, step, n)).where("_b is not null")
    seen = got.groupBy("lap_id").agg(F.countDistinct("_b").alias("_n"))
    return laps.join(seen.where((1 - F.col("_n") / n) <= most_empty).select("lap_id"), "lap_id")


def project_to_track(rows: DataFrame, segments: DataFrame, key: str = "i") -> DataFrame:
    """Rows with ``segment``, ``lin``, ``px`` and ``py`` of the nearest of the track's segments (segment, x0, y0, x1, y1, before).

    A track is a few dozen segments, checked to be at most 1,000: they are
    written into the plan, so rows neither meet another table nor move. Rows
    without coordinates get nulls.
    """
    if segments.limit(1_001).count() > 1_000:
        raise ValueError("a track has at most 1,000 segments")
    of = [tuple(r[c] for c in ("segment", "x0", "y0", "x1", "y1", "before")) for r in segments.collect()]
    fields = []
    for seg, x0, y0, x1, y1, before in of:
        dx, dy, d2 = x1 - x0, y1 - y0, (x1 - x0) ** 2 + (y1 - y0) ** 2
        s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - x0) * dx + (F.col("y") - y0) * dy) / d2)) if d2 else F.lit(0.0)
        px, py = F.lit(float(x0)) + s * dx, F.lit(float(y0)) + s * dy
        fields.append(F.struct(F.hypot(F.col("x") - px, F.col("y") - py).alias("d"), F.lit(seg).cast(segments.schema["segment"].dataType).alias("segment"), (F.lit(float(before)) + s * math.hypot(dx, dy)).alias("lin"), px.alias("px"), py.alias("py")))
    best = F.array_min(F.array(*fields))
    on = F.col("x").isNotNull() & F.col("y").isNotNull()
    return rows.withColumn("_b", F.when(on, best)).select(*rows.columns, "_b.segment", "_b.lin", "_b.px", "_b.py")

