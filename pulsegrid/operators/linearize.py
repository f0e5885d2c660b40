"""Positions on a track by a hidden Markov model, in blocks of time that meet exactly.

States are bins of the track's segments. The most likely path of a session is
found in parallel: every block of time also runs over a margin before it, from
a flat start, and over a margin behind it. Where the scores at its start are
those that the block before ends with, and all paths from the end of the
margin behind it come from one state at its end, the block's path is the one
that a single pass over the session finds; blocks for which this does not hold
run again with twice the margin, in the end from the session's first sample to
its last. Scores are whole numbers (2**-16 of a natural logarithm), so "the
same" is equality and the answer does not depend on the blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.batch import staged
from .signals import SPREADS, track_scale

Segment = tuple[int, float, float, float, float]
UNIT = 1 << 16
#: A state this far below the best one counts as no worse than that.
FLOOR = -(1 << 20) * UNIT
_NEVER = -(1 << 50)
#: The shares of steps onto another segment, with steps to near bins alone and with all steps; near bins; bins at a segment's ends.
NEAR_SHARE, JOINED_SHARE, APART_SHARE, NEAR, ENDS = 0.5, 0.8, 0.1, 3, 5


class Model(NamedTuple):
    segment: np.ndarray
    lin: np.ndarray
    place: np.ndarray
    before: np.ndarray  # states that a state can be reached from, in rising order
    cost: np.ndarray
    first: np.ndarray  # where the row of a state begins in both of them
    spread: float


def joined(segments: Sequence[Segment]) -> np.ndarray:
    """Which segments share an end."""
    ends = [{(round(s[1], 6), round(s[2], 6)), (round(s[3], 6), round(s[4], 6))} for s in segments]
    return np.array([[bool(a & b) for b in ends] for a in ends])


def log_steps(segments: Sequence[Segment], nth: np.ndarray, place: np.ndarray, stay: float, sparse: bool) -> np.ndarray:
    """Logarithms of the shares of steps from each state (rows) to each; shares fall with the square of the distance."""
    d2 = ((place[:, None] - place[None]) ** 2).sum(2)
    same, touch = nth[:, None] == nth[None], joined(segments)[np.ix_(nth, nth)]
    if sparse:
        i = np.arange(len(nth))
        rank = i - np.searchsorted(nth, nth)
        size = np.bincount(nth)[nth]
        at_end = (rank < ENDS) | (rank >= size - ENDS)
        may = np.where(same, np.abs(i[:, None] - i[None]) <= NEAR, touch & at_end[None])
        share = np.where(same, 1.0, NEAR_SHARE)
    else:
        may = np.ones_like(same)
        share = np.where(same, 1.0, np.where(touch, JOINED_SHARE, APART_SHARE))
    log_p = np.where(may, np.log(share) - d2 / (2 * stay**2), -np.inf)
    top = log_p.max(1, keepdims=True)
    return log_p - top - np.log(np.exp(log_p - top).sum(1, keepdims=True))


@lru_cache(maxsize=8)
def model(segments: tuple[Segment, ...], per_segment: int, spread: float, stay: float, sparse: bool) -> Model:
    s = np.arange(per_segment) / max(1, per_segment - 1)
    ends = np.array([g[1:] for g in segments], float)
    length = np.hypot(ends[:, 2] - ends[:, 0], ends[:, 3] - ends[:, 1])
    place = (ends[:, None, :2] + s[None, :, None] * (ends[:, None, 2:] - ends[:, None, :2])).reshape(-1, 2)
    lin = ((np.cumsum(length) - length)[:, None] + s[None] * length[:, None]).ravel()
    nth = np.repeat(np.arange(len(segments)), per_segment)
    steps = log_steps(segments, nth, place, stay, sparse)
    most = int(np.isfinite(steps).sum(0).max())
    before, cost = np.zeros((len(nth), most), np.int64), np.full((len(nth), most), _NEVER, np.int64)
    for j in range(len(nth)):
        i = np.flatnonzero(np.isfinite(steps[:, j]))
        before[j, : len(i)], cost[j, : len(i)] = i, np.floor(steps[i, j] * UNIT + 0.5)
    return Model(np.array([g[0] for g in segments])[nth], lin, place, before, np.maximum(cost, _NEVER), np.arange(len(nth)) * most, spread)


def scores(m: Model, xy: np.ndarray) -> np.ndarray:
    """Log likelihood of samples (rows) in states."""
    d2 = ((xy[:, None] - m.place[None]) ** 2).sum(2)
    return np.maximum(np.floor(-d2 / (2 * m.spread**2) * UNIT + 0.5), _NEVER).astype(np.int64)


def advance(m: Model, v: np.ndarray | None, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores after a sample, the best at zero, and the states they come from; None before the first sample."""
    if v is None:
        back, v = np.zeros(len(e), np.int64), e
    else:
        c = v.take(m.before)
        c += m.cost
        at = c.argmax(1)
        at += m.first
        back, v = m.before.take(at), c.take(at) + e
    return np.maximum(v - v.max(), FLOOR), back


def path(m: Model, xy: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, bytes, bytes, bool]:
    """States of the samples ``lo`` to ``hi``, the scores before and after them, and whether what follows leaves no choice."""
    v, at_start, at_end = None, b"", b""
    kind = np.int16 if len(m.lin) < 1 << 15 else np.int32
    back = np.zeros((len(xy) - lo, len(m.lin)), kind)
    for begin in range(0, len(xy), 2048):
        for i, e in enumerate(scores(m, xy[begin : begin + 2048]), begin):
            if i == lo and v is not None:
                at_start = v.tobytes()
            v, b = advance(m, v, e)
            if i >= lo:
                back[i - lo] = b
            if i == hi - 1:
                at_end = v.tobytes()
    reach = np.arange(len(m.lin))  # of each state at the end of the margin, the state at the block's end
    for i in range(len(xy) - 1, hi - 1, -1):
        reach = back[i - lo][reach]
    best = int(v.argmax())
    out = np.empty(hi - lo, np.int64)
    out[-1] = reach[best]
    for i in range(hi - 1, lo, -1):
        out[i - 1 - lo] = back[i - lo][out[i - lo]]
    return out, at_start, at_end, bool((reach == reach[0]).all())


def _real() -> Column:
    return F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")


def _run(rows: DataFrame, segments: tuple[Segment, ...], keys: Sequence[str], block: float, sparse: bool, last_round: int) -> DataFrame:
    """Paths of blocks, and a row for each block that says how it meets its neighbours."""
    own = [c for c in rows.columns if c not in ("_block", "_bins", "_spread", "_stay")]
    kinds = dict(rows.dtypes)
    ddl = ", ".join([f"`{c}` {kinds[c]}" for c in own] + ["_block long", "_round int", "_state int", "segment int", "lin double", "x_on double", "y_on double", "_in binary", "_out binary", "_sure boolean"])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["t", "x", "y"], kind="stable").reset_index(drop=True)
        b = int(g["_block"].iloc[0])
        at = np.floor(g["t"].to_numpy(float) / block)
        lo, hi = np.searchsorted(at, b), np.searchsorted(at, b, side="right")
        if lo == hi:
            return pd.DataFrame(columns=[*own, "_block", "_round", "_state", "segment", "lin", "x_on", "y_on", "_in", "_out", "_sure"])
        m = model(segments, int(g["_bins"].iloc[0]), float(g["_spread"].iloc[0]), float(g["_stay"].iloc[0]), sparse)
        states, at_start, at_end, sure = path(m, g[["x", "y"]].to_numpy(float), int(lo), int(hi))
        out = g.iloc[[*range(lo, hi), lo]][own].reset_index(drop=True)  # the last row tells how the block meets its neighbours
        out.loc[hi - lo, "t"] = g["t"].iloc[-1]  # and how far the margin reached
        told = lambda of, x: [None] * len(of) + [x]
        path_of = {"segment": m.segment[states], "lin": m.lin[states], "x_on": m.place[states, 0], "y_on": m.place[states, 1]}
        return out.assign(
            _block=b, _round=last_round, _state=pd.array([*states.tolist(), None], "Int32"), segment=pd.array([*path_of.pop("segment").tolist(), None], "Int32"),
            **{c: np.append(v, np.nan) for c, v in path_of.items()}, _in=told(states, at_start), _out=told(states, at_end), _sure=told(states, sure),
        )

    return rows.groupBy(*keys, "_block").applyInPandas(run, ddl)


def track_path(position: DataFrame, segments: Sequence[Segment], per_segment: int | str = 50, spread: float | str = 5.0, stay: float | str = 1.0, sparse: bool = True, keys: Sequence[str] = ("session",), block: float = 600.0, margin: float = 60.0, tuned: DataFrame | None = None) -> DataFrame:
    """Adds segment, lin, x_on and y_on: the most likely path over bins of the segments.

    ``sparse`` allows steps to the nearest bins of a segment and onto the ends
    of segments that touch; otherwise every step is possible, less so onto
    segments apart. ``tuned`` (:func:`tune`) gives each key its own
    per_segment, spread and stay. Samples without coordinates get null.
    Samples of one time go in order of x and y. A task holds a block and its
    margins; the margins of a block grow only if its path needs it.
    """
    segments = tuple((int(i), float(a), float(b), float(c), float(d)) for i, a, b, c, d in segments)
    real = _real() & F.col("t").isNotNull()
    kept = position.where(real)
    if tuned is None:
        kept = kept.withColumns({"_bins": F.lit(per_segment), "_spread": F.lit(float(spread)), "_stay": F.lit(float(stay))})
    else:
        kept = kept.join(tuned.select(*keys, F.col("per_segment").alias("_bins"), F.col("spread").alias("_spread"), F.col("stay").alias("_stay")), list(keys))
    own = [*keys, "_block"]
    before = Window.partitionBy(*keys).orderBy("_block")
    done, checks, wide, bad = [], None, margin, None
    while True:
        near = F.sequence(F.floor((F.col("t") - wide) / block), F.floor((F.col("t") + wide) / block))
        rows = kept.withColumn("_block", F.explode(near))
        if bad is not None:
            rows = rows.join(bad, own, "left_semi")
        got = staged(_run(rows, segments, keys, block, sparse, len(done)), "track-path")
        done.append(got)
        told = got.where(F.col("_in").isNotNull()).select(*own, "_round", "_in", "_out", "_sure", F.col("t").alias("_seen"))
        checks = staged(told if checks is None else told.unionByName(checks.join(told.select(*own), own, "left_anti")), "track-checks")
        # a row for each block: the first of a key starts from nothing, and a margin that reached the last sample has chosen among all paths
        met = checks.withColumns({"_before": F.coalesce(F.lag("_out").over(before), F.lit(b"")), "_last": F.col("_seen") == F.max("_seen").over(Window.partitionBy(*keys))})
        bad = staged(met.where((F.col("_in") != F.col("_before")) | ~(F.col("_sure") | F.col("_last"))).select(*own), "track-open")
        if bad.isEmpty():
            break
        wide *= 2
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    latest = every.where("_state is not null").join(checks.select(*own, "_round"), [*own, "_round"], "left_semi")
    nothing = {c: F.lit(None).cast(k) for c, k in (("segment", "int"), ("lin", "double"), ("x_on", "double"), ("y_on", "double"))}
    return latest.drop("_block", "_round", "_state", "_in", "_out", "_sure").unionByName(position.where(~real).withColumns(nothing))


def _to_segment(s: Segment) -> Column:
    """Distance of (x, y) to a segment."""
    _, x0, y0, x1, y1 = s
    n2 = (x1 - x0) ** 2 + (y1 - y0) ** 2
    at = F.least(F.greatest(((F.col("x") - x0) * (x1 - x0) + (F.col("y") - y0) * (y1 - y0)) / (n2 or 1.0), F.lit(0.0)), F.lit(1.0))
    return F.hypot(F.col("x") - x0 - at * (x1 - x0), F.col("y") - y0 - at * (y1 - y0))


#: Least and most bins of a segment and samples a bin, for tracks of up to 2, up to 4 and more segments.
BINS = ((2, 20, 40, 100), (4, 30, 60, 80), (float("inf"), 40, 80, 60))


def tune(position: DataFrame, segments: Sequence[Segment], keys: Sequence[str] = ("session",)) -> DataFrame:
    """(keys, n, deviation, off_track, per_segment, spread, stay): parameters of :func:`track_path` that fit each key's samples.

    One aggregate in which partial results merge: the mean deviation of the
    coordinates says how far samples spread, their number how many bins a
    segment can have, and the track's length how far a step goes. ``off_track``
    is the root mean square distance from the track, an estimate of the error
    of tracking by itself.
    """
    off = F.least(*map(_to_segment, segments)) if len(segments) > 1 else _to_segment(segments[0])
    got = position.where(_real()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), ((F.stddev_pop("x") + F.stddev_pop("y")) / 2).alias("deviation"), F.sqrt(F.avg(off * off)).alias("off_track")
    )
    least, most, each = next(b[1:] for b in BINS if len(segments) <= b[0])
    spread = F.lit(SPREADS[-1][1])
    for limit, v in reversed(SPREADS[:-1]):
        spread = F.when(F.col("deviation") < limit, F.lit(v)).otherwise(spread)
    stay = track_scale(segments, 0.0)["stay"]
    return got.withColumns({"per_segment": F.least(F.lit(most), F.greatest(F.lit(least), F.floor(F.col("n") / each))).cast("int"), "spread": spread, "stay": F.lit(stay)})


def nearest_states(position: DataFrame, segments: Sequence[Segment], per_segment: int = 50, around: int = 2, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Adds segment and lin of the bin nearest to each sample, by the vote of ``around`` samples on either side (the smallest of equals).

    The approximation of :func:`track_path` for tracks of very many bins: no
    steps are weighed. Samples without coordinates get null.
    """
    parts = []
    for g, (_, x0, y0, x1, y1) in enumerate(segments):  # bins of a segment are even, so its nearest is a rounding away
        n2 = (x1 - x0) ** 2 + (y1 - y0) ** 2
        s = ((F.col("x") - x0) * (x1 - x0) + (F.col("y") - y0) * (y1 - y0)) / (n2 or 1.0) * (per_segment - 1)
        k = F.least(F.greatest(F.ceil(s - 0.5), F.lit(0)), F.lit(per_segment - 1))
        f = k / max(1, per_segment - 1)
        d2 = F.pow(F.col("x") - x0 - f * (x1 - x0), 2) + F.pow(F.col("y") - y0 - f * (y1 - y0), 2)
        parts.append(F.struct(F.round(d2, 9).alias("d"), (k + g * per_segment).cast("int").alias("s")))
    nearest = F.least(*parts) if len(parts) > 1 else parts[0]
    state = F.lit(None).cast("int")
    x = position.withColumn("_real", _real()).withColumn("_state", F.when(F.col("_real"), nearest["s"]).otherwise(state))
    w = Window.partitionBy(*keys, "_real").orderBy("t", "x", "y").rowsBetween(-around, around)
    seen = F.collect_list("_state").over(w)
    x = x.withColumn("_seen", seen)
    vote = F.array_max(F.transform("_seen", lambda s: F.struct(F.size(F.filter("_seen", lambda r: r == s)).alias("n"), (-s).alias("s"))))
    x = x.withColumn("_state", F.when(F.col("_real"), -vote["s"]))
    length = [float(np.hypot(s[3] - s[1], s[4] - s[2])) for s in segments]
    g = F.floor(F.col("_state") / per_segment).cast("int")
    first = F.element_at(F.array(*[F.lit(float(sum(length[:i]))) for i in range(len(segments))]), g + 1)
    size = F.element_at(F.array(*map(F.lit, length)), g + 1)
    lin = first + F.pmod(F.col("_state"), F.lit(per_segment)) / max(1, per_segment - 1) * size
    return x.withColumns({"segment": F.element_at(F.array(*[F.lit(int(s[0])) for s in segments]), g + 1), "lin": lin}).drop("_state", "_seen", "_real")
