"""Tracking of sessions that is read from their behaviour files, worked on by Spark, and written back into them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import linearize as li, sequences as sq
from . import mat_sink, session_metadata as sm
from .batch import staged
from .session_files import parse_mat

NAME = "animal.behavior.mat"
#: Tags that name a detector's channel, in order of preference.
ROLES = {
    "ripple": ("ripple", "Ripple", "CA1sp", "ca1sp"),
    "sharp_wave": ("SharpWave", "sharpwave", "sharp_wave", "CA1sr", "ca1sr"),
    "noise": ("Bad", "bad"),
}


def samples(spark: SparkSession, root: str, extra: Sequence[str] = ()) -> DataFrame:
    """(session, i, t, x, y, z, linearized, extra) of all behaviour files below a folder, a row a sample; null where a file has no number.

    Variables are taken from ``position`` or from the structure itself if they
    have a value for each sample; every file is read once, by one task.
    """
    names = list(dict.fromkeys(["x", "y", "z", "linearized", *extra]))

    def read(frames):
        for f in frames:
            held, size = [], 0
            for s, c in zip(f["session"], f["content"], strict=True):
                b = parse_mat(bytes(c)).get("behavior", {})
                t = np.asarray(b.get("timestamps", ()), float).ravel()
                place = b.get("position") if isinstance(b.get("position"), dict) else {}
                out = [np.full(len(t), s, object), np.arange(len(t)), t]
                for n in names:
                    v = place.get(n, b.get(n))
                    v = np.asarray(v, float).ravel() if isinstance(v, np.ndarray) else np.zeros(0)
                    out.append(v if len(v) == len(t) else np.full(len(t), np.nan))
                held.append(out)
                size += len(t)
                if size > 100_000:
                    yield from frames_of(held)
                    held, size = [], 0
            if held:
                yield from frames_of(held)

    def frames_of(held):
        out = pd.DataFrame(dict(zip(["session", "i", "t", *names], map(np.concatenate, zip(*held)))))
        for at in range(0, len(out), 100_000):
            yield out.iloc[at : at + 100_000]

    got = mat_sink.session_files(spark, root, NAME).select("session", "content").mapInPandas(read, ", ".join(["session string", "i long", "t double"] + [f"`{n}` double" for n in names]))
    return got.select("session", "i", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("t", *names)])


def epochs(spark: SparkSession, root: str) -> DataFrame:
    """(session, epoch_id, start, stop, environment, ...) of all session files below a folder."""
    return sm.session_epochs(sm.structs(mat_sink.session_files(spark, root, "session.mat").select(F.concat(F.lit("/"), "path").alias("path"), "content"), "session"))


def _inside(x: DataFrame, spans: DataFrame | None, interval: tuple[float, float] | None) -> DataFrame:
    """Samples with ``_in``: between the bounds of their session's span, or of one interval; all of them if neither is given."""
    if spans is not None:
        s = spans.groupBy("session").agg(F.min("start").alias("_lo"), F.max("stop").alias("_hi"))
        return x.join(s, "session", "left").withColumn("_in", F.coalesce((F.col("t") >= F.col("_lo")) & (F.col("t") <= F.col("_hi")), F.lit(False))).drop("_lo", "_hi")
    return x.withColumn("_in", F.lit(True) if interval is None else F.col("t").between(*interval))


def _kept(x: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(session, i, columns): new values of the samples that were worked on, old ones of the others."""
    n = new.select("session", "i", *[F.col(c).cast("double").alias(f"_{c}") for c in columns], F.lit(True).alias("_new"))
    both = x.hint("merge").join(n, ["session", "i"], "left")  # samples on both sides, however small their staged files are
    return both.select("session", "i", *[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def filter_jumps(spark: SparkSession, root: str, limit: float = 150.0, spans: DataFrame | None = None, interval: tuple[float, float] | None = None) -> None:
    """Take samples that a jump of the tracker reached out of all files: x and y become NaN where they move faster than the limit.

    ``spans`` (session, start, stop) or an interval narrows it to some time.
    """
    x = staged(_inside(samples(spark, root), spans, interval), "tracking")
    new = sq.drop_jumps(x.where("_in"), limit)
    mat_sink.update_behavior(spark, root, _kept(x, new, ["x", "y"]), {"x": ["behavior", "position", "x"], "y": ["behavior", "position", "y"]})


def linearize_track(spark: SparkSession, root: str, segments: Sequence[li.Segment], spans: DataFrame | None = None, interval: tuple[float, float] | None = None, tuned: bool = False, **how) -> None:
    """Write position along the track, its segment and the place on it into all files, by the hidden Markov model of :func:`.linearize.track_path`."""
    at = ["linearized", "states", "projected_x", "projected_y"]
    x = staged(_inside(samples(spark, root, at), spans, interval), "tracking")
    some = x.where("_in").select("session", "i", "t", "x", "y")
    got = li.track_path(some, segments, tuned=li.tune(some, segments) if tuned else None, **how)
    new = got.select("session", "i", F.col("lin").alias("linearized"), F.col("segment").alias("states"), F.col("x_on").alias("projected_x"), F.col("y_on").alias("projected_y"))
    mat_sink.update_behavior(spark, root, _kept(x, new, at), {c: ["behavior", "states"] if c == "states" else ["behavior", "position", c] for c in at})


def circles(rows: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """(keys, center_x, center_y, radius): the circle about the middle of the samples' range, as far away as they are on average."""
    c = rows.groupBy(*keys).agg(((F.min("x") + F.max("x")) / 2).alias("center_x"), ((F.min("y") + F.max("y")) / 2).alias("center_y"))
    r = rows.hint("merge").join(c, list(keys)).groupBy(*keys, "center_x", "center_y").agg(F.avg(F.hypot(F.col("x") - F.col("center_x"), F.col("y") - F.col("center_y"))).alias("radius"))
    return r.select(*keys, "center_x", "center_y", "radius")


def linearize_circle(spark: SparkSession, root: str, spans: DataFrame | None = None, interval: tuple[float, float] | None = None, given: DataFrame | None = None) -> DataFrame:
    """Write angle, position along the circle and centred coordinates into all files, and the circle into their structure; the circles come back.

    The circle is fitted to each session's samples or ``given`` (session,
    center_x, center_y, radius). The file keeps it as behavior.circle_params.
    """
    at = ["linearized", "theta", "x_centered", "y_centered"]
    x = staged(_inside(samples(spark, root, at), spans, interval), "tracking")
    some = x.where("_in").select("session", "i", "x", "y")  # a plan takes them for small by the size of their files, hence the hints
    c = circles(some) if given is None else given
    dx, dy = F.col("x") - F.col("center_x"), F.col("y") - F.col("center_y")
    theta = F.pmod(F.atan2(dy, dx), F.lit(6.283185307179586))
    new = some.hint("merge").join(c, "session").select("session", "i", (theta * F.col("radius")).alias("linearized"), theta.alias("theta"), dx.alias("x_centered"), dy.alias("y_centered"))
    told = ["center_x", "center_y", "radius"]
    c = staged(c.select("session", *told), "circles")
    mat_sink.update_behavior(spark, root, _kept(x, new, at), {k: ["behavior", "position", k] for k in at})
    mat_sink.update_behavior(spark, root, c.withColumn("i", F.lit(0)), {k: ["behavior", "circle_params", k] for k in told})
    return c


def channel_roles(sessions: DataFrame) -> DataFrame:
    """(session, ripple, sharp_wave, noise): channels from 0 that the channel tags of each session (session, data) name for a detector; null where none does."""
    tags = F.transform_values(sm._fields(sm._get("channelTags")), lambda k, t: sm._numbers(F.get_json_object(t, "$.channels")))
    x = sessions.select("session", tags.alias("_tags"))
    first = lambda names: F.coalesce(*[F.try_element_at(F.try_element_at("_tags", F.lit(n)), F.lit(1)) for n in names])
    return x.select("session", *[(first(names) - 1).cast("int").alias(role) for role, names in ROLES.items()])


def with_roles(signal: DataFrame, roles: DataFrame) -> DataFrame:
    """Samples (session, channel, ...) of the channels that have a role, with the role; a channel with two roles comes twice."""
    each = roles.select("session", F.explode(F.map_entries(F.create_map(*[v for r in ROLES for v in (F.lit(r), F.col(r))]))).alias("e")).select("session", F.col("e.key").alias("role"), F.col("e.value").alias("channel")).where("channel is not null")
    return signal.join(each, ["session", "channel"])


