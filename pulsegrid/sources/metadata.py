"""Selections and small transformations of session metadata tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def select_units(units: DataFrame, filters: Mapping[str, Sequence[str]], bad: str | None = None) -> DataFrame:
    """Units whose columns match: patterns of one column are alternatives, columns must all match; ``bad`` names a flag to leave out."""
    for column, patterns in filters.items():
        if patterns:
            hit = F.lit(False)
            for p in patterns:
                hit = hit | F.coalesce(F.col(column).rlike(p), F.lit(False))
            units = units.where(hit)
    return units.where(~F.coalesce(F.col(bad), F.lit(False))) if bad else units


def drop_unstable(points: DataFrame, width: float, lo: float, hi: float, least_active: int = 2, most_empty: int = 1, unit: str = "unit") -> DataFrame:
    """Points of units that are active in enough of the windows of ``width`` and empty in few."""
    n = int((hi - lo) // width)
    active = points.where((F.col("t") >= lo) & (F.col("t") < lo + n * width)).groupBy(unit).agg(F.countDistinct(F.floor((F.col("t") - lo) / width)).alias("_a"))
    ok = active.where((F.col("_a") >= least_active) & (n - F.col("_a") <= most_empty)).select(unit)
    return points.join(ok, unit, "left_semi")


def add_manual_events(events: DataFrame, peaks: DataFrame) -> DataFrame:
    """Events with more of the given peaks, as long as the mean event and centred on them."""
    mean = events.select(F.avg(F.col("stop") - F.col("start")).alias("_d"))
    extra = peaks.join(F.broadcast(mean), F.lit(True)).select((F.col("peak") - F.col("_d") / 2).alias("start"), (F.col("peak") + F.col("_d") / 2).alias("stop"), "peak")  # one row
    return events.unionByName(extra, allowMissingColumns=True)


def drop_flagged(events: DataFrame, flagged: DataFrame, order: str = "start", key: Sequence[str] = ("session",)) -> DataFrame:
    """Events without those whose 1-based place in their session is listed in (session, nth)."""
    n = events.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(order)))
    return n.join(flagged, [*key, "nth"], "left_anti").drop("nth")


def brain_regions(channels: DataFrame, regions: DataFrame) -> DataFrame:
    """(channel, shank, region) from (region, channels array); channels of no region are Unknown."""
    r = regions.select("region", F.explode("channels").alias("channel"))
    return channels.join(r, "channel", "left").withColumn("region", F.coalesce("region", F.lit("Unknown")))


def first_tag(tags: Column, names: Sequence[str]) -> Column:
    """0-based first channel of the first tag that is there, in a map of tag to 1-based channels."""
    return F.coalesce(*[F.try_element_at(tags, F.lit(n))[0] for n in names]) - 1


def polarity_reversal(channels: DataFrame, shank: str = "shank", cls: str = "cls") -> DataFrame:
    """Adds ``reversal``: a shank with exactly two classes of channels."""
    n = F.size(F.collect_set(cls).over(Window.partitionBy(shank)))
    return channels.withColumn("reversal", n == 2)


def label_behaviour(position: DataFrame, epochs: DataFrame, width: float, label: str, by: str = "epoch_id", keys: Sequence[str] = ()) -> DataFrame:
    """Samples with the label of the last closed epoch that holds them; with ``keys``, of the epochs of their own keys."""
    from ..operators.joins import range_join

    e = epochs.select(*keys, F.col("start").alias("_lo"), F.col("stop").alias("_hi"), F.col(by).alias("_id"), F.col(label).alias("_l"))
    got = range_join(position.select(*keys, "t").distinct(), e, "t", "_lo", "_hi", width, keys)
    names = {c: f"_at_{c}" for c in (*keys, "t")}
    got = got.groupBy(*[F.col(c).alias(n) for c, n in names.items()]).agg(F.max_by("_l", "_id").alias("_label"))
    same = F.lit(True)
    for c, n in names.items():
        same &= F.col(c) == F.col(n)
    return position.join(got, same, "left").select(*position.columns, F.col("_label").alias(label))
