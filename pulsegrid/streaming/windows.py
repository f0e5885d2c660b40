"""Streaming forms of binning, merging and counting around events, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def binned_counts(points: DataFrame, width: str, late: str, keys: tuple[str, ...] = ("unit",), slide: str | None = None) -> DataFrame:
    """(keys, start, stop, n) in tumbling, or with ``slide`` sliding, windows of the column ``ts``."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = points.withWatermark("ts", late).groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def merged_runs(points: DataFrame, gap: str, late: str, keys: tuple[str, ...] = ("unit",)) -> DataFrame:
    """(keys, start, stop, n): rows whose pauses stay below the gap make one run (session windows)."""
    g = points.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("stop"))
    return g.select(*keys, F.col("w.start").alias("start"), "stop", "n")


def around(points: DataFrame, refs: DataFrame, before: float, after: float, late: str) -> DataFrame:
    """Stream-stream join of points (ts, ...) with references (ref_ts, ref_id) whose window, in seconds, holds them.

    The equality that such a join needs is the time bucket, as in the batch
    form; its state is bounded by the watermarks and the range of times.
    """
    width = max(before + after, 1e-3)
    sec = lambda c: F.col(c).cast("double")
    p = points.withWatermark("ts", late).withColumn("_b", F.floor(sec("ts") / width))
    r = refs.withWatermark("ref_ts", late).withColumn("_rb", F.explode(F.sequence(F.floor((sec("ref_ts") - before) / width), F.floor((sec("ref_ts") + after) / width))))
    held = F.expr(f"ts >= ref_ts - INTERVAL '{before}' SECOND AND ts <= ref_ts + INTERVAL '{after}' SECOND")
    return p.join(r, (F.col("_b") == F.col("_rb")) & held).withColumn("lag", sec("ts") - sec("ref_ts")).drop("_b", "_rb")


def drop_repeats(points: DataFrame, key: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return points.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
