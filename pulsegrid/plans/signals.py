"""Signals made from the driver's tables by formula, so that what an operator should find is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.batch import staged
from .fixtures import table

FS = 1000.0
#: Events of a nation's session stand this far apart, the first at one second.
APART = 0.5
#: Samples that one row unfolds to.
RUN = 1 << 16


def noise(*of: str | Column, size: float = 0.1) -> Column:
    return (F.pmod(F.xxhash64(*of), F.lit(1_000_000)) / 1e6 - 0.5) * size


def samples(spark: SparkSession, sf: str, fs: float = FS, channels: int = 1, tail: float = 1.0) -> DataFrame:
    """(session, channel, sample_idx, t, nth, d): a session for each nation, as long as it has suppliers; ``d`` is the time from the nth supplier's event, the nearest.

    Sessions unfold in runs that are dealt to all tasks, and the samples are
    written once: what is joined with them must not be planned by the size of
    the suppliers that they come from, as a plan would then broadcast them.
    """
    n = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("session")).agg(F.count(F.lit(1)).alias("_n"))
    last = ((F.col("_n") * APART + 0.5 + tail) * fs).cast("long")
    run = n.withColumn("_last", last).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / RUN))))
    run = run.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "session", "_k")
    of = F.sequence(F.col("_k") * RUN, F.least(F.col("_last"), F.col("_k") * RUN + (RUN - 1)))
    x = run.withColumn("sample_idx", F.explode(of)).withColumn("channel", F.explode(F.array(*[F.lit(c) for c in range(channels)]))).drop("_last", "_k")
    x = x.withColumn("t", F.col("sample_idx") / fs)
    nth = F.least(F.greatest(F.round((F.col("t") - 1.0) / APART).cast("int"), F.lit(0)), (F.col("_n") - 1).cast("int"))
    return staged(x.withColumn("nth", nth).withColumn("d", F.col("t") - 1.0 - F.col("nth") * APART).drop("_n"), "samples")


def bell(d: Column, width: float) -> Column:
    return F.exp(-d * d / (2 * width * width))


def tone(hz: Column | float) -> Column:
    return F.sin(2 * F.pi() * hz * F.col("t"))


#: The events of those sessions in SQL.
SQL_EVENTS = "evs AS (SELECT s_nationkey AS session, s_suppkey AS id, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INTEGER AS nth, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)"
