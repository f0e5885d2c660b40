"""How the driver's tables stand in for points, epochs, signals and matrices; each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DAY = 86400.0
#: Seconds since the start of the events' month.
T = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 1e6"
SQL_T = "date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6"
EV = f"ev AS (SELECT event_id, user_id AS unit, event_type AS kind, value, {SQL_T} AS t FROM events)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(x: str, digits: int) -> Column:
    """A double rounded by arithmetic, as DuckDB rounds it; Spark's own goes by decimal digits, which costs more than all else that is done for a pair."""
    c, k = F.col(x), 10.0**digits
    return F.signum(c) * F.floor(F.abs(c) * k + 0.5) / k + F.lit(0.0)


def ev(spark: SparkSession, sf: str) -> DataFrame:
    """event_id, unit, kind, value, t"""
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("unit"), F.col("event_type").alias("kind"), "value", F.expr(T).alias("t"))


def spikes(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    e = ev(spark, sf)
    return (e.where(F.col("kind").isin(*kinds)) if kinds else e).select("unit", "t")


def refs(spark: SparkSession, sf: str, kind: str, *keys: str) -> DataFrame:
    return ev(spark, sf).where(F.col("kind") == kind).select(*keys, F.col("event_id").alias("ref_id"), F.col("t").alias("r"))


def epochs(spark: SparkSession, sf: str, kind: str, length: float, *keys: str) -> DataFrame:
    return ev(spark, sf).where(F.col("kind") == kind).select(*keys, F.col("event_id").alias("epoch_id"), F.col("t").alias("start"), (F.col("t") + length).alias("stop"))


def sql_epochs(kind: str, length: float, name: str = "ep") -> str:
    return f"{name} AS (SELECT unit, event_id AS epoch_id, t AS start, t + {length} AS stop FROM ev WHERE kind = '{kind}')"


def days(spark: SparkSession, n: int = 30) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("epoch_id"), (F.col("id") * DAY).alias("start"), ((F.col("id") + 1) * DAY).alias("stop"))


SQL_DAYS = "days AS (SELECT i::INTEGER AS epoch_id, i * 86400.0::DOUBLE AS start, (i + 1) * 86400.0::DOUBLE AS stop FROM range(30) r(i))"


def position(spark: SparkSession, sf: str) -> DataFrame:
    """x, y, z by session (order key modulo 64) and order within it; line items of one key and number count once, by their least values."""
    li = table(spark, sf, "lineitem")
    i = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return li.groupBy((F.col("l_orderkey") % 64).alias("session"), i.alias("i")).agg(F.min("l_quantity").alias("x"), (F.min("l_discount") * 100).alias("y"), F.min("l_extendedprice").alias("z"))


POS = "pos AS (SELECT l_orderkey % 64 AS session, l_orderkey * 8 + l_linenumber AS i, min(l_quantity) AS x, min(l_discount) * 100 AS y, min(l_extendedprice) AS z FROM lineitem GROUP BY 1, 2)"
