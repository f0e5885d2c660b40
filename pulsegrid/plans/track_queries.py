"""Queries on positions along a track: the most likely path of a hidden Markov model, its tuning, and the nearest bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..catalog import query
from ..operators import linearize as li
from .fixtures import table

#: A stem and two arms; 9 bins a segment, 5 apart.
MAZE = [(0, 0.0, 0.0, 40.0, 0.0), (1, 40.0, 0.0, 80.0, 0.0), (2, 40.0, 0.0, 40.0, 40.0)]
BINS, SPREAD, STAY = 9, 4.0, 4.0


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """(session, nth, t, x, y): a supplier's line items in order stand along runs out and back, to either arm in turn, off the track by quantity and discount."""
    li_ = table(spark, sf, "lineitem")
    raw = li_.groupBy(F.col("l_suppkey").alias("session"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("i")).agg(F.min("l_quantity").alias("q"), F.round(F.min("l_discount") * 100).alias("d"))
    x = raw.withColumn("nth", F.row_number().over(Window.partitionBy("session").orderBy("i")).cast("long") - 1)
    s = F.least(F.pmod("nth", F.lit(160)), 160 - F.pmod("nth", F.lit(160)))
    arm = F.pmod(F.floor(F.col("nth") / 160), F.lit(2)) == 1
    off = (F.col("q") - 25) / 8
    on_x, on_y = F.when(arm & (s > 40), F.lit(40)).otherwise(s), F.when(arm & (s > 40), s - 40).otherwise(F.lit(0))
    return x.select("session", "nth", (F.col("nth") / 10).alias("t"), (on_x + off).cast("double").alias("x"), (on_y + F.col("d") - 5).cast("double").alias("y"))


_RUNS = """raw AS (SELECT l_suppkey AS session, l_orderkey * 8 + l_linenumber AS i, min(l_quantity) AS q, round(min(l_discount) * 100) AS d FROM lineitem GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY i) - 1 AS nth FROM raw),
along AS (SELECT *, least(nth % 160, 160 - nth % 160) AS s, (nth // 160) % 2 = 1 AS arm FROM ranked),
pos AS MATERIALIZED (SELECT session, nth, nth / 10.0 AS t, (CASE WHEN arm AND s > 40 THEN 40 ELSE s END + (q - 25) / 8)::DOUBLE AS x, (CASE WHEN arm AND s > 40 THEN s - 40 ELSE 0 END + d - 5)::DOUBLE AS y FROM along),
st AS MATERIALIZED (SELECT j, j // 9 AS g, CASE WHEN j // 9 = 2 THEN 40 ELSE (j // 9) * 40 + (j % 9) * 5 END::DOUBLE AS x, CASE WHEN j // 9 = 2 THEN (j % 9) * 5 ELSE 0 END::DOUBLE AS y, (j // 9) * 40.0 + (j % 9) * 5.0 AS lin FROM (SELECT unnest(range(27))::INTEGER AS j))"""

_VITERBI = f"""WITH RECURSIVE {_RUNS},
may AS (SELECT a.j AS i, b.j AS j, CASE WHEN a.g = b.g THEN 0.0 ELSE ln(0.5) END - ((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 32.0 AS p FROM st a, st b
  WHERE CASE WHEN a.g = b.g THEN abs(a.j - b.j) <= 3 ELSE b.j % 9 < 5 OR b.j % 9 >= 4 END),
tr AS MATERIALIZED (SELECT i, j, floor((p - m - ln(sum(exp(p - m)) OVER (PARTITION BY i))) * 65536 + 0.5)::BIGINT AS c FROM (SELECT *, max(p) OVER (PARTITION BY i) AS m FROM may)),
em AS MATERIALIZED (SELECT session, nth, st.j, floor(-((pos.x - st.x) ** 2 + (pos.y - st.y) ** 2) / 32.0 * 65536 + 0.5)::BIGINT AS e FROM pos, st),
v AS (SELECT session, nth, j, e - max(e) OVER (PARTITION BY session) AS s, -1 AS back FROM em WHERE nth = 0
  UNION ALL SELECT session, nth, j, greatest(s - max(s) OVER (PARTITION BY session), -68719476736), back FROM (
    SELECT em.session, em.nth, em.j, b.s + em.e AS s, -b.i AS back FROM (SELECT v.session, v.nth + 1 AS nth, tr.j, max({{'s': v.s + tr.c, 'i': -tr.i}}) AS b FROM v JOIN tr ON tr.i = v.j GROUP BY ALL) JOIN em USING (session, nth, j))),
bk AS MATERIALIZED (SELECT session, nth, list(back ORDER BY j) AS back, -(max({{'s': s, 'j': -j}})).j AS best FROM v GROUP BY ALL),
p AS (SELECT session, nth, best AS j, back[best + 1] AS back FROM bk JOIN (SELECT session, max(nth) AS nth FROM bk GROUP BY 1) USING (session, nth)
  UNION ALL SELECT bk.session, bk.nth, p.back, bk.back[p.back + 1] FROM p JOIN bk ON bk.session = p.session AND bk.nth = p.nth - 1)
SELECT session, nth, g::INTEGER AS segment, lin::DOUBLE AS lin, st.x AS x_on, st.y AS y_on FROM p JOIN st USING (j)"""


@query(_VITERBI)
def track_path(spark, sf):
    got = li.track_path(runs(spark, sf), MAZE, per_segment=BINS, spread=SPREAD, stay=STAY, block=20.0, margin=3.0)
    return got.select("session", "nth", "segment", "lin", "x_on", "y_on")


@query(f"""WITH {_RUNS}, off AS (SELECT *, sqrt(least((x - least(greatest(x, 0), 80)) ** 2 + y ** 2, (x - 40) ** 2 + (y - least(greatest(y, 0), 40)) ** 2)) AS o FROM pos),
g AS (SELECT session, count(*) AS n, (stddev_pop(x) + stddev_pop(y)) / 2 AS deviation, sqrt(avg(o * o)) AS off_track FROM off GROUP BY session)
SELECT session, n, round(deviation, 6) AS deviation, round(off_track, 6) AS off_track, least(60, greatest(30, n // 80))::INTEGER AS per_segment,
  CASE WHEN deviation < 1 THEN 3.0 WHEN deviation < 3 THEN 5.0 WHEN deviation < 8 THEN 8.0 ELSE 12.0 END::DOUBLE AS spread, 1.5::DOUBLE AS stay FROM g""")
def track_tuning(spark, sf):
    got = li.tune(runs(spark, sf), MAZE)
    return got.withColumns({"deviation": F.round("deviation", 6), "off_track": F.round("off_track", 6)})


@query(f"""WITH {_RUNS}, near AS (SELECT session, nth, min({{'d': (pos.x - st.x) ** 2 + (pos.y - st.y) ** 2, 'j': j}}).j AS j FROM pos, st GROUP BY ALL),
around AS (SELECT a.session, a.nth, b.j, count(*) AS n FROM near a JOIN near b ON a.session = b.session AND b.nth BETWEEN a.nth - 2 AND a.nth + 2 GROUP BY ALL)
SELECT session, nth, g::INTEGER AS segment, lin::DOUBLE AS lin FROM (SELECT session, nth, -(max({{'n': n, 'j': -j}})).j AS j FROM around GROUP BY ALL) JOIN st USING (j)""")
def track_nearest_bins(spark, sf):
    return li.nearest_states(runs(spark, sf), MAZE, per_segment=BINS).select("session", "nth", "segment", "lin")
