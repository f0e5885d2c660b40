"""Queries around reference events, and correlograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import correlate as co, grid, joins, perievent as pe
from .fixtures import DAY, EV, SQL_DAYS, days, ev, refs, rounded, spikes

_ERR = "r AS (SELECT event_id AS ref_id, t AS r FROM ev WHERE kind = 'error')"
_BIN = "floor((e.t - (r.r - 21/2.0::DOUBLE*90.0::DOUBLE)) / 90.0)"
_HITS = f"h AS (SELECT e.unit, r.ref_id, {_BIN}::INTEGER AS bin FROM ev e JOIN r ON e.t BETWEEN r.r - 945.0 AND r.r + 945.0 WHERE {_BIN} BETWEEN 0 AND 20)"


@query(
    f"""WITH {EV}, {_ERR}, {_HITS}, c AS (SELECT unit, bin, count(*) AS n FROM h GROUP BY ALL)
SELECT u.unit, i::INTEGER AS bin, (i - 10) * 90.0::DOUBLE AS lag, round(coalesce(n, 0) / ((SELECT count(*) FROM r) * 90.0), 9) AS rate FROM (SELECT DISTINCT unit FROM ev) u CROSS JOIN range(21) g(i) LEFT JOIN c ON c.unit = u.unit AND c.bin = i"""
)
def psth(spark, sf):
    return pe.psth(spikes(spark, sf), refs(spark, sf, "error"), 90.0, 20).withColumn("rate", F.round("rate", 9))


@query(
    f"""WITH {EV}, {_ERR}, {_HITS}, c AS (SELECT unit, bin, count(*) AS n FROM h GROUP BY ALL)
SELECT u.unit, i::INTEGER AS bin, (i - 10) * 90.0::DOUBLE AS lag, round(coalesce(n, 0) / ((SELECT count(*) FROM r) * 90.0), 9) AS rate FROM (SELECT DISTINCT unit FROM ev) u CROSS JOIN range(21) g(i) LEFT JOIN c ON c.unit = u.unit AND c.bin = i WHERE i BETWEEN 6 AND 20"""
)
def psth_asymmetric(spark, sf):
    return pe.psth(spikes(spark, sf), refs(spark, sf, "error"), 90.0, 0, window=(-360.0, 900.0)).withColumn("rate", F.round("rate", 9))


@query(f"WITH {EV}, {_ERR}, {_HITS}, c AS (SELECT ref_id, bin, count(*) AS n FROM h GROUP BY ALL) SELECT r.ref_id, i::INTEGER AS bin, coalesce(n, 0) / 90.0::DOUBLE AS rate FROM r CROSS JOIN range(21) g(i) LEFT JOIN c ON c.ref_id = r.ref_id AND c.bin = i")
def peth_matrix(spark, sf):
    return pe.peth_matrix(spikes(spark, sf), refs(spark, sf, "error"), 90.0, 20)


@query(
    f"""WITH {EV}, {_ERR}, {_HITS.replace('e.unit', 'e.kind, e.unit')}, p1 AS (SELECT ref_id, bin, count(*) / 90.0::DOUBLE AS rate FROM h WHERE kind = 'view' GROUP BY ALL), p2 AS (SELECT ref_id, bin, count(*) / 90.0::DOUBLE AS rate FROM h WHERE kind = 'click' GROUP BY ALL),
n AS (SELECT count(*) AS n FROM r), b AS (SELECT i::INTEGER AS b FROM range(21) g(i)), j AS (SELECT p1.bin AS b1, p2.bin AS b2, sum(p1.rate * p2.rate) AS s FROM p1 JOIN p2 USING (ref_id) GROUP BY ALL),
m1 AS (SELECT b AS b1, coalesce(sum(rate), 0) AS m1 FROM b LEFT JOIN p1 ON p1.bin = b GROUP BY b), m2 AS (SELECT b AS b2, coalesce(sum(rate), 0) AS m2 FROM b LEFT JOIN p2 ON p2.bin = b GROUP BY b)
SELECT b1 AS bin_1, b2 AS bin_2, round(sqrt(coalesce(s, 0) / n), 9) AS joint, round(sqrt(m1 * m2) / n, 9) AS expected, round(sqrt(coalesce(s, 0) / n) - sqrt(m1 * m2) / n, 9) AS difference FROM m1 CROSS JOIN m2 LEFT JOIN j USING (b1, b2) CROSS JOIN n"""
)
def joint_peth(spark, sf):
    r = refs(spark, sf, "error")
    got = pe.joint_peth(pe.peth_matrix(spikes(spark, sf, "view"), r, 90.0, 20), pe.peth_matrix(spikes(spark, sf, "click"), r, 90.0, 20))
    return got.select("bin_1", "bin_2", *[F.round(c, 9).alias(c) for c in ("joint", "expected", "difference")])


@query(f"WITH {EV}, {_ERR} SELECT r.ref_id, e.unit, e.t, r.r, round(e.t - r.r, 6) AS lag FROM ev e JOIN r ON e.t > r.r - 300.0 AND e.t < r.r + 300.0")
def raster_points(spark, sf):
    return pe.raster(spikes(spark, sf), refs(spark, sf, "error"), -300.0, 300.0).withColumn("lag", F.round("lag", 6)).select("ref_id", "unit", "t", "r", "lag")


@query(f"WITH {EV}, {_ERR} SELECT e.event_id, e.unit, r.ref_id, round(e.t - r.r, 6) AS lag FROM ev e JOIN r ON e.t BETWEEN r.r - 120.0 AND r.r + 600.0")
def sync(spark, sf):
    got = pe.sync(ev(spark, sf).select("event_id", "unit", "t"), refs(spark, sf, "error"), -120.0, 600.0)
    return got.select("event_id", "unit", "ref_id", F.round("lag", 6).alias("lag"))


@query(
    f"""WITH {EV}, {SQL_DAYS}, c AS (SELECT unit, epoch_id, count(*) AS n FROM ev JOIN days ON t > start AND t < stop GROUP BY ALL)
SELECT u.unit, d.epoch_id, coalesce(n, 0) AS n, (coalesce(n, 0) > 0)::INTEGER AS active, round(coalesce(n, 0) / (stop - start), 12) AS rate FROM (SELECT DISTINCT unit FROM ev) u CROSS JOIN days d LEFT JOIN c USING (unit, epoch_id)"""
)
def count_in_interval(spark, sf):
    return pe.count_in_intervals(spikes(spark, sf), days(spark), DAY).withColumn("rate", F.round("rate", 12))


@query(f"WITH {EV}, {_ERR} SELECT r.ref_id, count(e.t) AS n FROM r LEFT JOIN ev e ON e.t > r.r + 60.0 AND e.t < r.r + 1800.0 GROUP BY r.ref_id")
def count_events(spark, sf):
    return pe.count_events(spikes(spark, sf), refs(spark, sf, "error"), 60.0, 1800.0)


_NEAR = f"""WITH {EV}, p AS (SELECT * FROM ev WHERE kind = 'purchase'), e AS (SELECT * FROM ev WHERE kind = 'error'),
x AS (SELECT p.event_id, p.unit, p.t, (SELECT max(e.t) FROM e WHERE e.unit = p.unit AND e.t <= p.t) AS a, (SELECT min(e.t) FROM e WHERE e.unit = p.unit AND e.t >= p.t) AS b FROM p)
SELECT event_id, unit, t, CASE WHEN a IS NULL OR b - t <= t - a THEN b ELSE a END AS nearest, round(t - CASE WHEN a IS NULL OR b - t <= t - a THEN b ELSE a END, 6) AS delay FROM x"""


@query(_NEAR)
def nearest_event_delay(spark, sf):
    e = ev(spark, sf)
    got = pe.nearest_delay(e.where("kind = 'purchase'").select("event_id", "unit", "t"), e.where("kind = 'error'").select("unit", "t"), ["unit"], 6 * 3600.0)
    return got.withColumn("delay", F.round("delay", 6))


@query(
    f"""WITH {EV}, {_ERR}, h AS (SELECT e.t - r.r AS lag, e.value FROM ev e JOIN r ON e.t > r.r - 450.0 AND e.t < r.r + 450.0)
SELECT i::INTEGER AS bin, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n, -450.0 + (i + 0.5::DOUBLE) * 90.0 AS lag FROM h JOIN range(10) g(i) ON lag >= -450.0 + i * 90.0 AND lag <= -450.0 + i * 90.0 + 90.0 GROUP BY i"""
)
def eta_irregular(spark, sf):
    got = pe.average_irregular(ev(spark, sf).select("t", "value"), refs(spark, sf, "error"), "value", 90.0, 10)
    return got.select("bin", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n", "lag")


@query(
    """WITH s AS (SELECT event_id AS sample_idx, value FROM events), r AS (SELECT event_id AS ref_id, event_id AS a FROM events WHERE event_type = 'error'),
g AS (SELECT r.ref_id, (s.sample_idx - r.a) AS lag_idx, s.value, count(*) OVER (PARTITION BY r.ref_id) AS c FROM r JOIN s ON s.sample_idx BETWEEN r.a - 5 AND r.a + 9)
SELECT lag_idx::INTEGER AS lag_idx, round(avg(value), 6) AS mean, count(*) AS n, lag_idx / 1.0::DOUBLE AS lag FROM g WHERE c = 15 GROUP BY lag_idx"""
)
def eta_regular(spark, sf):
    e = ev(spark, sf)
    r = e.where("kind = 'error'").select(F.col("event_id").alias("ref_id"), F.col("event_id").cast("double").alias("r"))
    got = pe.average_regular(e.select(F.col("event_id").alias("sample_idx"), "value"), r, "value", 1.0, -5, 10)
    return got.select("lag_idx", F.round("mean", 6).alias("mean"), "n", "lag")


@query(
    f"""WITH {EV}, {SQL_DAYS}, f AS (SELECT epoch_id, unit, min(t) AS first FROM ev JOIN days ON t BETWEEN start AND stop GROUP BY ALL)
SELECT epoch_id, unit, round((row_number() OVER (PARTITION BY epoch_id ORDER BY first, unit) - 1) / count(*) OVER (PARTITION BY epoch_id)::DOUBLE, 9) AS "order" FROM f"""
)
def rank_order_first_spike(spark, sf):
    return pe.rank_order(spikes(spark, sf), days(spark), DAY).withColumn("order", F.round("order", 9))


@query(
    f"""WITH {EV}, {SQL_DAYS}, f AS (SELECT epoch_id, unit, min(t) AS first, start, stop FROM ev JOIN days ON t BETWEEN start AND stop GROUP BY ALL)
SELECT unit, round(quantile_cont((first - start) / (stop - start), 0.5), 9) AS rank FROM f GROUP BY unit"""
)
def rank_order_epoch_median(spark, sf):
    return pe.median_rank(pe.rank_order(spikes(spark, sf), days(spark), DAY, ref="epoch")).withColumn("rank", F.round("rank", 9))


_SETS = f"sets AS (SELECT i::INTEGER AS set_id, i * {10 * DAY} AS start, (i + 1) * {10 * DAY} AS stop FROM range(3) r(i))"


@query(f"WITH {EV}, {_SETS}, c AS (SELECT unit, set_id, count(*) AS n FROM ev JOIN sets ON t BETWEEN start AND stop GROUP BY ALL) SELECT unit FROM c WHERE n >= 20 GROUP BY unit HAVING count(*) = 3")
def remove_inactive_units(spark, sf):
    sets = spark.range(3).select(F.col("id").cast("int").alias("set_id"), (F.col("id") * 10 * DAY).alias("start"), ((F.col("id") + 1) * 10 * DAY).alias("stop"))
    return pe.active_units(spikes(spark, sf), sets, 10 * DAY, 20)


@query(
    f"""WITH {EV}, n AS (SELECT event_id, unit, t, t - lag(t) OVER w AS a, lead(t) OVER w - t AS b FROM ev WINDOW w AS (PARTITION BY unit ORDER BY t)) SELECT event_id, unit, t FROM n WHERE coalesce(a < 3600, false) OR coalesce(b < 3600, false)"""
)
def burst_spikes(spark, sf):
    return pe.bursts(ev(spark, sf).select("event_id", "unit", "t"), isi_burst=3600.0)


@query(
    f"""WITH {EV}, n AS (SELECT event_id, unit, t, t - lag(t) OVER w AS a, lead(t) OVER w - t AS b FROM ev WINDOW w AS (PARTITION BY unit ORDER BY t)) SELECT event_id, unit, t FROM n WHERE coalesce(a > 36000, false) AND coalesce(b > 36000, false)"""
)
def single_spikes(spark, sf):
    return pe.bursts(ev(spark, sf).select("event_id", "unit", "t"), mode="single", isi_single=36000.0)


@query(f"WITH {EV} SELECT unit, count(*) AS n, round(sum(t), 3) AS total FROM ev GROUP BY unit")
def spindices_round_trip(spark, sf):
    back = pe.from_arrays(pe.to_arrays(spikes(spark, sf)))
    return back.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("t"), 3).alias("total"))


_ACG = "floor((b.t - (a.t - 21/2.0::DOUBLE*3600.0::DOUBLE)) / 3600.0)"


@query(
    f"""WITH {EV}, c AS (SELECT a.unit, b.unit AS unit2, {_ACG}::INTEGER AS bin, count(*) AS n FROM ev a JOIN ev b ON a.unit = b.unit AND b.t BETWEEN a.t - 37800.0 AND a.t + 37800.0 WHERE {_ACG} BETWEEN 0 AND 20 GROUP BY ALL),
s AS (SELECT unit, count(*) AS k FROM ev GROUP BY unit)
SELECT s.unit, s.unit AS unit2, i::INTEGER AS bin, (i - 10) * 3600.0::DOUBLE AS lag, CASE WHEN i = 10 THEN 0 ELSE coalesce(n, 0) END AS n, round(CASE WHEN i = 10 THEN 0 ELSE coalesce(n, 0) END / (k * 3600.0), 12) AS rate FROM s CROSS JOIN range(21) g(i) LEFT JOIN c ON c.unit = s.unit AND c.bin = i"""
)
def autocorrelogram(spark, sf):
    return co.correlogram(spikes(spark, sf), 3600.0, 20).withColumn("rate", F.round("rate", 12))


@query(
    f"""WITH {EV}, c AS (SELECT a.unit, b.unit AS unit2, {_ACG}::INTEGER AS bin, count(*) AS n FROM ev a JOIN ev b ON a.unit < b.unit AND b.t BETWEEN a.t - 37800.0 AND a.t + 37800.0 WHERE {_ACG} BETWEEN 0 AND 20 GROUP BY ALL),
s AS (SELECT unit, count(*) AS k FROM ev GROUP BY unit)
SELECT s.unit, u.unit AS unit2, i::INTEGER AS bin, (i - 10) * 3600.0::DOUBLE AS lag, coalesce(n, 0) AS n, round(coalesce(n, 0) / (s.k * 3600.0), 12) AS rate FROM s JOIN s u ON s.unit < u.unit CROSS JOIN range(21) g(i) LEFT JOIN c ON c.unit = s.unit AND c.unit2 = u.unit AND c.bin = i""",
)
def cross_correlogram_pairs(spark, sf):
    return co.correlogram(spikes(spark, sf), 3600.0, 20, same=False).withColumn("rate", F.round("rate", 12))


_COUNTS = f"""cnt AS (SELECT u.unit, i::INTEGER AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT unit FROM ev) u CROSS JOIN range(30) g(i) LEFT JOIN (SELECT unit, least(floor(t / {DAY}), 29)::INTEGER AS bin, count(*) AS n FROM ev WHERE t >= 0 AND t <= 30 * {DAY} GROUP BY ALL) c ON c.unit = u.unit AND c.bin = i)"""


def _counts(spark, sf):
    return grid.bin_counts(spikes(spark, sf), "t", DAY, 0.0, 30)


@query(f"WITH {EV}, {_COUNTS} SELECT unit, bin, n FROM cnt")
def binned_counts(spark, sf):
    return _counts(spark, sf)


@query(
    f"""WITH {EV}, {_COUNTS}, p AS (SELECT a.unit, b.unit AS unit2, count(*) AS n, covar_pop(a.n, b.n) AS c, stddev_pop(a.n) AS x, stddev_pop(b.n) AS y FROM cnt a JOIN cnt b ON a.bin = b.bin AND a.unit < b.unit GROUP BY ALL)
SELECT unit, unit2, round(CASE WHEN x * y > 0 THEN c / (x * y) END, 9) + 0.0::DOUBLE AS r, n FROM p"""
)
def pairwise_pearson(spark, sf):
    return co.pairwise_dense(_counts(spark, sf), "bin", "n").withColumn("r", rounded("r", 9))


@query(
    f"""WITH {EV}, {_COUNTS}, k AS (SELECT unit, bin, rank() OVER (PARTITION BY unit ORDER BY n) + (count(*) OVER (PARTITION BY unit, n) - 1) / 2.0::DOUBLE AS n FROM cnt), p AS (SELECT a.unit, b.unit AS unit2, count(*) AS n, covar_pop(a.n, b.n) AS c, stddev_pop(a.n) AS x, stddev_pop(b.n) AS y FROM k a JOIN k b ON a.bin = b.bin AND a.unit < b.unit GROUP BY ALL)
SELECT unit, unit2, round(CASE WHEN x * y > 0 THEN c / (x * y) END, 9) + 0.0::DOUBLE AS r, n FROM p"""
)
def pairwise_spearman(spark, sf):
    return co.pairwise_dense(_counts(spark, sf), "bin", "n", method="spearman").withColumn("r", rounded("r", 9))


@query(
    f"""WITH {EV}, {_COUNTS}, p AS (SELECT unit, sum(n * n) AS p FROM cnt GROUP BY unit)
SELECT a.unit, b.unit AS unit2, (b.bin - a.bin) AS lag, round(sum(a.n * b.n) / sqrt(any_value(pa.p) * any_value(pb.p)::DOUBLE), 9) AS r FROM cnt a JOIN cnt b ON a.unit < b.unit AND abs(b.bin - a.bin) <= 5 JOIN p pa ON pa.unit = a.unit JOIN p pb ON pb.unit = b.unit GROUP BY ALL""",
)
def cross_correlation_lags(spark, sf):
    return co.cross_correlation(_counts(spark, sf), "bin", "n", 5).withColumn("r", F.round("r", 9))


@query(
    f"""WITH {EV}, d AS (SELECT a.unit, b.t - a.t AS d FROM ev a JOIN ev b ON a.unit = b.unit AND b.t >= a.t + 1.0 AND b.t < a.t + 86400.0)
SELECT unit, CASE WHEN d < 60 THEN 0 WHEN d < 3600 THEN 1 ELSE 2 END::INTEGER AS bin, count(*) AS n, round(count(*) / CASE WHEN d < 60 THEN 59.0 WHEN d < 3600 THEN 3540.0 ELSE 82800.0 END, 12)::DOUBLE AS density FROM d GROUP BY unit, CASE WHEN d < 60 THEN 0 WHEN d < 3600 THEN 1 ELSE 2 END::INTEGER, CASE WHEN d < 60 THEN 59.0 WHEN d < 3600 THEN 3540.0 ELSE 82800.0 END"""
)
def forward_difference_density(spark, sf):
    return co.forward_differences(spikes(spark, sf), [1.0, 60.0, 3600.0, 86400.0]).withColumn("density", F.round("density", 12))


_INTERP = f"""WITH {EV}, p AS (SELECT event_id, unit, t FROM ev WHERE kind = 'purchase'), s AS (SELECT unit, t, value FROM ev WHERE kind <> 'purchase'),
x AS (SELECT p.*, (SELECT struct_pack(t := max(s.t), v := arg_max(s.value, s.t)) FROM s WHERE s.unit = p.unit AND s.t <= p.t) AS a, (SELECT struct_pack(t := min(s.t), v := arg_min(s.value, s.t)) FROM s WHERE s.unit = p.unit AND s.t >= p.t) AS b FROM p)"""


@query(_INTERP + " SELECT event_id, unit, t, round(CASE WHEN a.t IS NOT NULL AND b.t IS NOT NULL AND (b.t - a.t <= 43200.0) THEN a.v + (t - a.t) / (b.t - a.t) * (b.v - a.v) END, 6) AS value FROM x")
def interp_max_gap(spark, sf):
    e = ev(spark, sf)
    got = joins.interpolate_at(e.where("kind = 'purchase'").select("event_id", "unit", "t"), e.where("kind <> 'purchase'").select("unit", "t", "value"), "t", "value", ["unit"], 6 * 3600.0, max_gap=43200.0)
    return got.withColumn("value", F.round("value", 6))


@query(
    _INTERP.replace("s.value", "s.value / 20.0")
    + """, m AS (SELECT *, (t - a.t) / (b.t - a.t) AS k FROM x), n AS (SELECT event_id, unit, t, atan2(sin(a.v) + k * (sin(b.v) - sin(a.v)), cos(a.v) + k * (cos(b.v) - cos(a.v))) AS ang FROM m)
SELECT event_id, unit, t, round(CASE WHEN ang < 0 THEN ang + 2 * pi() ELSE ang END, 6) AS value FROM n"""
)
def circular_interp(spark, sf):
    e = ev(spark, sf)
    got = joins.interpolate_at(e.where("kind = 'purchase'").select("event_id", "unit", "t"), e.where("kind <> 'purchase'").select("unit", "t", (F.col("value") / 20.0).alias("value")), "t", "value", ["unit"], 6 * 3600.0, circular=True)
    return got.withColumn("value", F.round("value", 6))
