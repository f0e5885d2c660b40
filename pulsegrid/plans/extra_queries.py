"""Queries over further operators: statistics, populations, raw recordings, sources and streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import correlate as co, decode as de, ensemble as en, grid, intervals as iv, perievent as pe, sequences as sq, stats as st, tuning as tu
from ..sources import batch, binary_signal as raw, metadata as meta, session_files as files
from ..streaming import windows as stream
from .fixtures import DAY, EV, POS, ev, position, refs, rounded, spikes, table
from .population_queries import _COUNTS, _DOT, _EMB, _MAP, _MAP2, _POST, _counts, _map, _map2, whole_bias_significance, whole_replay_scores, whole_shuffle_spatial_information, whole_similarity_index
from .signals import bell, samples

_ANG = "ang AS (SELECT unit, kind, 2 * pi() * (t % 86400) / 86400 AS a, value FROM ev)"


def _angles(spark, sf):
    return ev(spark, sf).select("unit", "kind", (2 * F.pi() * (F.col("t") % 86400) / 86400).alias("a"), "value")


# statistics

_CHI = "3.841458820694124"


@query(
    f"""WITH {EV}, {_ANG}, g AS (SELECT kind, count(*)::DOUBLE AS n, sqrt(pow(avg(cos(a)), 2) + pow(avg(sin(a)), 2)) AS r FROM ang GROUP BY kind)
SELECT kind, round(acos(CASE WHEN r >= 0.9 THEN sqrt(n * n - (n * n - n * r * n * r) * exp({_CHI} / n)) WHEN r > sqrt({_CHI} / 2 / n) THEN sqrt(2 * n * (2 * n * r * n * r - n * {_CHI}) / (4 * n - {_CHI})) END / (n * r)), 7) AS half_width FROM g"""
)
def mean_direction_interval(spark, sf):
    return st.mean_ci(_angles(spark, sf), "a", ["kind"]).select("kind", F.round("half_width", 7).alias("half_width"))


@query(
    f"""WITH {EV}, x AS (SELECT kind, 2 * pi() * (t % 86400) / 86400 AS a, value / 20.0 AS b FROM ev)
SELECT kind, round(sqrt(pow(avg(cos(a - b)), 2) + pow(avg(sin(a - b)), 2)) - sqrt(pow(avg(cos(a + b)), 2) + pow(avg(sin(a + b)), 2)), 8) AS rho, count(*) AS n FROM x GROUP BY kind"""
)
def circ_correlation_uniform(spark, sf):
    return st.circular_correlation_uniform(_angles(spark, sf).withColumn("b", F.col("value") / 20.0), "a", "b", ["kind"]).withColumn("rho", F.round("rho", 8))


_T = ", ".join(f"({k}, {st.student_quantile(0.975, k)!r}::DOUBLE)" for k in range(1, 201))
_Z = st.student_quantile(0.975, 1e7)


@query(
    f"""WITH {EV}, q AS (SELECT * FROM (VALUES {_T}) v(df, q)), g AS (SELECT unit, avg(value) AS m, stddev_samp(value) / sqrt(count(*)) AS se, count(*) AS n FROM ev GROUP BY unit),
c AS (SELECT g.*, CASE WHEN n < 2 THEN NULL WHEN n <= 201 THEN q ELSE {_Z!r} + (pow({_Z!r}, 3) + {_Z!r}) / (4 * (n - 1)) + (5 * pow({_Z!r}, 5) + 16 * pow({_Z!r}, 3) + 3 * {_Z!r}) / (96 * pow(n - 1, 2)) END AS t FROM g LEFT JOIN q ON q.df = n - 1)
SELECT unit, round(m, 6) AS mean, round(m - t * se, 6) AS lower, round(m + t * se, 6) AS upper, n FROM c"""
)
def confidence_intervals(spark, sf):
    got = st.confidence_interval(ev(spark, sf), "value", ["unit"])
    return got.select("unit", *[F.round(c, 6).alias(c) for c in ("mean", "lower", "upper")], "n")


@query(f"WITH {EV} SELECT kind, true AS holds, true AS narrow FROM ev GROUP BY kind")
def bootstrap_interval(spark, sf):
    e = ev(spark, sf)
    got = st.bootstrap(e.select("event_id", "kind", "value"), "value", ["kind"], F.avg("_v"), 60)
    m = e.groupBy("kind").agg(F.avg("value").alias("m"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("se"))
    return got.join(m, "kind").select("kind", F.col("m").between(F.col("lower"), F.col("upper")).alias("holds"), (F.col("upper") - F.col("lower") < 8 * F.col("se")).alias("narrow"))


# peri-event

_ERR = "r AS (SELECT event_id AS ref_id, t AS r FROM ev WHERE kind = 'error')"


@query(f"WITH {EV}, {_ERR}, k AS (SELECT min(t) AS lo, max(t) AS hi FROM ev WHERE kind <> 'error'), w AS (SELECT r FROM r, k WHERE r - 300 >= lo AND r + 270 <= hi) SELECT i::INTEGER AS lag_idx, round(avg(2 * (r - 300 + i * 30.0) + 1), 3) AS mean, count(*) AS n FROM w, range(20) g(i) GROUP BY i")
def event_triggered_average(spark, sf):
    signal = ev(spark, sf).where("kind <> 'error'").select("t", (2 * F.col("t") + 1).alias("value"))
    got = pe.average_interpolated(signal, refs(spark, sf, "error"), "value", 1 / 30.0, -300.0, 300.0)
    return got.select("lag_idx", F.round("mean", 3).alias("mean"), "n")


_LAG = "floor(({t} - ({r} - 41/2.0::DOUBLE*90.0::DOUBLE)) / 90.0)"


@query(
    f"""WITH RECURSIVE {EV}, {_ERR}, k AS (SELECT count(*)::DOUBLE AS k FROM r), u AS (SELECT unit, count(*)::DOUBLE AS k FROM ev GROUP BY unit),
h AS (SELECT e.unit, {_LAG.format(t='e.t', r='r.r')}::INTEGER AS bin, count(*) AS n FROM ev e JOIN r ON e.t BETWEEN r.r - 1845.0 AND r.r + 1845.0 WHERE {_LAG.format(t='e.t', r='r.r')} BETWEEN 0 AND 40 GROUP BY ALL),
own AS (SELECT a.unit, {_LAG.format(t='b.t', r='a.t')}::INTEGER AS bin, count(*) AS n FROM ev a JOIN ev b ON a.unit = b.unit AND b.t BETWEEN a.t - 1845.0 AND a.t + 1845.0 WHERE {_LAG.format(t='b.t', r='a.t')} BETWEEN 0 AND 40 GROUP BY ALL),
x AS (SELECT u.unit, list(coalesce(h.n, 0)::DOUBLE ORDER BY i) AS h, list(coalesce(own.n, 0) / (u.k * 90.0::DOUBLE) ORDER BY i) AS a FROM u CROSS JOIN range(41) g(i) LEFT JOIN h ON h.unit = u.unit AND h.bin = i LEFT JOIN own ON own.unit = u.unit AND own.bin = i GROUP BY u.unit),
y AS (SELECT unit, h, a, k, list_sum(h) / (k * 90.0::DOUBLE) / 41 AS m FROM x, k),
g AS (SELECT unit, 0 AS step, i AS row, list_append(list_transform(range(21), lambda j: a[21 + i - j]), CASE WHEN m = 0 THEN 0 ELSE h[11 + i] / (k * 90.0::DOUBLE) - m + m / k END) AS v FROM y, range(21) g(i)
  UNION ALL SELECT unit, step + 1, row, CASE WHEN row = step THEN list_transform(v, lambda q: q / f) ELSE list_transform(list_zip(v, p), lambda q: q[1] - f * q[2]) END
    FROM (SELECT *, v[step + 1] / CASE WHEN row = step THEN 1 ELSE p[step + 1] END AS f FROM (SELECT *, max(CASE WHEN row = step THEN v END) OVER (PARTITION BY unit) AS p FROM g WHERE step < 21)))
SELECT unit, row::INTEGER AS bin, round(v[22], 9) AS rate FROM g WHERE step = 21"""
)
def deconvolve_peth(spark, sf):
    return co.deconvolved_peth(spikes(spark, sf), refs(spark, sf, "error"), 90.0, 21).withColumn("rate", rounded("rate", 9))


@query("SELECT r_regionkey::INTEGER AS unit, 100::INTEGER AS unit2, r_regionkey % 2 = 1 AS modulated FROM region")
def significant_modulation(spark, sf):
    r = table(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("unit"), F.lit(100).alias("unit2"))
    x = r.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(200))))
    peak = (F.col("unit") % 2 == 1) & F.col("bin").between(96, 104)
    return co.significant_modulation(x.withColumn("n", F.when(peak, 400).otherwise(100 + F.pmod("bin", F.lit(3))))).select("unit", "unit2", "modulated")


@query("SELECT 0 AS channel, 1 AS channel2, 5 AS lag_idx, true AS alike")
def event_cross_correlation(spark, sf):
    x = samples(spark, sf, fs=100.0).withColumn("t", F.col("t") + F.col("session") * 1e4)
    both = x.select("t", F.lit(0).alias("channel"), bell(F.col("d"), 0.05).alias("value")).unionByName(x.select("t", F.lit(1).alias("channel"), bell(F.col("d") + 0.05, 0.05).alias("value")))
    r = x.where("abs(d) < 0.001").select(F.monotonically_increasing_id().alias("ref_id"), F.col("t").alias("r"))
    got = co.event_cross_correlation(both, r, 100.0, -0.24, 0.24, width=60.0)
    return got.groupBy("channel", F.col("key2").alias("channel2")).agg(F.max_by("lag_idx", "r").alias("lag_idx"), (F.max("r") > 0.8).alias("alike"))


@query(
    f"""WITH {EV}, s AS (SELECT unit, t / 1e6 AS t FROM ev), c AS (SELECT a.unit, floor((b.t - (a.t - 121 / 2.0::DOUBLE * 0.001)) / 0.001)::INTEGER AS bin, count(*) AS n FROM s a JOIN s b ON a.unit = b.unit AND b.t BETWEEN a.t - 0.0605 AND a.t + 0.0605 GROUP BY ALL),
k AS (SELECT unit, count(*) AS k FROM s GROUP BY unit), f AS (SELECT k.unit, (i - 60) * 0.001::DOUBLE AS lag, CASE WHEN i = 60 THEN 0 ELSE coalesce(n, 0) END / (k * 0.001) AS rate FROM k CROSS JOIN range(121) g(i) LEFT JOIN c ON c.unit = k.unit AND c.bin = i),
x AS (SELECT unit, max(CASE WHEN lag BETWEEN 0.002 - 1e-9 AND 0.009 + 1e-9 THEN rate END) AS peak, avg(CASE WHEN lag BETWEEN 0.04 - 1e-9 AND 0.05 + 1e-9 THEN rate END) AS base FROM f GROUP BY unit)
SELECT unit, round(peak, 6) AS peak, round(base, 6) AS base, round(CASE WHEN peak <> base THEN (peak - base) / greatest(peak, base) END, 6) AS index FROM x"""
)
def burst_index(spark, sf):
    acg = co.correlogram(spikes(spark, sf).withColumn("t", F.col("t") / 1e6), 0.001, 120)
    return pe.burst_index(acg).select("unit", *[F.round(c, 6).alias(c) for c in ("peak", "base", "index")])


# maps and fields


@query(
    f"""WITH RECURSIVE {_MAP2}, k0 AS (SELECT unit, bx, "by", bx * 11 + "by" AS i, rate FROM map WHERE rate > 0.5), reach AS (SELECT unit, i, i AS j FROM k0 UNION SELECT r.unit, r.i, b.i FROM reach r JOIN k0 a ON a.unit = r.unit AND a.i = r.j JOIN k0 b ON b.unit = a.unit AND abs(a.bx - b.bx) + abs(a."by" - b."by") = 1),
f AS (SELECT unit, i, min(j) AS f FROM reach GROUP BY ALL), g AS (SELECT k0.*, f.f, count(*) OVER (PARTITION BY k0.unit, f.f) AS area, max(rate) OVER (PARTITION BY k0.unit, f.f) AS top FROM k0 JOIN f ON f.unit = k0.unit AND f.i = k0.i),
k AS (SELECT *, dense_rank() OVER (PARTITION BY unit ORDER BY top DESC, f) AS field FROM g WHERE area >= 2)
SELECT unit, field::INTEGER AS field, round(sum(bx * rate) / sum(rate), 6) AS x, round(sum("by" * rate) / sum(rate), 6) AS y FROM k GROUP BY ALL"""
)
def label_fields_2d(spark, sf):
    cells = tu.label_fields(_map2(spark, sf), 0.5)
    got = tu.field_centres(tu.sort_by_rate(tu.remove_by_area(cells, 2)), "mass")
    return got.select("unit", "field", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"WITH {POS} SELECT session, i, CASE WHEN x BETWEEN 0.5 AND 50.5 AND y BETWEEN -0.5 AND 10.5 AND least(floor((x - 0.5) / 5.0), 9) >= 5 THEN 1 ELSE 0 END::INTEGER AS field FROM pos")
def which_field(spark, sf):
    cells = spark.range(110).select((F.col("id") % 10).cast("int").alias("bx"), F.floor(F.col("id") / 10).cast("int").alias("by")).withColumn("field", (F.col("bx") >= 5).cast("int"))
    return tu.which_field(position(spark, sf), cells, [("x", 0.5, 5.0, 10), ("y", -0.5, 1.0, 11)]).select("session", "i", F.col("field").cast("int").alias("field"))


@query(
    f"""WITH {_MAP}, n AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY bx) AS i, max(rate) OVER (PARTITION BY unit) * 0.9 AS cut FROM map), o AS (SELECT *, i - row_number() OVER (PARTITION BY unit ORDER BY bx) AS g FROM n WHERE rate > cut),
r AS (SELECT unit, min(bx) AS first, max(bx) AS last, max(rate) AS p FROM o GROUP BY unit, g), k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY p DESC, first) AS rn FROM r) SELECT unit, first, last FROM k WHERE rn = 1"""
)
def field_of_peak(spark, sf):
    return tu.field_of_peak(_map(spark, sf), 0.9, relative=True)


@query(f"""WITH {_MAP2}, k0 AS (SELECT unit, bx - 4.5::DOUBLE AS x, "by" - 5.25::DOUBLE AS y FROM map), a AS (SELECT unit, x, y, (atan2(y, x) + 2 * pi()) % (2 * pi()) AS a FROM k0) SELECT unit, 1 AS field, floor(a / (2 * pi() / 36))::INTEGER AS sector, round(max(sqrt(x * x + y * y)), 8) AS distance FROM a GROUP BY ALL""")
def edge_distances(spark, sf):
    return tu.edge_distances(_map2(spark, sf).withColumn("field", F.lit(1)), 4.5, 5.25).withColumn("distance", F.round("distance", 8))


@query(
    f"""WITH {POS}, p AS (SELECT session, i, x - 25 AS dx, y - 5 AS dy, x - lag(x) OVER w AS sx, y - lag(y) OVER w AS sy FROM pos WINDOW w AS (PARTITION BY session ORDER BY i)), m AS (SELECT session, atan2(sum(sy), sum(sx)) AS dir FROM p GROUP BY session)
SELECT p.session, i, round(least(sqrt(dx * dx + dy * dy) / 30.0, 1.0), 8) AS r, round(least(sqrt(dx * dx + dy * dy) / 30.0, 1.0) * cos(atan2(dy, dx) - dir), 6) AS along FROM p JOIN m USING (session) WHERE dir IS NOT NULL"""
)
def pass_on_unit_circle(spark, sf):
    p = position(spark, sf)
    got = tu.pass_on_unit_circle(p, (25.0, 5.0), F.lit(30.0), ["session"], "i")
    return got.where("along is not null or r is null").select("session", "i", F.round("r", 8).alias("r"), F.round("along", 6).alias("along"))


# replay


@query(
    f"""WITH {EV}, x AS (SELECT unit, t / 86400 AS x, value / 20.0 AS a, 1.0 + event_id % 3 AS w FROM ev), m AS (SELECT unit, sum(w * x) / sum(w) AS x, sum(w * cos(a)) / sum(w) AS c, sum(w * sin(a)) / sum(w) AS s, sum(w * x * x) / sum(w) AS xx, sum(w * cos(a) * cos(a)) / sum(w) AS cc, sum(w * sin(a) * sin(a)) / sum(w) AS ss, sum(w * x * cos(a)) / sum(w) AS xc, sum(w * x * sin(a)) / sum(w) AS xs, sum(w * cos(a) * sin(a)) / sum(w) AS cs, count(*) AS n FROM x GROUP BY unit),
r AS (SELECT unit, (xc - x * c) / sqrt((xx - x * x) * (cc - c * c)) AS a, (xs - x * s) / sqrt((xx - x * x) * (ss - s * s)) AS b, (cs - c * s) / sqrt((cc - c * c) * (ss - s * s)) AS k FROM m WHERE n > 5)
SELECT unit, round(sqrt((a * a + b * b - 2 * a * b * k) / (1 - k * k)), 6) AS r FROM r"""
)
def weighted_corr_circular(spark, sf):
    e = ev(spark, sf).select(F.col("unit").alias("event"), (F.col("t") / 86400).alias("x"), (F.col("value") / 20.0).alias("alpha"), (1.0 + F.col("event_id") % 3).alias("p"))
    many = e.groupBy("event").agg(F.count(F.lit(1)).alias("n")).where("n > 5").select("event")
    return de.weighted_correlation_circular(e.join(many, "event")).select(F.col("event").alias("unit"), F.round("r", 6).alias("r"))


@query(
    f"""WITH {EV}, c AS (SELECT event_id AS i, value AS com, abs(value - lag(value) OVER (ORDER BY event_id)) AS j FROM ev), g AS (SELECT i, com, sum(CASE WHEN p IS NULL OR i - p > 2 THEN 1 ELSE 0 END) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT i, com, lag(i) OVER (ORDER BY i) AS p FROM c WHERE coalesce(j < 20.0, true)))
SELECT min(i) AS first, max(i) AS last, count(*) AS n, round(stddev_pop(com), 5) AS dispersion FROM g GROUP BY g HAVING count(*) >= 4"""
)
def replay_candidates(spark, sf):
    post = table(spark, sf, "events").select(F.col("event_id").alias("tbin"), F.col("value").alias("bx"), F.lit(1.0).alias("p"))
    still = spark.range(1).select(F.lit(-1.0).alias("lo"), F.lit(1e9).alias("hi"), F.lit(0.0).alias("speed"))
    wide = table(spark, sf, "events").agg(F.max("event_id")).first()[0] / 20 + 1
    pieces = still.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(20)))).select((F.col("k") * wide).alias("lo"), ((F.col("k") + 1) * wide).alias("hi"), "speed")
    got = de.replay_candidates(post, pieces, 1.0, wide / 16, min_bins=4)
    return got.select("first", "last", "n", F.round("dispersion", 5).alias("dispersion"))


# populations


@query(
    f"""WITH {EV}, {_COUNTS}, z AS (SELECT unit, bin, n::DOUBLE AS z FROM cnt), p AS (SELECT i AS assembly, unit % 2 AS g, bin, sum(sin(unit + i) * z) AS p FROM z, range(3) a(i) GROUP BY ALL),
m AS (SELECT assembly, g, avg(p) AS m, stddev_pop(p) AS s FROM p GROUP BY ALL), y AS (SELECT assembly, g, bin, coalesce((p - m) / nullif(s, 0), 0) AS y FROM p JOIN m USING (assembly, g))
SELECT a.assembly::INTEGER AS assembly, a.bin, round(a.y * b.y, 6) AS activity FROM y a JOIN y b ON a.assembly = b.assembly AND a.bin = b.bin AND a.g = 0 AND b.g = 1"""
)
def cross_area_activity(spark, sf):
    z = _counts(spark, sf).withColumn("z", F.col("n").cast("double"))
    u = z.select("unit").distinct()
    p = u.select("unit", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("assembly")).withColumn("weight", F.sin(F.col("unit") + F.col("assembly")))
    return en.cross_area_activity(p, z, u.withColumn("grp", F.col("unit") % 2)).withColumn("activity", F.round("activity", 6))


@query(f"WITH {EV}, {_COUNTS}, g AS (SELECT unit % 3 AS g, count(DISTINCT unit) AS n FROM cnt GROUP BY 1) SELECT unit, bin, round(cnt.n / sqrt(g.n), 8) AS z FROM cnt JOIN g ON g.g = unit % 3")
def scaled_by_group(spark, sf):
    z = _counts(spark, sf).select("unit", "bin", F.col("n").cast("double").alias("z"))
    return en.scaled_by_group(z, z.select("unit").distinct().withColumn("grp", F.col("unit") % 3)).withColumn("z", F.round("z", 8))


@query(
    f"""WITH {EV}, u AS (SELECT DISTINCT unit FROM ev), p AS (SELECT i::INTEGER AS assembly, unit, CASE WHEN unit % 4 = i THEN 1.0::DOUBLE WHEN i = 0 THEN 0.6::DOUBLE ELSE 0.1::DOUBLE END AS w FROM u, range(4) a(i)), k AS (SELECT assembly FROM p WHERE w > 0.5 GROUP BY assembly HAVING count(DISTINCT unit % 2) >= 2) SELECT assembly, unit, w AS weight FROM p WHERE assembly IN (SELECT assembly FROM k)"""
)
def cross_group_patterns(spark, sf):
    u = spikes(spark, sf).select("unit").distinct()
    i = F.col("assembly")
    p = u.withColumn("assembly", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("weight", F.when(F.col("unit") % 4 == i, 1.0).when(i == 0, 0.6).otherwise(0.1))
    return en.cross_group_patterns(p, u.withColumn("grp", F.col("unit") % 2), 0.5, "relative").select("assembly", "unit", "weight")


@query(
    f"""WITH {EV}, {_COUNTS}, t AS (SELECT a.unit, b.unit AS unit2, covar_pop(a.n, b.n) / nullif(stddev_pop(a.n) * stddev_pop(b.n), 0) AS task FROM cnt a JOIN cnt b ON a.bin = b.bin AND a.unit < b.unit WHERE a.bin BETWEEN 10 AND 19 GROUP BY ALL),
w AS (SELECT a.bin // 5 AS w, a.unit, b.unit AS unit2, covar_pop(a.n, b.n) / nullif(stddev_pop(a.n) * stddev_pop(b.n), 0) AS r FROM cnt a JOIN cnt b ON a.bin = b.bin AND a.unit < b.unit WHERE a.bin < 10 OR a.bin >= 20 GROUP BY ALL),
x AS (SELECT m.w AS m, c.w AS c, corr(task, m.r) AS tp, corr(task, c.r) AS tr, corr(m.r, c.r) AS pr FROM w m JOIN w c ON m.w >= 4 AND c.w < 2 AND m.unit = c.unit AND m.unit2 = c.unit2 JOIN t ON t.unit = m.unit AND t.unit2 = m.unit2 WHERE task IS NOT NULL AND m.r IS NOT NULL AND c.r IS NOT NULL GROUP BY ALL),
e AS (SELECT m, pow((tp - tr * pr) / (sqrt((1 - tr * tr) * (1 - pr * pr)) + 1e-10), 2) AS ev, pow((tr - tp * pr) / (sqrt((1 - tp * tp) * (1 - pr * pr)) + 1e-10), 2) AS rev FROM x)
SELECT m AS "window", round(avg(ev), 7) AS ev, round(avg(rev), 7) AS rev, round(stddev_pop(ev), 7) AS ev_std FROM e GROUP BY m"""
)
def explained_variance_windows(spark, sf):
    c = _counts(spark, sf)
    window = F.when(F.col("bin").between(10, 19), -1).otherwise(F.floor(F.col("bin") / 5)).cast("long")  # ten bins of the task, else five
    got = en.explained_variance_windows_of(c.withColumn("window", window), "bin", "n", "window", -1, [0, 1], [4, 5])
    return got.select("window", F.round("ev", 7).alias("ev"), F.round("rev", 7).alias("rev"), F.round("ev_std", 7).alias("ev_std"))


@query(
    f"""WITH {EV}, x AS (SELECT least(floor(value / 50.0), 9)::INTEGER AS s0, least(floor((t % 86400) / 8640), 9)::INTEGER AS s1, floor(t / {6 * DAY})::INTEGER AS d, lead(value) OVER w - value AS x0, lead(t % 86400) OVER w - t % 86400 AS x1 FROM ev WINDOW w AS (PARTITION BY unit ORDER BY t)),
m AS (SELECT d, s0, s1, count(*) AS n, avg(x0) AS m0, avg(x1) AS m1 FROM x WHERE x0 IS NOT NULL GROUP BY ALL)
SELECT 0 AS axis, s0, s1, d AS domain, n, round(m0 + 1e-9, 5) AS gradient, round(1e-9 - sum(m0) OVER (PARTITION BY d, s1 ORDER BY s0 ROWS UNBOUNDED PRECEDING), 5) AS potential FROM m UNION ALL
SELECT 1, s0, s1, d, n, round(m1 + 1e-9, 5), round(1e-9 - sum(m1) OVER (PARTITION BY d, s0 ORDER BY s1 ROWS UNBOUNDED PRECEDING), 5) FROM m"""
)
def potential_landscape_nd(spark, sf):
    e = ev(spark, sf).withColumn("hour", F.col("t") % 86400)
    s = [F.least(F.floor(F.col(c) / w), F.lit(9)).cast("int") for c, w in (("value", 50.0), ("hour", 8640.0))]
    got = en.potential_landscape_nd(e, ["value", "hour"], s, F.floor(F.col("t") / (6 * DAY)).cast("int"), "t", ["unit"])
    return got.select("axis", "s0", "s1", "domain", "n", F.round(F.col("gradient") + 1e-9, 5).alias("gradient"), F.round(F.col("potential") + 1e-9, 5).alias("potential"))


# decoding inputs


@query(f"WITH {EV}, x AS (SELECT unit, event_id, list(value) OVER w AS h FROM ev WINDOW w AS (PARTITION BY unit ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)) SELECT unit, event_id, round(h[1] + 2 * h[2] + 3 * h[3] + 4 * h[4], 5) AS digest FROM x WHERE len(h) = 4")
def trial_covariates(spark, sf):
    got = en.trial_covariates(ev(spark, sf), ["value"], ["kind"], "unit", "event_id", 2, 1)
    h = F.col("history")
    return got.select("unit", "event_id", F.round(h[0] + 2 * h[1] + 3 * h[2] + 4 * h[3], 5).alias("digest"))


@query("SELECT count(*) AS n, 64 AS most, count(*) AS once FROM events")
def mini_batches(spark, sf):
    b = en.mini_batches(table(spark, sf, "events").select("event_id"), 64, ["event_id"], seed=4)
    sizes = b.groupBy("batch").agg(F.count(F.lit(1)).alias("k"))
    return sizes.agg(F.sum("k").alias("n"), F.max("k").cast("int").alias("most")).join(F.broadcast(b.agg(F.countDistinct("event_id").alias("once"))), F.lit(True))


@query(f"WITH {EV} SELECT unit, count(*) AS n, round(sum(value), 3) AS total, count(*) AS places FROM ev GROUP BY unit")
def shuffled_within_trials(spark, sf):
    got = en.shuffled_within(ev(spark, sf).select("unit", "event_id", "value"), ["value"], "unit", "event_id")
    return got.groupBy("unit").agg(F.count("value").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.countDistinct("event_id").alias("places"))


@query("WITH f AS (SELECT label, vec_id FROM embeddings) SELECT label, count(*) AS n, 5::BIGINT AS folds, true AS even, true AS whole FROM f GROUP BY label HAVING count(*) >= 5")
def folds_of_labels(spark, sf):
    f = en.k_folds(table(spark, sf, "embeddings").select("vec_id", "label"), 5, "label", "vec_id")
    by = f.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("k"))
    parts = f.withColumn("part", en.split_of_fold(F.col("fold"), 2, 5)).groupBy("label").agg(F.countDistinct("vec_id").alias("ids"), F.countDistinct("part").alias("parts"))
    got = by.groupBy("label").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("folds"), (F.max("k") - F.min("k") <= 1).alias("even")).join(parts, "label")
    return got.where("n >= 5").select("label", "n", "folds", "even", ((F.col("ids") == F.col("n")) & (F.col("parts") == 3)).alias("whole"))


# epochs


@query(
    f"""WITH {EV}, f AS (SELECT unit, t, value >= 30 AS o, lag(value >= 30) OVER w AS p, t - lag(t) OVER w AS gap FROM ev WINDOW w AS (PARTITION BY unit ORDER BY t)), g AS (SELECT unit, t, sum((NOT coalesce(p, false) OR coalesce(gap > 43200, false))::INTEGER) OVER (PARTITION BY unit ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT * FROM f WHERE o))
SELECT unit, min(t) AS start, max(t) AS stop FROM g GROUP BY unit, g HAVING max(t) > min(t)"""
)
def run_epochs(spark, sf):
    return iv.run_epochs(ev(spark, sf), "value", 30.0, "t", ["unit"], 43200.0, 1e-9)


@query(f"WITH {EV} SELECT event_id, unit, t, unit % 7 AS label FROM ev")
def label_behaviour(spark, sf):
    e = ev(spark, sf).select("event_id", "unit", "t")
    spans = e.select(F.col("event_id").alias("epoch_id"), F.col("t").alias("start"), F.col("t").alias("stop"), "unit", (F.col("unit") % 7).alias("label"))
    return meta.label_behaviour(e, spans, 3600.0, "label", keys=["unit"])


@query(f"WITH {POS}, l AS (SELECT session, min(i) AS a, max(i) AS b, count(DISTINCT least(floor((x - 0.5) / 5.0), 9)) AS k FROM pos GROUP BY session) SELECT session AS lap_id FROM l WHERE 1 - k / 10.0 <= 0.3")
def good_laps(spark, sf):
    p = position(spark, sf)
    # sessions one after the other, as the laps of one track
    p = p.select((F.col("i") + F.col("session") * 1e9).alias("t"), F.col("x").alias("lin"), "session")
    laps = p.groupBy(F.col("session").alias("lap_id")).agg(F.min("t").alias("start"), F.max("t").alias("stop"))
    return sq.good_laps(p, laps, 0.5, 5.0, 10, 0.3, 1e9).select("lap_id")


# raw recordings

_RAW = "raw AS (SELECT vec_id AS s, k - 1 AS c, round(embedding[k] * 1000)::INTEGER AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings))"


def _raw(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_idx"), F.posexplode("embedding").alias("channel", "v"))
    # the product in single precision, as the components are and as SQL forms it; in double some halves round the other way
    return e.select("channel", "sample_idx", F.round(F.col("v") * F.lit(1000).cast("float")).cast("int").alias("value"))


def _holes(spark):
    return spark.range(3).select((10 + F.col("id") * 25).alias("start"), (16 + F.col("id") * 25).alias("stop"))


@query(f"WITH {_RAW}, n AS (SELECT max(s) AS m FROM raw) SELECT c::INTEGER AS channel, s AS sample_idx, CASE WHEN s % 25 BETWEEN 10 AND 15 AND s < 75 AND (s - s % 25) + 16 <= m + 1 THEN 0 ELSE v END::INTEGER AS value FROM raw, n")
def remove_artifacts_zeros(spark, sf):
    return raw.remove_artifacts(_raw(spark, sf), _holes(spark), "zeros")


@query(f"WITH {_RAW}, h AS (SELECT 10 + i * 25 AS a, 16 + i * 25 AS b FROM range(3) t(i)) SELECT raw.c::INTEGER AS channel, raw.s AS sample_idx, round(CASE WHEN a IS NULL THEN raw.v ELSE x.v + (raw.s - a) * (coalesce(y.v, x.v) - x.v) / 5.0 END, 4)::DOUBLE AS value FROM raw LEFT JOIN h ON raw.s >= a AND raw.s < b LEFT JOIN raw x ON x.c = raw.c AND x.s = a LEFT JOIN raw y ON y.c = raw.c AND y.s = b")
def remove_artifacts_linear(spark, sf):
    return raw.remove_artifacts(_raw(spark, sf).withColumn("value", F.col("value").cast("double")), _holes(spark), "linear").withColumn("value", F.round("value", 4))


@query(f"WITH {_RAW} SELECT c::INTEGER AS channel, s - (SELECT count(*) FROM range(3) t(i) WHERE 16 + i * 25 <= s) * 6 AS sample_idx, v AS value FROM raw WHERE NOT (s % 25 BETWEEN 10 AND 15 AND s < 75)")
def cut_artifacts(spark, sf):
    return raw.cut_artifacts(_raw(spark, sf), _holes(spark))


@query(f"WITH {_RAW} SELECT (CASE WHEN c >= 4 THEN c + 2 WHEN c >= 2 THEN c + 1 ELSE c END)::INTEGER AS channel, s AS sample_idx, v AS value FROM raw UNION ALL SELECT m::INTEGER, s, 0 FROM (SELECT DISTINCT s FROM raw), (VALUES (2), (5)) t(m)")
def fill_missing_channels(spark, sf):
    return raw.fill_channels(_raw(spark, sf), [2, 5])


@query(f"WITH {_RAW}, n AS (SELECT max(c) + 1 AS n FROM raw) SELECT (n - 1 - c)::INTEGER AS channel, s AS sample_idx, v AS value FROM raw, n")
def reorder_channels(spark, sf):
    x = _raw(spark, sf)
    n = x.agg(F.max("channel")).first()[0] + 1
    return raw.reorder_channels(x, list(range(n))[::-1])


# operators with shuffles: what they observe in SQL, and what their shuffles must keep


@query(f"WITH {EV} SELECT count(*) AS n, true AS inside, true AS as_long, true AS moved FROM ev WHERE kind = 'signup'")
def randomize_epochs(spark, sf):
    e = ev(spark, sf).where("kind = 'signup'").select("event_id", F.col("t").alias("start"), (F.col("t") + 21600.0).alias("stop"), F.col("t").alias("was"))
    got = iv.randomize(e, (0.0, 30 * DAY), seed=3)
    length = F.col("stop") - F.col("start")
    inside = (F.min("start") >= 0) & (F.max("stop") <= 30 * DAY)
    as_long = F.min((F.col("stop") >= 30 * DAY) | (F.abs(length - 21600.0) < 1e-6)) & (F.max(length) < 21600.001)
    return got.agg(F.count(F.lit(1)).alias("n"), inside.alias("inside"), as_long.alias("as_long"), (F.max(F.abs(F.col("start") - F.col("was"))) > DAY).alias("moved"))


_W = grid.gaussian(2.0)


@query(
    f"""WITH {EV}, {_ERR}, b AS (SELECT i AS bin, coalesce(n, 0) AS n FROM range(4320) g(i) LEFT JOIN (SELECT least(floor(t / 600), 4319)::BIGINT AS bin, count(*) AS n FROM ev WHERE t BETWEEN 0 AND 2592000 GROUP BY 1) c ON c.bin = i),
w AS (SELECT unnest([{', '.join(f'{x!r}::DOUBLE' for x in _W)}]) AS w, unnest(range({len(_W)})) AS k), s AS (SELECT a.bin, sum(x.n * w) / sum(w) AS rate FROM b a JOIN w ON true JOIN b x ON abs(x.bin - a.bin) = k GROUP BY a.bin),
z AS (SELECT bin, (rate - (SELECT avg(rate) FROM s)) / (SELECT stddev_pop(rate) FROM s) AS z FROM s)
SELECT ref_id, round(avg(z), 6) AS z, coalesce(avg(z) > 0, false) AS passes FROM r LEFT JOIN z ON bin BETWEEN floor((r - 1200) / 600) AND floor((r + 1200) / 600) GROUP BY ref_id"""
)
def spiking_threshold(spark, sf):
    got = pe.spiking_threshold(spikes(spark, sf), refs(spark, sf, "error"), 600.0, 0.0, int(30 * DAY / 600), 1200.0)
    return got.select("ref_id", F.round("z", 6).alias("z"), "passes")


@query(
    f"""WITH {POS}, m AS (SELECT least(floor((x - 0.5) / 5.0), 9) AS bx, count(*) AS n, sum((z > 50000)::INTEGER) AS k FROM pos GROUP BY 1), p AS (SELECT n / (sum(n) OVER ())::DOUBLE AS p, k / n::DOUBLE AS r FROM m), a AS (SELECT sum(p * r) AS m FROM p)
SELECT 51 AS shuffles, round(sum(CASE WHEN r > 0 THEN p * r / m * log2(r / m) ELSE 0 END), 8) AS information, true AS varied FROM p, a"""
)
def shuffle_spatial_information(spark, sf):
    got = whole_shuffle_spatial_information(spark, sf)
    return got.agg(F.count(F.lit(1)).cast("int").alias("shuffles"), F.round(F.max(F.when(F.col("shuffle") == 0, F.col("information"))), 8).alias("information"), (F.stddev_pop("information") > 0).alias("varied"))


@query(
    f"""WITH {_POST}, g AS (SELECT tbin // 6 AS event, sum(p) AS w, sum(p * tbin) / sum(p) AS t, sum(p * tbin * tbin) / sum(p) AS tt, sum(p * bx) / sum(p) AS x, sum(p * bx * bx) / sum(p) AS xx, sum(p * bx * tbin) / sum(p) AS xt FROM post GROUP BY 1)
SELECT event::INTEGER AS event, round(abs(CASE WHEN (xx - x * x) * (tt - t * t) > 1e-12 THEN (xt - x * t) / sqrt((xx - x * x) * (tt - t * t)) END), 6) AS score, true AS ranked FROM g"""
)
def replay_scores(spark, sf):
    p = lambda c: F.coalesce(F.col(c).between(1 / 41, 1.0), F.lit(True))
    return whole_replay_scores(spark, sf).select("event", F.round("score", 6).alias("score"), (p("p_time") & p("p_column")).alias("ranked"))


_BIAS = "SELECT {k} AS epoch, a.unit, b.unit AS unit2, 2 * sum((a.t <= b.t)::INTEGER) / count(*)::DOUBLE - 1 AS bias FROM v a JOIN v b ON {on} AND a.unit <> b.unit WHERE {w} GROUP BY ALL"


@query(
    f"""WITH {EV}, v AS (SELECT floor(t / {5 * DAY})::INTEGER AS epoch, unit, t FROM ev), x AS ({_BIAS.format(k='0', on='true', w=f'a.t < {10 * DAY} AND b.t < {10 * DAY}')}), y AS ({_BIAS.format(k='a.epoch', on='a.epoch = b.epoch', w=f'a.t >= {10 * DAY} AND b.t >= {10 * DAY}')})
SELECT y.epoch, round(sum(y.bias * coalesce(x.bias, 0)) / (sqrt(sum(y.bias * y.bias)) * (SELECT sqrt(sum(bias * bias)) FROM x)), 8) AS cosine, true AS ranked FROM y LEFT JOIN x ON x.unit = y.unit AND x.unit2 = y.unit2 GROUP BY y.epoch"""
)
def bias_significance(spark, sf):
    got = whole_bias_significance(spark, sf)
    return got.select("epoch", F.round("cosine", 8).alias("cosine"), F.col("p").between(1 / 31, 1.0).alias("ranked"))


@query(f"WITH {_EMB}, nn AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM em) SELECT a.vec_id, b.vec_id AS key2, round(abs({_DOT} / (a.n * b.n)), 6) AS similarity, true AS ranked FROM nn a JOIN nn b ON a.vec_id < b.vec_id")
def similarity_index(spark, sf):
    return whole_similarity_index(spark, sf).select("vec_id", "key2", rounded("similarity", 6).alias("similarity"), F.col("p").between(1 / 51, 1.0).alias("ranked"))


# files and batches


def _content(rows, key, make):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        k = g[key].iloc[0]
        return pd.DataFrame({"path": [f"data/session{k}/session{k}.file"], "content": [make(g)]})

    return rows.groupBy(key).applyInPandas(run, "path string, content binary")


@query("SELECT 'session' || s_nationkey AS session, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INTEGER AS event_id, s_suppkey::DOUBLE AS start, s_suppkey + 0.5::DOUBLE AS stop, s_suppkey + 0.25::DOUBLE AS peak, round(s_acctbal, 4) AS amplitude FROM supplier")
def mat_event_files(spark, sf):
    def make(g: pd.DataFrame) -> bytes:
        g = g.sort_values("s_suppkey")
        t = g.s_suppkey.to_numpy(float)
        return files.build_mat({"ripples": {"timestamps": np.stack([t, t + 0.5], axis=1), "peaks": t[:, None] + 0.25, "amplitude": g.s_acctbal.to_numpy()[:, None], "duration": np.array([[0.5]])}})

    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    got = files.mat_events(_content(s, "s_nationkey", make), "ripples")
    return got.select("session", "event_id", "start", "stop", "peak", F.round("amplitude", 4).alias("amplitude"))


@query("WITH n AS (SELECT n_regionkey AS k, n_nationkey AS c, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation) SELECT 'session' || k AS session, (i // 2)::INTEGER AS shank, (i % 2)::INTEGER AS nth, c::INTEGER AS channel FROM n")
def xml_headers(spark, sf):
    def make(g: pd.DataFrame) -> bytes:
        c = sorted(g.n_nationkey)
        groups = "".join("<group><channels>" + "".join(f"<channel>{x}</channel>" for x in c[i : i + 2]) + "</channels></group>" for i in range(0, len(c), 2))
        return f"<parameters><acquisitionSystem><nChannels>{len(c)}</nChannels><samplingRate>20000</samplingRate></acquisitionSystem><fieldPotentials><lfpSamplingRate>1250</lfpSamplingRate></fieldPotentials><anatomicalDescription><channelGroups>{groups}</channelGroups></anatomicalDescription></parameters>".encode()

    n = table(spark, sf, "nation").select("n_regionkey", "n_nationkey")
    return files.probe_layout(files.headers(_content(n, "n_regionkey", make)))


@query("SELECT 'nation ' || n_nationkey AS session, n_nationkey * 2.0::DOUBLE AS doubled FROM nation WHERE n_nationkey <> 7")
def batch_results(spark, sf):
    def work(s: str) -> pd.DataFrame:
        k = int(s.split()[1])
        if k == 7:
            raise ValueError("no such session")
        return pd.DataFrame({"doubled": [k * 2.0]})

    path = batch.scratch(spark, "batch")
    sessions = table(spark, sf, "nation").select(F.concat(F.lit("nation "), "n_nationkey").alias("session"))
    batch.run(sessions, work, "doubled double", path, skip_if_error=True)
    return batch.run(sessions, work, "doubled double", path, skip_if_error=True).where("error is null").select("session", "doubled")  # only what failed is tried again


@query("SELECT 'nation ' || n_nationkey AS session, '/rates' AS path, n_nationkey % 3 + 1 AS n FROM nation")
def nested_results(spark, sf):
    path = batch.scratch(spark, "nested")
    sessions = table(spark, sf, "nation").select(F.concat(F.lit("nation "), "n_nationkey").alias("session"))
    got = batch.run_nested(sessions, lambda s: {"name": s, "rates": np.arange(int(s.split()[1]) % 3 + 1, dtype=float), "ragged": [[1], [2, 3]]}, path)
    return got.where("path = '/rates'").select("session", "path", F.size(F.from_json("value", "array<double>")).cast("long").alias("n"))


# streams, run to their end


def _streamed(spark, sf, make, late: str = "1 hour"):
    """What a query over the events as a stream has given when all of them have been read: a folder a batch, of which the last one is whole in the complete mode."""
    schema = table(spark, sf, "events").schema
    path = batch.scratch(spark, "streamed")
    seen = []
    rows = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").select("event_id", F.col("user_id").alias("unit"), F.col("ts").cast("timestamp").alias("ts"), "value")
    mode = "complete" if late is None else "append"
    result = make(rows)

    def put(out, number: int) -> None:
        out.write.mode("overwrite").parquet(f"{path}/{number}")
        seen.append(number)

    run = result.writeStream.foreachBatch(put).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", batch.scratch(spark, "stream")).start()
    run.awaitTermination()
    last = sorted(set(seen))[-1:] if late is None else sorted(set(seen))
    return spark.read.schema(result.schema).parquet(*[f"{path}/{k}" for k in last]) if last else spark.createDataFrame([], result.schema)


@query("SELECT user_id AS unit, count(*) AS n FROM events GROUP BY user_id")
def streaming_counts(spark, sf):
    got = _streamed(spark, sf, lambda e: stream.binned_counts(e, "1 day", "1 hour"), None)
    return got.groupBy("unit").agg(F.sum("n").alias("n"))


@query(
    """WITH e AS (SELECT user_id AS unit, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY unit ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT unit, count(*) AS runs, sum(n) AS n FROM (SELECT unit, g, count(*) AS n FROM g GROUP BY ALL) GROUP BY unit"""
)
def streaming_runs(spark, sf):
    got = _streamed(spark, sf, lambda e: stream.merged_runs(e, "6 hours", "1 hour"), None)
    return got.groupBy("unit").agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("n"))


@query("SELECT count(DISTINCT event_id) AS n FROM events")
def streaming_without_repeats(spark, sf):
    twice = lambda e: stream.drop_repeats(e.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))), "event_id", "40 days")
    return _streamed(spark, sf, twice).agg(F.count(F.lit(1)).alias("n"))
