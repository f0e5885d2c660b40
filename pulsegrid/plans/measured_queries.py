"""Filters, components and null models on numbers of the tables, with SQL that computes the same from its definition."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..catalog import query
from ..operators import correlate as co, ensemble as en, grid, intervals as iv, nulls, signals as sg
from .fixtures import EV, ev, table
from .track_queries import _RUNS

# filters: quantities of a supplier's line items in order, a hundred samples a second

FS = 100.0
_X = """raw AS (SELECT l_suppkey AS session, l_orderkey * 8 + l_linenumber AS i, min(l_quantity)::DOUBLE AS x FROM lineitem GROUP BY 1, 2),
src AS MATERIALIZED (SELECT session, row_number() OVER (PARTITION BY session ORDER BY i) - 1 AS nth, x FROM raw), size AS (SELECT session, count(*) AS n FROM src GROUP BY 1)"""


def _samples(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("session"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("i")).agg(F.min("l_quantity").cast("double").alias("value"))
    x = li.withColumn("nth", F.row_number().over(Window.partitionBy("session").orderBy("i")).cast("long") - 1)
    return x.select("session", F.lit(0).alias("channel"), F.col("nth").alias("sample_idx"), (F.col("nth") / FS).alias("t"), "value")


#: One section of a band-pass filter of 5 to 20 Hz, from its analogue form by the bilinear transform; its state at rest is b2 for each unit of input.
_SECTION = """w AS (SELECT 200 * tan(pi() * 5 / 100) AS lo, 200 * tan(pi() * 20 / 100) AS hi), d AS (SELECT 40000 + 200 * (hi - lo) + lo * hi AS d, lo, hi FROM w),
c AS MATERIALIZED (SELECT 200 * (hi - lo) / d AS b, (2 * lo * hi - 80000) / d AS a1, (40000 - 200 * (hi - lo) + lo * hi) / d AS a2 FROM d)"""


def _both_ways(name: str, source: str) -> str:
    """CTEs that run the section over (session, nth, x) forward and backward, nine samples mirrored at either end."""
    return f"""{name}_e AS MATERIALIZED (SELECT session, nth + 9 AS m, x FROM {source}
  UNION ALL SELECT s.session, 9 - s.nth, 2 * f.x - s.x FROM {source} s JOIN {source} f ON f.session = s.session AND f.nth = 0 WHERE s.nth BETWEEN 1 AND 9
  UNION ALL SELECT s.session, 9 + 2 * (n - 1) - s.nth, 2 * l.x - s.x FROM {source} s JOIN size USING (session) JOIN {source} l ON l.session = s.session AND l.nth = n - 1 WHERE s.nth BETWEEN n - 10 AND n - 2),
{name}_f AS (SELECT session, m, b * x - b * x AS y, -a1 * (b * x - b * x) - b * x AS z1, -b * x - a2 * (b * x - b * x) AS z2 FROM {name}_e, c WHERE m = 0
  UNION ALL SELECT session, m, y, -a1 * y + z2, -b * x - a2 * y FROM (SELECT e.session, e.m, e.x, b * e.x + z1 AS y, z2, a1, a2, b FROM {name}_f f JOIN {name}_e e ON e.session = f.session AND e.m = f.m + 1, c)),
{name}_r AS MATERIALIZED (SELECT session, n + 17 - m AS m, y AS x FROM {name}_f JOIN size USING (session)),
{name}_g AS (SELECT session, m, b * x - b * x AS y, -a1 * (b * x - b * x) - b * x AS z1, -b * x - a2 * (b * x - b * x) AS z2 FROM {name}_r, c WHERE m = 0
  UNION ALL SELECT session, m, y, -a1 * y + z2, -b * x - a2 * y FROM (SELECT e.session, e.m, e.x, b * e.x + z1 AS y, z2, a1, a2, b FROM {name}_g f JOIN {name}_r e ON e.session = f.session AND e.m = f.m + 1, c)),
{name} AS MATERIALIZED (SELECT session, n + 8 - m AS nth, y AS x FROM {name}_g JOIN size USING (session) WHERE m BETWEEN 9 AND n + 8)"""


_BAND = f"""WITH RECURSIVE {_X}, {_SECTION}, {_both_ways('flt', 'src')},
spec AS MATERIALIZED (SELECT session, k, any_value(n) AS n, sum(x * cos(2 * pi() * ((k * nth) % n) / n)) AS re, -sum(x * sin(2 * pi() * ((k * nth) % n) / n)) AS im
  FROM (SELECT session, n, unnest(range(n // 2 + 1)) AS k FROM size) JOIN flt USING (session) GROUP BY session, k),
ana AS MATERIALIZED (SELECT session, nth, sum(h * (re * cos(a) - im * sin(a))) / any_value(n) AS re, sum(h * (re * sin(a) + im * cos(a))) / any_value(n) AS im
  FROM (SELECT session, nth, n, re, im, 2 * pi() * ((k * nth) % n) / n AS a, CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END AS h FROM spec JOIN (SELECT session, nth FROM flt) USING (session)) GROUP BY session, nth),
amp AS MATERIALIZED (SELECT session, nth, sqrt(re * re + im * im) AS x FROM ana), {_both_ways('slow', 'amp')},
ph AS (SELECT session, nth, atan2(im, re) AS p FROM ana), st AS (SELECT *, -round((p - lag(p) OVER w) / (2 * pi())) AS turn FROM ph WINDOW w AS (PARTITION BY session ORDER BY nth)),
un AS MATERIALIZED (SELECT session, nth, p + 2 * pi() * coalesce(sum(turn) OVER (PARTITION BY session ORDER BY nth), 0) AS u FROM st),
med AS MATERIALIZED (SELECT a.session, a.nth, median(b.u) AS u FROM un a JOIN size USING (session) CROSS JOIN range(-6, 7) o(o) JOIN un b ON b.session = a.session AND b.nth = greatest(0, least(n - 1, a.nth + o)) GROUP BY a.session, a.nth),
fr AS (SELECT session, nth, (coalesce(lead(u) OVER w, u) - coalesce(lag(u) OVER w, u)) / (CASE WHEN lead(u) OVER w IS NULL OR lag(u) OVER w IS NULL THEN 1 ELSE 2 END) * 100 / (2 * pi()) AS f FROM med WINDOW w AS (PARTITION BY session ORDER BY nth))
SELECT session, nth AS sample_idx, round(flt.x, 6) + 0.0 AS filtered, round(amp.x, 6) AS amplitude, round(cos(p), 5) + 0.0 AS cos_phase, round(slow.x, 6) + 0.0 AS amplitude_filtered, round(f, 5) + 0.0 AS frequency
FROM flt JOIN amp USING (session, nth) JOIN ph USING (session, nth) JOIN slow USING (session, nth) JOIN fr USING (session, nth)"""


@query(_BAND)
def band_pass_of_quantities(spark, sf):
    got = sg.band_pass(_samples(spark, sf), FS, (5.0, 20.0), order=1)
    r = lambda c, k: F.round(c, k) + 0.0  # noqa: E731  no signed zeros
    return got.select("session", "sample_idx", r("filtered", 6).alias("filtered"), F.round("amplitude", 6).alias("amplitude"), r(F.cos("phase"), 5).alias("cos_phase"), r("amplitude_filtered", 6).alias("amplitude_filtered"), r("frequency", 5).alias("frequency"))


@query(f"""WITH {_X}, k AS (SELECT unnest(range(31)) AS k), raw_h AS (SELECT k, CASE WHEN k = 15 THEN 0.2 ELSE sin(pi() * 0.2 * (k - 15)) / (pi() * (k - 15)) END * (0.54 - 0.46 * cos(2 * pi() * k / 30)) AS h FROM k),
h AS (SELECT k, h / sum(h) OVER () AS h FROM raw_h)
SELECT a.session, a.nth AS sample_idx, CASE WHEN a.nth BETWEEN 15 AND n - 16 THEN round(sum(h * b.x), 8) END AS filtered
FROM src a JOIN size USING (session) CROSS JOIN h LEFT JOIN src b ON b.session = a.session AND b.nth = a.nth + 15 - k GROUP BY a.session, a.nth, n""")
def filter_fir_of_quantities(spark, sf):
    got = sg.filter_signal(_samples(spark, sf), FS, "lowpass", 10.0)
    return got.select("session", "sample_idx", F.round("filtered", 8).alias("filtered"))


# components: hourly counts of events of a kind, for users of even and of odd numbers

_Z = f"""{EV}, cnt AS (SELECT kind || '-' || unit % 2 AS unit, floor(t / 3600)::BIGINT AS bin, count(*) AS n FROM ev GROUP BY 1, 2), us AS (SELECT DISTINCT unit FROM cnt),
full_ AS (SELECT us.unit, b.bin, coalesce(n, 0)::DOUBLE AS n FROM us CROSS JOIN (SELECT unnest(range(720)) AS bin) b LEFT JOIN cnt ON cnt.unit = us.unit AND cnt.bin = b.bin),
z AS MATERIALIZED (SELECT unit, bin, coalesce((n - avg(n) OVER w) / nullif(stddev_pop(n) OVER w, 0), 0) AS z FROM full_ WINDOW w AS (PARTITION BY unit))"""


def _z(spark, sf):
    e = ev(spark, sf).select(F.concat_ws("-", "kind", F.pmod("unit", F.lit(2)).cast("string")).alias("unit"), "t")
    return grid.zscore(grid.bin_counts(e, "t", 3600.0, 0.0, 720), "n", ["unit"]).select("unit", "bin", "z")


def _first_vector(matrix: str, times: int = 40) -> str:
    """CTEs after (i, j, v) of a symmetric matrix without negative eigenvalues: squared again and again it becomes the product of its first vector with itself."""
    steps = [f"q0 AS MATERIALIZED (SELECT i, j, v / max(abs(v)) OVER () AS v FROM {matrix})"]
    for t in range(times):
        steps.append(f"q{t + 1} AS MATERIALIZED (SELECT i, j, v / max(abs(v)) OVER () AS v FROM (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM q{t} a JOIN q{t} b ON a.j = b.i GROUP BY a.i, b.j))")
    steps.append(f"top AS (SELECT i AS j FROM q{times} WHERE i = j ORDER BY v DESC LIMIT 1), col AS (SELECT i, v FROM q{times} JOIN top USING (j)), vec AS MATERIALIZED (SELECT i, v / sqrt(sum(v * v) OVER ()) AS v FROM col)")
    return ",\n".join(steps)


_PATTERN = f"""WITH {_Z}, corr AS (SELECT a.unit AS i, b.unit AS j, avg(a.z * b.z) AS v FROM z a JOIN z b USING (bin) GROUP BY 1, 2),
{_first_vector('corr')}, pat AS MATERIALIZED (SELECT i AS unit, v * sign(first(v ORDER BY abs(v) DESC) OVER (ORDER BY abs(v) DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS weight FROM vec)"""


@query(f"{_PATTERN} SELECT 0 AS assembly, unit, round(weight, 6) + 0.0 AS weight FROM pat")
def assembly_patterns(spark, sf):
    got = en.assemblies(_z(spark, sf), method="pca", bound=1.0).where("assembly = 0")
    return got.select("assembly", "unit", (F.round("weight", 6) + 0.0).alias("weight"))


@query(f"{_PATTERN} SELECT 0 AS assembly, bin::INTEGER AS bin, round(pow(sum(weight * z), 2) - sum(pow(weight * z, 2)), 5) + 0.0 AS activity FROM pat JOIN z USING (unit) GROUP BY bin")
def assembly_activity_of_patterns(spark, sf):
    z = _z(spark, sf)
    got = en.assembly_activity(en.assemblies(z, method="pca", bound=1.0).where("assembly = 0"), z)
    return got.select("assembly", "bin", (F.round("activity", 5) + 0.0).alias("activity"))


_CROSS = f"""WITH {_Z}, cross_ AS MATERIALIZED (SELECT a.unit AS i, b.unit AS k, avg(a.z * b.z) AS v FROM z a JOIN z b USING (bin) WHERE a.unit LIKE '%-0' AND b.unit LIKE '%-1' GROUP BY 1, 2),
square AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM cross_ a JOIN cross_ b USING (k) GROUP BY 1, 2), {_first_vector('square')},
s AS (SELECT sqrt(sum(a.v * square.v * b.v)) AS s FROM square JOIN vec a ON a.i = square.i JOIN vec b ON b.i = square.j)"""


def _halves(z):
    return z.select("unit").distinct().withColumn("grp", F.substring_index("unit", "-", -1))


@query(f"""{_CROSS} SELECT i AS unit, '0' AS grp, round(abs(v), 6) AS weight FROM vec
UNION ALL SELECT k, '1', round(abs(sum(cross_.v * vec.v) / any_value(s)), 6) FROM cross_ JOIN vec USING (i), s GROUP BY k""")
def cross_svd_members(spark, sf):
    z = _z(spark, sf)
    return en.cross_svd(z, _halves(z), 1).select("unit", "grp", F.round(F.abs("weight"), 6).alias("weight"))


@query(f"{_CROSS} SELECT 0 AS component, round(s, 8) AS singular, true AS compared FROM s")
def cross_svd_significance(spark, sf):
    """The singular value from the table, and whether it is compared with a threshold from shuffles."""
    z = _z(spark, sf)
    got = en.cross_svd_significance(z, _halves(z), 20, 95.0, "max_stat").where("component = 0")
    told = (F.col("significant") == (F.col("singular") > F.col("threshold"))) & (F.col("threshold") > 0)
    return got.select("component", F.round("singular", 8).alias("singular"), told.alias("compared"))


@query(f"""WITH {EV}, cnt AS (SELECT unit % 2 AS unit, floor(t / 3600)::BIGINT AS bin, count(*) AS n FROM ev GROUP BY 1, 2),
full_ AS (SELECT u.unit, b.bin, coalesce(n, 0)::DOUBLE AS n FROM (VALUES (0), (1)) u(unit) CROSS JOIN (SELECT unnest(range(720)) AS bin) b LEFT JOIN cnt ON cnt.unit = u.unit AND cnt.bin = b.bin),
z AS MATERIALIZED (SELECT unit, bin, (n - avg(n) OVER w) / stddev_pop(n) OVER w AS z FROM full_ WINDOW w AS (PARTITION BY unit)), k AS (SELECT unnest(range(50)) AS shuffle)
SELECT shuffle::INTEGER AS shuffle, round(1 + abs(avg(a.z * b.z)), 9) AS largest FROM k, z a JOIN z b ON a.unit = 0 AND b.unit = 1 AND a.bin = (b.bin + shuffle * 37 + 11) % 720 GROUP BY 1""")
def null_eigenvalues(spark, sf):
    """All events of even and of odd users, the latter rolled: the larger eigenvalue of two series is one plus the size of their correlation."""
    e = ev(spark, sf).select(F.pmod("unit", F.lit(2)).alias("unit"), "t")
    z = grid.zscore(grid.bin_counts(e, "t", 3600.0, 0.0, 720), "n", ["unit"]).select("unit", "bin", "z")
    got = nulls.largest_eigenvalues(z, 50, 720, shift=F.when(F.col("unit") == 1, F.col("_s") * 37 + 11).otherwise(F.lit(0)))
    return got.select("shuffle", F.round(F.col("values")[0], 9).alias("largest"))


@query(f"""WITH {_Z}, r AS (SELECT bin // 240 AS p, a.unit, b.unit AS unit2, covar_pop(a.z, b.z) / nullif(stddev_pop(a.z) * stddev_pop(b.z), 0) AS r FROM z a JOIN z b USING (bin) WHERE a.unit < b.unit GROUP BY ALL),
x AS (SELECT max(r) FILTER (p = 0) AS pre, max(r) FILTER (p = 1) AS task, max(r) FILTER (p = 2) AS post FROM r GROUP BY unit, unit2), c AS (SELECT corr(task, post) AS tp, corr(task, pre) AS tr, corr(post, pre) AS pr FROM x)
SELECT round(pow((tp - tr * pr) / (sqrt((1 - tr * tr) * (1 - pr * pr)) + 1e-10), 2), 8) AS ev, true AS p_is_share FROM c""")
def explained_variance_p(spark, sf):
    z = _z(spark, sf).withColumn("p", F.floor(F.col("bin") / 240))
    r = co.pairwise_dense(z, "bin", "z", keys=["p"])
    pairs = r.groupBy("unit", "unit2").agg(*[F.max(F.when(F.col("p") == k, F.col("r"))).alias(n) for k, n in enumerate(("pre", "task", "post"))])
    got = en.explained_variance_p(pairs, 60)
    return got.select(F.round("ev", 8).alias("ev"), F.col("p").between(1 / 61, 1).alias("p_is_share"))


@query(f"""WITH {EV}, d AS (SELECT unit, min(t) AS start, max(t) AS stop FROM ev GROUP BY unit)
SELECT unit, i::INTEGER AS win, start + i * 43200.0 AS start, start + i * 43200.0 + 86400.0 AS stop FROM d, range(100) r(i) WHERE i < ceil((stop - start - 86400.0) / 43200.0)""")
def sliding_windows(spark, sf):
    spans = ev(spark, sf).groupBy("unit").agg(F.min("t").alias("start"), F.max("t").alias("stop"))
    return iv.sliding_windows(spans, 86400.0, 43200.0)


# sessions: kinds of events, with users in six groups as units

_RE = f"""{EV}, sp AS (SELECT kind AS session, unit % 6 AS unit, t FROM ev), span AS (SELECT session, min(t) AS a, floor((max(t) - min(t)) / 3600 + 1e-9)::BIGINT AS n FROM sp GROUP BY 1),
cnt AS (SELECT session, unit, floor((t - a) / 3600)::BIGINT AS bin, count(*) AS n FROM sp JOIN span USING (session) WHERE floor((t - a) / 3600) < span.n GROUP BY ALL),
every AS (SELECT session, unit, unnest(range(span.n)) AS bin FROM (SELECT DISTINCT session, unit FROM cnt) JOIN span USING (session)),
full_ AS (SELECT session, unit, bin, coalesce(n, 0)::DOUBLE AS n FROM every LEFT JOIN cnt USING (session, unit, bin)),
z AS MATERIALIZED (SELECT session, unit, bin, (n - avg(n) OVER w) / stddev_pop(n) OVER w AS z FROM full_ WINDOW w AS (PARTITION BY session, unit))"""


def _sessions(spark, sf):
    from ..operators.reactivation import Reactivation

    return Reactivation(ev(spark, sf).select(F.col("kind").alias("session"), F.pmod("unit", F.lit(6)).alias("unit"), "t"), weight_dt=3600.0, z_dt=3600.0)


def _first_vectors(times: int = 40) -> str:
    """The same as ``_first_vector`` for a matrix ``corr`` (session, i, j, v) of each session."""
    steps = ["q0 AS MATERIALIZED (SELECT session, i, j, v / max(abs(v)) OVER (PARTITION BY session) AS v FROM corr)"]
    for t in range(times):
        steps.append(f"q{t + 1} AS MATERIALIZED (SELECT session, i, j, v / max(abs(v)) OVER (PARTITION BY session) AS v FROM (SELECT a.session, a.i, b.j, sum(a.v * b.v) AS v FROM q{t} a JOIN q{t} b ON a.session = b.session AND a.j = b.i GROUP BY ALL))")
    steps.append(f"top AS (SELECT session, arg_max(i, v) AS j FROM q{times} WHERE i = j GROUP BY 1), vec AS (SELECT session, i, v / sqrt(sum(v * v) OVER (PARTITION BY session)) AS v FROM q{times} JOIN top USING (session, j))")
    return ",\n".join(steps)


@query(f"""WITH {_RE}, corr AS (SELECT a.session, a.unit AS i, b.unit AS j, avg(a.z * b.z) AS v FROM z a JOIN z b USING (session, bin) GROUP BY ALL), {_first_vectors()},
s AS (SELECT session, sign(arg_max(v, abs(v))) AS s FROM vec GROUP BY 1)
SELECT session, 0 AS assembly, i AS unit, round(v * s, 6) + 0.0 AS weight FROM vec JOIN s USING (session)""")
def reactivation_patterns(spark, sf):
    got = _sessions(spark, sf).find(method="pca", bound=1.0).patterns.where("assembly = 0")
    return got.select("session", "assembly", "unit", (F.round("weight", 6) + 0.0).alias("weight"))


@query(f"""WITH {_RE}, s AS (SELECT z.session, m.m AS assembly, bin, pow(sum(((unit * 7 + m.m) % 5 - 2) / 3.0 * z), 2) - sum(pow(((unit * 7 + m.m) % 5 - 2) / 3.0 * z, 2)) AS s FROM z, (VALUES (0), (1)) m(m) GROUP BY ALL),
p AS (SELECT * FROM (VALUES ('pre', 0.0, 864000.0), ('task', 864000.0, 1728000.0), ('post', 1728000.0, 2592000.0)) p(period, start, stop))
SELECT s.session, assembly, period, round(avg(s), 6) AS strength FROM s JOIN span USING (session) JOIN p ON a + (bin + 0.5) * 3600 >= p.start AND a + (bin + 0.5) * 3600 < p.stop GROUP BY ALL""")
def reactivation_strength(spark, sf):
    r = _sessions(spark, sf)
    units = r.spikes.select("session", "unit").distinct()
    weight = (F.pmod(F.col("unit") * 7 + F.col("assembly"), F.lit(5)) - 2) / 3
    patterns = units.withColumn("assembly", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("weight", weight.cast("double"))
    tenth = F.array(*[F.struct(F.lit(p).alias("period"), F.lit(k * 864000.0).alias("start"), F.lit((k + 1) * 864000.0).alias("stop")) for k, p in enumerate(("pre", "task", "post"))])
    spans = units.select("session").distinct().select("session", F.inline(tenth))
    got = r._with(patterns=patterns).mean_strength(spans)
    return got.select("session", "assembly", "period", F.round("strength", 6).alias("strength"))


@query()
def recurrent_decoder(spark, sf):
    """What a small network that was trained on all users' events tells of each event's value from the five before it and itself."""
    from ..operators import recurrent as rc

    a = 2 * F.pi() * F.pmod("t", F.lit(86400.0)) / 86400
    x = ev(spark, sf).select("unit", "event_id", (F.coalesce("value", F.lit(0.0)) / 500).alias("v"), F.sin(a).alias("s"), F.cos(a).alias("c"))
    w = rc.windows(x.withColumn("y", F.col("v") * F.col("c")), ["v", "s", "c"], ["y"], 6, "event_id", ["unit"])
    net, _ = rc.fit(w, rc.Network(3, 1, hidden=4), epochs=2, batches=2, rate=0.05)
    return rc.predict(w, net).select("unit", "event_id", F.col("y")[0].alias("y"), F.col("told")[0].alias("told"))


_TWO_PI = "(2 * pi())"


def _behaviour_files(spark, sf, name: str) -> str:
    """Behaviour files of all suppliers' runs in a new folder, written by one commit."""
    from ..sources import mat_sink, stores
    from ..sources.batch import scratch
    from .track_queries import runs

    def build(s, g) -> tuple[str, dict]:
        order = g["nth"].to_numpy().argsort()
        row = lambda c: g[c].to_numpy(float)[order][None]
        tree = {"behavior": {"timestamps": row("t"), "position": {"x": row("x"), "y": row("y"), "units": "cm"}}}
        return f"{s}/{s}.animal.behavior.mat", tree

    root = scratch(spark, name)
    stores.save_files(mat_sink.per_session(runs(spark, sf), build), root)
    return root


@query(f"""WITH {_RUNS}, v AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) / nullif(t - lag(t) OVER w, 0) AS v FROM pos WINDOW w AS (PARTITION BY session ORDER BY t)),
b AS (SELECT *, coalesce(v > 80 AND NOT coalesce(lag(v) OVER (PARTITION BY session ORDER BY t) > 80, false), false) AS bad FROM v),
k AS MATERIALIZED (SELECT session, nth, CASE WHEN NOT bad THEN x END AS x, CASE WHEN NOT bad THEN y END AS y FROM b), c AS (SELECT session, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy FROM k GROUP BY 1),
r AS (SELECT session, cx, cy, avg(sqrt(pow(x - cx, 2) + pow(y - cy, 2))) AS r FROM k JOIN c USING (session) GROUP BY ALL),
a AS (SELECT session, nth, x, y, r, atan2(y - cy, x - cx) AS a FROM k JOIN r USING (session))
SELECT session::VARCHAR AS session, nth::INTEGER AS i, x, y, round(r * CASE WHEN a < 0 THEN a + {_TWO_PI} ELSE a END, 6) AS linearized FROM a""")
def behaviour_files(spark, sf):
    """Tracking in files: jumps taken out, positions along a circle added, all read back from the files."""
    from ..sources import behaviour_files as bf

    root = _behaviour_files(spark, sf, "behaviour")
    bf.filter_jumps(spark, root, 80.0)
    bf.linearize_circle(spark, root)
    return bf.samples(spark, root).select("session", F.col("i").cast("int").alias("i"), "x", "y", F.round("linearized", 6).alias("linearized"))
