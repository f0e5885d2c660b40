"""Queries over maps, posteriors, populations and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import correlate as co, decode as de, ensemble as en, grid, perievent as pe, stats as st, tuning as tu
from .fixtures import DAY, EV, POS, ev, position, rounded, spikes, table

AX = ("x", 0.5, 5.0, 10)
AY = ("y", -0.5, 1.0, 11)
_BX = "least(floor((x - 0.5) / 5.0), 9)::INTEGER AS bx"
_BY = "least(floor((y + 0.5) / 1.0), 10)::INTEGER AS \"by\""


@query(f"WITH {POS} SELECT {_BX}, count(*) / 50.0::DOUBLE AS occ FROM pos WHERE x BETWEEN 0.5 AND 50.5 GROUP BY 1")
def occupancy_1d(spark, sf):
    return tu.occupancy(position(spark, sf), [AX], 50.0)


@query(f"WITH {POS} SELECT {_BX}, {_BY}, count(*) / 50.0::DOUBLE AS occ FROM pos WHERE x BETWEEN 0.5 AND 50.5 AND y BETWEEN -0.5 AND 10.5 GROUP BY 1, 2")
def occupancy_2d(spark, sf):
    return tu.occupancy(position(spark, sf), [AX, AY], 50.0)


_MAP = f"""{POS}, occ AS (SELECT {_BX}, count(*) / 50.0::DOUBLE AS occ FROM pos GROUP BY 1), pts AS (SELECT session AS unit, {_BX} FROM pos WHERE z > 50000), u AS (SELECT DISTINCT unit FROM pts), c AS (SELECT unit, bx, count(*) AS n FROM pts GROUP BY ALL),
map AS (SELECT u.unit, occ.bx, coalesce(n, 0) AS n, occ, coalesce(n, 0) / occ AS rate FROM u CROSS JOIN occ LEFT JOIN c ON c.unit = u.unit AND c.bx = occ.bx)"""


def _map(spark, sf):
    pos = position(spark, sf)
    return tu.rate_map(pos.where("z > 50000").withColumnRenamed("session", "unit"), tu.occupancy(pos, [AX], 50.0), [AX])


@query(f"WITH {_MAP} SELECT unit, bx, n, occ, round(rate, 9) AS rate FROM map")
def ratemap_1d(spark, sf):
    return _map(spark, sf).withColumn("rate", F.round("rate", 9))


_MAP2 = f"""{POS}, occ AS (SELECT {_BX}, {_BY}, count(*) / 50.0::DOUBLE AS occ FROM pos GROUP BY 1, 2), pts AS (SELECT session % 8 AS unit, {_BX}, {_BY} FROM pos WHERE z > 50000), u AS (SELECT DISTINCT unit FROM pts), c AS (SELECT unit, bx, "by", count(*) AS n FROM pts GROUP BY ALL),
map AS (SELECT u.unit, occ.bx, occ."by", coalesce(n, 0) AS n, occ, CASE WHEN occ < 0.5 THEN 0 ELSE coalesce(n, 0) / occ END AS rate FROM u CROSS JOIN occ LEFT JOIN c ON c.unit = u.unit AND c.bx = occ.bx AND c."by" = occ."by")"""


def _map2(spark, sf):
    pos = position(spark, sf).withColumn("unit", F.col("session") % 8)
    return tu.rate_map(pos.where("z > 50000"), tu.occupancy(pos, [AX, AY], 50.0), [AX, AY], min_duration=0.5, floor_first=False)


@query(f'WITH {_MAP2} SELECT unit, bx, "by", n, occ, round(rate, 9) AS rate FROM map')
def ratemap_2d(spark, sf):
    return _map2(spark, sf).withColumn("rate", F.round("rate", 9))


@query(f"WITH {POS} SELECT {_BX}, {_BY}, round(avg(z), 6) AS mean, count(*) AS n FROM pos GROUP BY 1, 2")
def mean_map(spark, sf):
    return tu.mean_map(position(spark, sf), [AX, AY], "z").withColumn("mean", F.round("mean", 6))


@query(
    f"""WITH {_MAP}, p AS (SELECT *, occ / sum(occ) OVER (PARTITION BY unit) AS p FROM map), m AS (SELECT unit, sum(p * rate) AS m, sum(p * rate * rate) AS q, max(rate) AS x FROM p GROUP BY unit),
i AS (SELECT p.unit, sum(CASE WHEN rate > 0 THEN p * rate / m * log2(rate / m) ELSE 0 END) AS i FROM p JOIN m USING (unit) GROUP BY p.unit)
SELECT unit, round(i, 9) AS information, round(i * m, 9) AS information_rate, round(m * m / q, 9) AS sparsity, round(x / m, 9) AS selectivity FROM m JOIN i USING (unit)"""
)
def spatial_information(spark, sf):
    got = tu.information(_map(spark, sf))
    return got.select("unit", *[F.round(c, 9).alias(c) for c in ("information", "information_rate", "sparsity", "selectivity")])


def whole_shuffle_spatial_information(spark, sf):
    from pyspark.sql import Window

    # numbered in order of i: inside runs of 32,768 values, after what the runs before hold
    pos = position(spark, sf).withColumn("run", F.shiftright("i", 15))
    sizes = pos.groupBy("run").agg(F.count(F.lit(1)).alias("size"))  # a row a run
    before = sizes.select("run", (F.sum("size").over(Window.orderBy("run")) - F.col("size")).alias("before"))
    n = sizes.agg(F.sum("size")).first()[0]
    rows = pos.join(before, "run").withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("run").orderBy("i")) - 1)
    return tu.shuffle_information(rows, "k", n, ["x", "y"], [AX], (F.col("z") > 50000).cast("int"), 50, 50.0)


@query(
    f"""WITH {_MAP}, n AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY bx) AS i FROM map), o AS (SELECT *, i - row_number() OVER (PARTITION BY unit ORDER BY bx) AS g FROM n WHERE rate > 0.4)
SELECT unit, min(bx) AS first, max(bx) AS last, count(*) AS n, round(max(rate), 9) AS peak, round(avg(rate), 9) AS mean FROM o GROUP BY unit, g HAVING count(*) BETWEEN 1 AND 6"""
)
def find_fields_1d(spark, sf):
    got = tu.fields_1d(_map(spark, sf), 0.4, 1, 6)
    return got.select("unit", "first", "last", "n", F.round("peak", 9).alias("peak"), F.round("mean", 9).alias("mean"))


@query(f"WITH {_MAP}, p AS (SELECT unit, arg_max(bx, (rate, -bx)) AS peak FROM map GROUP BY unit) SELECT unit, peak, (row_number() OVER (ORDER BY peak, unit) - 1)::INTEGER AS \"order\" FROM p")
def peak_order(spark, sf):
    return tu.peak_order(_map(spark, sf))


@query(f"WITH {_MAP}, p AS (SELECT a.unit, b.unit AS unit2, covar_pop(a.rate, b.rate) AS c, stddev_pop(a.rate) AS x, stddev_pop(b.rate) AS y FROM map a JOIN map b ON a.bx = b.bx AND a.unit < b.unit GROUP BY ALL) SELECT unit, unit2, round(CASE WHEN x * y > 0 THEN c / (x * y) END, 9) + 0.0::DOUBLE AS r FROM p")
def pairwise_spatial_corr(spark, sf):
    return tu.spatial_correlation(_map(spark, sf), ["bx"]).withColumn("r", F.round("r", 9) + F.lit(0.0))


@query(
    f"""WITH {_MAP2}, near AS (SELECT a.unit, a.bx, a."by", max(b.rate) AS top FROM map a JOIN map b ON a.unit = b.unit AND abs(a.bx - b.bx) <= 1 AND abs(a."by" - b."by") <= 1 GROUP BY ALL)
SELECT m.unit, m.bx, m."by", round(m.rate, 9) AS rate FROM map m JOIN near USING (unit, bx, "by") WHERE m.rate >= top AND m.rate > 0"""
)
def find_peaks(spark, sf):
    return tu.local_peaks(_map2(spark, sf)).select("unit", "bx", "by", F.round("rate", 9).alias("rate"))


_SQLC = f"cnt AS (SELECT unit, least(floor(t / {DAY}), 29)::INTEGER AS tbin, count(*) AS n FROM ev GROUP BY ALL)"
_TUN = "tun AS (SELECT unit, floor((t % 86400) / 3600)::INTEGER AS bx, count(*) / 30.0::DOUBLE AS rate FROM ev GROUP BY ALL), oc AS (SELECT floor((t % 86400) / 3600)::INTEGER AS bx, count(*)::DOUBLE AS occ FROM ev GROUP BY ALL)"
_POST = f"""{EV}, {_SQLC}, {_TUN}, full_t AS (SELECT u.unit, o.bx, coalesce(rate, 0) AS rate FROM (SELECT DISTINCT unit FROM tun) u CROSS JOIN oc o LEFT JOIN tun ON tun.unit = u.unit AND tun.bx = o.bx),
pri AS (SELECT bx, ln(occ / (SELECT sum(occ) FROM oc)) - 0.5 * (SELECT sum(rate) FROM full_t f WHERE f.bx = oc.bx) AS b FROM oc),
lik AS (SELECT tbin, bx, sum(n * ln(rate + 1e-10)) AS l FROM cnt JOIN full_t USING (unit) GROUP BY ALL), s AS (SELECT tbin, bx, b + l AS s FROM lik JOIN pri USING (bx)),
e AS (SELECT tbin, bx, exp(s - max(s) OVER (PARTITION BY tbin)) AS e FROM s), post AS (SELECT tbin, bx, e / sum(e) OVER (PARTITION BY tbin) AS p FROM e)"""


def _posterior(spark, sf):
    e = ev(spark, sf)
    hour = F.floor((F.col("t") % 86400) / 3600).cast("int").alias("bx")
    counts = e.groupBy("unit", F.least(F.floor(F.col("t") / DAY), F.lit(29)).cast("int").alias("tbin")).agg(F.count(F.lit(1)).alias("n"))
    occ = e.groupBy(hour).agg(F.count(F.lit(1)).cast("double").alias("occ"))
    rate = e.groupBy("unit", hour).agg((F.count(F.lit(1)) / 30.0).alias("rate"))
    full = e.select("unit").distinct().join(occ.select("bx")).join(rate, ["unit", "bx"], "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    return de.bayes(counts, full, occ, 0.5)


@query(f"WITH {_POST} SELECT tbin, bx, round(p, 8) AS p FROM post")
def bayes_decode(spark, sf):
    return _posterior(spark, sf).withColumn("p", F.round("p", 8))


@query(f"WITH {_POST} SELECT tbin, round(sum(bx * p) / sum(p), 6) AS bx FROM post GROUP BY tbin")
def position_com(spark, sf):
    return de.estimate(_posterior(spark, sf), ["tbin"]).withColumn("bx", F.round("bx", 6))


@query(f"WITH {_POST} SELECT tbin, arg_max(bx, (round(p, 12), -bx))::DOUBLE AS bx FROM post GROUP BY tbin")
def position_max(spark, sf):
    return de.estimate(_posterior(spark, sf).withColumn("p", F.round("p", 12)), ["tbin"], method="max")


@query(
    f"""WITH {_POST}, g AS (SELECT tbin // 6 AS event, sum(p) AS w, sum(p * tbin) / sum(p) AS t, sum(p * tbin * tbin) / sum(p) AS tt, sum(p * bx) / sum(p) AS x, sum(p * bx * bx) / sum(p) AS xx, sum(p * bx * tbin) / sum(p) AS xt FROM post GROUP BY 1)
SELECT event::INTEGER AS event, round(CASE WHEN (xx - x * x) * (tt - t * t) > 1e-12 THEN (xt - x * t) / sqrt((xx - x * x) * (tt - t * t)) END, 6) AS corr_bx FROM g""",
)
def weighted_corr(spark, sf):
    p = _posterior(spark, sf).withColumn("event", F.floor(F.col("tbin") / 6).cast("int"))
    return de.weighted_correlation(p).withColumn("corr_bx", F.round("corr_bx", 6))


@query(
    f"""WITH {_POST}, c AS (SELECT tbin, sum(bx * p) / sum(p) AS bx FROM post GROUP BY tbin), j AS (SELECT tbin // 6 AS event, abs(bx - lag(bx) OVER (PARTITION BY tbin // 6 ORDER BY tbin)) AS s FROM c)
SELECT event::INTEGER AS event, round(max(s), 6) AS max_jump, round(avg(s), 6) AS mean_jump FROM j GROUP BY event""",
)
def jump_distance(spark, sf):
    c = de.estimate(_posterior(spark, sf), ["tbin"]).withColumn("event", F.floor(F.col("tbin") / 6).cast("int"))
    return de.jump_distance(c).select("event", F.round("max_jump", 6).alias("max_jump"), F.round("mean_jump", 6).alias("mean_jump"))


def whole_replay_scores(spark, sf):
    p = _posterior(spark, sf).withColumn("event", F.floor(F.col("tbin") / 6).cast("int"))
    return de.scored_replay(p, 40, 24)


@query(
    f"""WITH {EV}, v AS (SELECT floor(t / {5 * DAY})::INTEGER AS epoch, unit, t FROM ev)
SELECT a.epoch, a.unit, b.unit AS unit2, round(2 * sum((a.t <= b.t)::INTEGER) / count(*)::DOUBLE - 1, 9) AS bias FROM v a JOIN v b ON a.epoch = b.epoch AND a.unit <> b.unit GROUP BY ALL""",
)
def skew_bias(spark, sf):
    e = spikes(spark, sf).withColumn("epoch", F.floor(F.col("t") / (5 * DAY)).cast("int"))
    return de.skew_bias(e).withColumn("bias", F.round("bias", 9))


def whole_bias_significance(spark, sf):
    e = spikes(spark, sf)
    return de.bias_significance(e.where(f"t < {10 * DAY}"), e.where(f"t >= {10 * DAY}").withColumn("epoch", F.floor(F.col("t") / (5 * DAY)).cast("int")), 30)


# circular and other statistics

_ANG = f"{EV}, ang AS (SELECT unit, kind, 2 * pi() * (t % 86400) / 86400 AS a, value FROM ev)"


def _angles(spark, sf):
    return ev(spark, sf).select("unit", "kind", (2 * F.pi() * (F.col("t") % 86400) / 86400).alias("a"), "value")


@query(f"WITH {_ANG}, g AS (SELECT unit, atan2(sum(sin(a)), sum(cos(a))) AS m FROM ang GROUP BY unit) SELECT unit, round(CASE WHEN m < 0 THEN m + 2 * pi() ELSE m END, 8) AS mean FROM g")
def circ_mean(spark, sf):
    return _angles(spark, sf).groupBy("unit").agg(F.round(st.circular_mean(F.col("a")), 8).alias("mean"))


@query(f"WITH {_ANG} SELECT unit, round(sqrt(pow(sum(value * cos(a)) / sum(value), 2) + pow(sum(value * sin(a)) / sum(value), 2)), 8) AS r FROM ang GROUP BY unit")
def resultant_length(spark, sf):
    return _angles(spark, sf).groupBy("unit").agg(F.round(st.resultant(F.col("a"), F.col("value")), 8).alias("r"))


@query(
    f"""WITH {_ANG}, g AS (SELECT unit, count(*)::DOUBLE AS n, sqrt(pow(avg(cos(a)), 2) + pow(avg(sin(a)), 2)) AS r FROM ang GROUP BY unit)
SELECT unit, n, round(r, 8) AS r, round(n * r * r, 8) AS z, round(exp(sqrt(1 + 4 * n + 4 * (n * n - n * r * n * r)) - (1 + 2 * n)), 8) AS p FROM g"""
)
def rayleigh(spark, sf):
    return st.rayleigh(_angles(spark, sf), "a", ["unit"]).select("unit", "n", *[F.round(c, 8).alias(c) for c in ("r", "z", "p")])


@query(f"WITH {_ANG}, g AS (SELECT unit, atan2(sum(sin(a)), sum(cos(a))) AS m FROM ang GROUP BY unit) SELECT unit, round(sum(sin(a - m)), 6) + 0.0::DOUBLE AS s, round(sum(cos(a - m)), 6) + 0.0::DOUBLE AS c FROM ang JOIN g USING (unit) GROUP BY unit")
def circ_center(spark, sf):
    x = st.centred(_angles(spark, sf), "a", ["unit"])
    zero = lambda c: F.round(c, 6) + F.lit(0.0)
    return x.groupBy("unit").agg(zero(F.sum(F.sin("centred"))).alias("s"), zero(F.sum(F.cos("centred"))).alias("c"))


@query(f"WITH {_ANG}, q AS (SELECT kind, quantile_cont(((a - 1.0) + 4 * pi()) % (2 * pi()), 0.25) + 1.0 AS q FROM ang GROUP BY kind) SELECT kind, round(q % (2 * pi()), 8) AS q FROM q")
def circ_percentile(spark, sf):
    return _angles(spark, sf).groupBy("kind").agg(F.round(st.circular_percentile(F.col("a"), 25, 1.0), 8).alias("q"))


@query(
    f"""WITH {_ANG}, x AS (SELECT kind, a, value / 20.0 AS b FROM ang), m AS (SELECT kind, atan2(sum(sin(a)), sum(cos(a))) AS ma, atan2(sum(sin(b)), sum(cos(b))) AS mb FROM x GROUP BY kind)
SELECT kind, round(sum(sin(a - ma) * sin(b - mb)) / sqrt(sum(pow(sin(a - ma), 2)) * sum(pow(sin(b - mb), 2))), 8) AS rho, count(*) AS n FROM x JOIN m USING (kind) GROUP BY kind"""
)
def circ_correlation(spark, sf):
    return st.circular_correlation(_angles(spark, sf).withColumn("b", F.col("value") / 20.0), "a", "b", ["kind"]).withColumn("rho", F.round("rho", 8))


@query(f"WITH {EV}, m AS (SELECT unit, avg(value) AS m, stddev_pop(value) AS s FROM ev GROUP BY unit) SELECT event_id, unit, round(CASE WHEN s > 0 THEN (value - m) / s ELSE 0 END, 8) AS z FROM ev JOIN m USING (unit)")
def zscore(spark, sf):
    return grid.zscore(ev(spark, sf), "value", ["unit"]).select("event_id", "unit", F.round("z", 8).alias("z"))


_G = grid.gaussian(1.5)
_COUNTS = f"cnt AS (SELECT u.unit, i::INTEGER AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT unit FROM ev) u CROSS JOIN range(30) g(i) LEFT JOIN (SELECT unit, least(floor(t / {DAY}), 29)::INTEGER AS bin, count(*) AS n FROM ev GROUP BY ALL) c ON c.unit = u.unit AND c.bin = i)"


def _counts(spark, sf):
    return grid.bin_counts(spikes(spark, sf), "t", DAY, 0.0, 30)


@query(
    f"WITH {EV}, {_COUNTS}, w AS (SELECT unnest([{', '.join(f'{x!r}::DOUBLE' for x in _G)}]) AS w, unnest(range({len(_G)})) AS k) SELECT a.unit, a.bin, round(sum(b.n * w) / sum(w), 8) AS n FROM cnt a JOIN cnt b ON a.unit = b.unit JOIN w ON abs(a.bin - b.bin) = k GROUP BY ALL"
)
def smooth_gauss(spark, sf):
    x = _counts(spark, sf).withColumn("n", F.col("n").cast("double"))
    return grid.smooth(x, "n", "bin", 1.5, ["unit"]).select("unit", "bin", F.round("n", 8).alias("n"))


@query(f"WITH {EV}, m AS (SELECT unit, covar_pop(value, t) / var_pop(t) AS s, avg(t) AS mt FROM ev GROUP BY unit) SELECT event_id, unit, round(value - s * (t - mt), 6) AS residual FROM ev JOIN m USING (unit)")
def regress_out(spark, sf):
    return st.regress_out(ev(spark, sf), "value", "t", ["unit"]).select("event_id", "unit", F.round("residual", 6).alias("residual"))


_SIG = f"""{EV}, sc AS (SELECT unit, avg(value) - 50 AS score FROM ev WHERE kind = 'error' GROUP BY unit), sh AS (SELECT unit, value - 50 AS shuffled FROM ev WHERE kind <> 'error')"""


@query(
    f"""WITH {_SIG}, x AS (SELECT sc.unit, score, shuffled FROM sc LEFT JOIN sh USING (unit))
SELECT unit, round(score, 8) AS score, round((count(*) FILTER (WHERE abs(shuffled) >= abs(score)) + 1) / (count(shuffled) + 1)::DOUBLE, 8) AS p, round((score - avg(shuffled)) / stddev_pop(shuffled), 6) AS z, coalesce(abs(score) > quantile_cont(abs(shuffled), 0.95), false) AS significant FROM x GROUP BY unit, score"""
)
def significance(spark, sf):
    e = ev(spark, sf)
    sc = st.ordered_mean(e.where("kind = 'error'"), "value", "event_id", ["unit"], "score").withColumn("score", F.col("score") - 50)
    sh = e.where("kind <> 'error'").select("unit", (F.col("value") - 50).alias("score"))
    got = st.significant(sc, sh, ["unit"])
    return got.select("unit", F.round("score", 8).alias("score"), F.round("p", 8).alias("p"), F.round("z", 6).alias("z"), "significant")


@query("SELECT p_partkey, p_size, count(*) AS copies FROM part, range(50) r(i) WHERE i < p_size % 5 GROUP BY ALL")
def reindex_weight(spark, sf):
    p = table(spark, sf, "part").withColumn("w", F.col("p_size") % 5)
    return st.repeat_rows(p, "w").groupBy("p_partkey", "p_size").agg(F.count(F.lit(1)).alias("copies"))


@query(
    f"""WITH {EV}, k AS (SELECT unit, count(*) / 1000.0::DOUBLE AS p FROM ev GROUP BY unit), r AS (SELECT *, row_number() OVER (ORDER BY p, unit) AS r, count(*) OVER () AS n FROM k)
SELECT unit, p, round(least(min(p * n / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING), 1.0), 9) AS adjusted FROM r"""
)
def benjamini_hochberg(spark, sf):
    k = ev(spark, sf).groupBy("unit").agg((F.count(F.lit(1)) / 1000.0).alias("p")).withColumn("one", F.lit(1))
    return st.benjamini_hochberg(k, "p", ["one"], ["unit"]).select("unit", "p", F.round("adjusted", 9).alias("adjusted"))


# populations

_DOT = "list_sum(list_transform(list_zip(a.e, b.e), lambda q: q[1] * q[2]))"
_EMB = "em AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


@query(f"WITH {_EMB}, nn AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM em) SELECT a.vec_id, b.vec_id AS key2, round({_DOT} / (a.n * b.n), 6) AS cosine FROM nn a JOIN nn b ON a.vec_id < b.vec_id AND a.label <> b.label")
def cosine_pairs(spark, sf):
    v = table(spark, sf, "embeddings")
    return en.similarity_pairs(v, "embedding", "vec_id", "label").withColumn("cosine", rounded("cosine", 6))


def whole_similarity_index(spark, sf):
    return en.similarity_index(table(spark, sf, "embeddings"), "embedding", "vec_id", 50)


@query(
    f"""WITH {_EMB}, h AS (SELECT (max(vec_id) + 2) // 2 AS h FROM em), d AS (SELECT a.vec_id, b.vec_id + h AS k2, sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda q: pow(q[1] - q[2], 2)))) AS d FROM em a, em b, h WHERE a.vec_id >= h AND b.vec_id < h)
SELECT vec_id, round(1 - max(CASE WHEN vec_id = k2 THEN d END) / avg(d), 6) AS proximity FROM d GROUP BY vec_id""",
)
def proximity(spark, sf):
    v = table(spark, sf, "embeddings")
    half = (v.agg(F.max("vec_id")).first()[0] + 2) // 2
    a, b = v.where(F.col("vec_id") >= half), v.where(F.col("vec_id") < half).withColumn("vec_id", F.col("vec_id") + half)
    return en.proximity(a, b, "embedding", "vec_id").withColumn("proximity", F.round("proximity", 6))


_PAIR = """SELECT a.unit, b.unit AS unit2, a.bin // 10 AS period, covar_pop(a.n, b.n) AS c, stddev_pop(a.n) AS x, stddev_pop(b.n) AS y FROM cnt a JOIN cnt b ON a.bin = b.bin AND a.unit < b.unit GROUP BY ALL"""


@query(
    f"""WITH {EV}, {_COUNTS}, p AS ({_PAIR}), r AS (SELECT unit, unit2, max(CASE WHEN period = 0 AND x * y > 0 THEN c / (x * y) END) AS pre, max(CASE WHEN period = 1 AND x * y > 0 THEN c / (x * y) END) AS task, max(CASE WHEN period = 2 AND x * y > 0 THEN c / (x * y) END) AS post FROM p GROUP BY ALL),
k AS (SELECT corr(task, post) AS tp, corr(task, pre) AS tr, corr(post, pre) AS pr FROM r WHERE pre IS NOT NULL AND task IS NOT NULL AND post IS NOT NULL)
SELECT round(pow((tp - tr * pr) / (sqrt((1 - tr * tr) * (1 - pr * pr)) + 1e-10), 2), 8) AS ev, round(pow((tr - tp * pr) / (sqrt((1 - tp * tp) * (1 - pr * pr)) + 1e-10), 2), 8) AS rev FROM k"""
)
def explained_variance(spark, sf):
    c = _counts(spark, sf).withColumn("period", F.floor(F.col("bin") / 10))
    return en.explained_variance_of(c, "bin", "n", "period", 0, 1, 2).select(F.round("ev", 8).alias("ev"), F.round("rev", 8).alias("rev"))


@query(
    f"""WITH {EV}, {_COUNTS}, z AS (SELECT unit, bin, n - avg(n) OVER (PARTITION BY unit) AS z FROM cnt), p AS (SELECT u.unit, a.i::INTEGER AS assembly, sin(u.unit + a.i) AS w FROM (SELECT DISTINCT unit FROM cnt) u CROSS JOIN range(3) a(i))
SELECT assembly, bin, round(pow(sum(w * z), 2) - sum(pow(w * z, 2)), 6) AS activity FROM z JOIN p USING (unit) GROUP BY ALL"""
)
def assembly_activity(spark, sf):
    from pyspark.sql import Window

    z = _counts(spark, sf).withColumn("z", F.col("n") - F.avg("n").over(Window.partitionBy("unit")))
    p = z.select("unit").distinct().select("unit", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("assembly")).withColumn("weight", F.sin(F.col("unit") + F.col("assembly")))
    return en.assembly_activity(p, z).withColumn("activity", F.round("activity", 6))


@query()
def assembly_patterns_of_events(spark, sf):
    z = grid.zscore(_counts(spark, sf), "n", ["unit"])
    return en.members(en.assemblies(z, method="ica", bound=1.5))


@query(
    f"""WITH {EV}, {_COUNTS}, z AS (SELECT unit, bin, n::DOUBLE AS z FROM cnt) SELECT a.unit, b.unit AS unit2, round(avg(a.z * b.z), 8) AS cov FROM z a JOIN z b ON a.bin = b.bin AND a.unit < b.unit AND a.unit % 3 <> b.unit % 3 GROUP BY ALL""",
)
def cross_structural_covariance(spark, sf):
    z = _counts(spark, sf).withColumn("z", F.col("n").cast("double"))
    g = z.select("unit").distinct().withColumn("grp", F.col("unit") % 3)
    return en.cross_structural_covariance(z, g).withColumn("cov", F.round("cov", 8))


@query(
    f"""WITH {EV}, x AS (SELECT least(floor(value / 50.0), 9)::INTEGER AS s, floor(t / {6 * DAY})::INTEGER AS d, lead(value) OVER (PARTITION BY unit ORDER BY t) - value AS x FROM ev),
m AS (SELECT d, s, avg(x) AS m FROM x WHERE x IS NOT NULL GROUP BY ALL), p AS (SELECT d, s, -sum(m) OVER (PARTITION BY d ORDER BY s ROWS UNBOUNDED PRECEDING) AS p FROM m)
SELECT d AS domain, s AS state, round(p - coalesce(max(CASE WHEN s = 1 THEN p END) OVER (PARTITION BY d), 0), 6) AS potential FROM p"""
)
def potential_landscape(spark, sf):
    e = ev(spark, sf)
    got = en.potential_landscape(e, F.least(F.floor(F.col("value") / 50.0), F.lit(9)).cast("int"), F.floor(F.col("t") / (6 * DAY)).cast("int"), "t", ["unit"], 1)
    return got.withColumn("potential", F.round("potential", 6))


@query(f"WITH {EV}, {_COUNTS}, h AS (SELECT unit, bin, list(n) OVER (PARTITION BY unit ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS h FROM cnt) SELECT unit, bin, CASE WHEN len(h) = 5 THEN array_to_string(h, ',') END AS history FROM h")
def history_features(spark, sf):
    got = en.history_features(_counts(spark, sf), "n", "bin", 3, 1)
    return got.select("unit", "bin", F.array_join(F.col("history").cast("array<string>"), ",").alias("history"))


@query("SELECT label, count(*) AS n, 5 AS folds, (count(*) - 1) // 5 + 1 AS largest FROM embeddings GROUP BY label")
def kfold_split(spark, sf):
    f = en.k_folds(table(spark, sf, "embeddings"), 5, "label", "vec_id").groupBy("label", "fold").agg(F.count(F.lit(1)).alias("k"))
    return f.groupBy("label").agg(F.sum("k").alias("n"), F.count(F.lit(1)).cast("int").alias("folds"), F.max("k").alias("largest"))


_GRID = f"{EV}, {_COUNTS}, gr AS (SELECT unit AS r, bin AS c, n::DOUBLE AS v FROM cnt)"


def _grid(spark, sf):
    return _counts(spark, sf).select(F.col("unit").cast("int").alias("r"), F.col("bin").alias("c"), F.col("n").cast("double").alias("v"))


@query(f"WITH {_GRID}, k AS (SELECT (5 - (max(r) + 1) % 5) % 5 // 2 AS k FROM gr) SELECT floor((r + k) / 5)::INTEGER AS r, floor((c + 1) / 4)::INTEGER AS c, round(avg(v), 9) AS v FROM gr, k GROUP BY 1, 2")
def shrink(spark, sf):
    g = _grid(spark, sf)
    return grid.shrink(g, "r", "c", "v", 5, 4, g.agg(F.max("r")).first()[0] + 1, 30).withColumn("v", F.round("v", 9))


@query(f"WITH {_GRID} SELECT (c - r)::INTEGER AS diagonal, round(avg(v), 9) AS mean FROM gr GROUP BY 1")
def average_diagonal(spark, sf):
    return grid.average_diagonal(_grid(spark, sf), "r", "c", "v").select("diagonal", F.round("mean", 9).alias("mean"))


@query(
    f"""WITH {_GRID}, k AS (SELECT *, sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY c ROWS UNBOUNDED PRECEDING) AS a, sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY c DESC ROWS UNBOUNDED PRECEDING) AS b FROM gr)
SELECT r::INTEGER AS r, c, CASE WHEN a > 0 AND b > 0 THEN v END AS v FROM k""",
)
def border_zeros(spark, sf):
    return grid.border_zeros_to_null(_grid(spark, sf), "v", "c", ["r"])


@query(f"WITH {_GRID} SELECT r::INTEGER AS r, coalesce(min(CASE WHEN v > 4 THEN c END), -1) AS first, coalesce(max(CASE WHEN v > 4 THEN c END), -1) AS last FROM gr GROUP BY r")
def terminal_indices(spark, sf):
    return grid.terminal_true(_grid(spark, sf), F.col("v") > 4, "c", ["r"])


@query(f"WITH {_GRID} SELECT r::INTEGER AS r, ((c + r * 3) % 30)::INTEGER AS c, v FROM gr")
def circular_shift(spark, sf):
    return grid.circular_shift(_grid(spark, sf), "c", 30, F.col("r") * 3)


@query(
    f"""WITH {_GRID}, m AS (SELECT sum(v * r) / sum(v) AS mr, sum(v * c) / sum(v) AS mc, avg(r) AS fr, avg(c) AS fc FROM gr), d AS (SELECT v, pow(r - mr, 2) + pow(c - mc, 2) AS d, pow(r - fr, 2) + pow(c - fc, 2) AS f FROM gr, m)
SELECT round(sum(v * d) / sum(v) / avg(f), 9) AS moment, round(sqrt(sum(v * d) / sum(v) / avg(f)), 9) AS spread FROM d""",
)
def image_spread(spark, sf):
    got = grid.image_spread(_grid(spark, sf), "r", "c", "v")
    return got.select(F.round("moment", 9).alias("moment"), F.round("spread", 9).alias("spread"))


