"""Queries over signals, detectors, trials and models on made signals (:mod:`.signals`); the SQL states what was planted."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import ensemble as en, models as mo, ripples as rp, signals as sg, trials as tr, tuning as tu
from .fixtures import EV, ev, table
from .signals import APART, FS, SQL_EVENTS, bell, noise, samples, tone

_N = "s AS (SELECT s_nationkey AS session, count(*) AS n FROM supplier GROUP BY 1)"
#: Which planted event a time belongs to.
_NTH = lambda c: F.round((c - 1.0) / APART).cast("int").alias("nth")


def _ripples(spark, sf, loud: bool = False):
    x = samples(spark, sf, channels=3)
    small = noise("session", "channel", "sample_idx")
    burst = bell(F.col("d"), 0.012) * tone(150.0)
    # the loud channel has the odd events, and one of its own behind the last
    other = F.when(F.col("nth") % 2 == 1, burst).otherwise(0.0) + bell(F.col("d") - 0.8, 0.012) * tone(150.0) if loud else F.lit(0.0)
    value = F.when(F.col("channel") == 0, small + burst).when(F.col("channel") == 1, small - 3 * bell(F.col("d"), 0.03)).otherwise(small + other)
    return x.select("session", "channel", "sample_idx", "t", value.alias("value"))


@query(f"WITH {SQL_EVENTS} SELECT session, nth, 150.0::DOUBLE AS frequency FROM evs")
def ripples(spark, sf):
    got = sg.ripples(_ripples(spark, sf).where("channel = 0"), FS, high=2.0, apart=0.1)
    return got.select("session", _NTH(F.col("peak")), (F.round(F.col("frequency") / 10) * 10).alias("frequency"))


@query(f"WITH {SQL_EVENTS} SELECT session, nth, 150.0::DOUBLE AS frequency, true AS short FROM evs")
def sharp_wave_ripples(spark, sf):
    got = rp.sharp_wave_ripples(_ripples(spark, sf), FS, 0, 1, 2, high=2.0, wave_longest=0.4)
    return got.select("session", _NTH(F.col("peak")), (F.round(F.col("frequency") / 10) * 10).alias("frequency"), (F.col("ripple_duration") < F.col("wave_duration")).alias("short"))


@query(f"WITH {SQL_EVENTS} SELECT session, nth FROM evs WHERE nth % 2 = 0")
def ripples_without_noise(spark, sf):
    got = rp.sharp_wave_ripples(_ripples(spark, sf, loud=True), FS, 0, 1, 2, high=2.0, noise_limit=1.0, bounds="union")
    return got.select("session", _NTH(F.col("peak")))


@query(f"WITH {SQL_EVENTS} SELECT session, nth FROM evs WHERE nth > 0 AND nth < n - 1")
def ripples_off_the_edges(spark, sf):
    return rp.sharp_wave_ripples(_ripples(spark, sf), FS, 0, high=2.0, edge=1.2, local=0.2).select("session", _NTH(F.col("peak")))


@query(f"WITH {SQL_EVENTS} SELECT session, nth, 150 AS hz FROM evs WHERE nth % 3 <> 2")
def ripples_without_artefacts(spark, sf):
    held = F.when((F.col("channel") == 0) & (F.abs(F.col("t") - 1.0 - F.round((F.col("t") - 1.0) / APART) * APART) < 0.02) & (F.round((F.col("t") - 1.0) / APART).cast("int") % 3 == 2), F.least(F.greatest("value", F.lit(-0.2)), F.lit(0.2))).otherwise(F.col("value"))
    clip = _ripples(spark, sf).withColumn("value", held)
    stuck = clip.withColumn("value", F.when((F.col("channel") == 1) & (F.round((F.col("t") - 1.0) / APART).cast("int") % 3 == 2) & (F.abs(F.col("t") - 1.0 - F.round((F.col("t") - 1.0) / APART) * APART) < 0.1), F.lit(-3.0)).otherwise(F.col("value")))
    got = rp.sharp_wave_ripples(stuck, FS, 0, None, 1, high=1.0, clipped=0.5)
    return got.select("session", _NTH(F.col("peak")), F.lit(150).alias("hz"))


@query(f"WITH {SQL_EVENTS} SELECT session, nth FROM evs")
def dentate_spikes(spark, sf):
    x = samples(spark, sf, channels=2)
    up = bell(F.col("d"), 0.008) * 5
    x = x.withColumn("value", F.when(F.col("channel") == 0, up).otherwise(-up) + noise("session", "channel", "sample_idx"))
    got = sg.dentate_spikes(x.select("session", "channel", "sample_idx", "t", "value"), FS, 0, 1, 2.0, 1.0)
    return got.select("session", _NTH(F.col("peak")))


@query(f"WITH {SQL_EVENTS} SELECT session AS epoch_id, nth FROM evs")
def up_down_states(spark, sf):
    x = samples(spark, sf, fs=500.0)
    points = x.where((F.abs("d") > 0.06) & (F.col("t") > 0.1)).select((F.col("t") + F.col("session") * 1e5).alias("t"))
    ends = x.groupBy(F.col("session").alias("epoch_id")).agg(F.max("t").alias("_e")).select("epoch_id", (F.col("epoch_id") * 1e5 + 0.3).alias("start"), (F.col("epoch_id") * 1e5 + F.col("_e") - 0.3).alias("stop"))
    got = sg.up_down_states(points, ends, threshold=1.5).where("state = 'DOWN'")
    return got.select("epoch_id", _NTH((F.col("start") + F.col("stop")) / 2 - F.col("epoch_id") * 1e5))


# filters and spectra


def _tone(spark, sf, hz, fs: float = 250.0, size: float = 0.02):
    x = samples(spark, sf, fs=fs)
    return x.select("session", "channel", "sample_idx", "t", (tone(hz) + noise("session", "sample_idx", size=size)).alias("value"))


@query(f"WITH {_N} SELECT session, 6.0::DOUBLE + session % 5 AS frequency, 1.0::DOUBLE AS amplitude FROM s")
def band_pass(spark, sf):
    x = _tone(spark, sf, F.lit(6.0) + F.col("session") % 5)
    got = sg.band_pass(x, 250.0, (4.0, 14.0), block=600.0)
    return got.where("t > 0.6 and t < 1.4").groupBy("session").agg(F.round(F.percentile("frequency", F.lit(0.5))).alias("frequency"), F.round(F.percentile("amplitude", F.lit(0.5)), 0).alias("amplitude"))


@query(f"WITH {_N} SELECT session, 38 AS lost, true AS kept FROM s")
def filter_fir(spark, sf):
    x = samples(spark, sf, fs=250.0)
    x = x.select("session", "channel", "sample_idx", "t", tone(5.0).alias("_slow"), (tone(5.0) + 0.5 * tone(90.0)).alias("value"))
    got = sg.filter_signal(x, 250.0, "lowpass", 20.0, block=600.0)
    return got.groupBy("session").agg(F.sum(F.col("filtered").isNull().cast("int")).cast("int").alias("lost"), (F.max(F.abs(F.col("filtered") - F.col("_slow"))) < 0.1).alias("kept"))


@query(
    f"""WITH {EV}, m AS (SELECT unit, avg(value) AS m FROM ev GROUP BY unit), x AS (SELECT event_id, ev.unit, t, value, value - m AS x, lag(value) OVER (PARTITION BY ev.unit ORDER BY t) AS b, lag(value - m) OVER (PARTITION BY ev.unit ORDER BY t) AS bx FROM ev JOIN m USING (unit)),
a AS (SELECT unit, avg(x * bx) / avg(x * x) AS a FROM x GROUP BY unit) SELECT event_id, unit, round(value - coalesce(b, 0) * coalesce(a, 0), 5) AS white FROM x JOIN a USING (unit)"""
)
def whiten(spark, sf):
    e = ev(spark, sf).withColumn("channel", F.lit(0))
    return sg.whiten(e.select("event_id", "unit", "t", "value"), 1, ["unit"]).select("event_id", "unit", F.round("white", 5).alias("white"))


@query(f"WITH {SQL_EVENTS} SELECT session, 1.0::DOUBLE + nth * 0.5 AS centre FROM evs WHERE nth % 4 = 0")
def clean_signal(spark, sf):
    x = samples(spark, sf, fs=250.0)
    hit = (F.col("nth") % 4 == 0) & (F.abs("d") < 0.001)
    x = x.select("session", "channel", "sample_idx", "t", (F.when(hit, 100.0).otherwise(0.0) + noise("session", "sample_idx")).alias("value"))
    _, bad = sg.clean(x, (5.0, 1e9), (0.1, 0.1))
    return bad.select("session", F.round((F.col("start") + F.col("stop")) / 2, 3).alias("centre"))


@query(f"WITH {_N} SELECT session, true AS clean, (1 + (n * 0.5 + 1.5) * 250)::BIGINT AS n FROM s")
def cleaned_samples(spark, sf):
    x = samples(spark, sf, fs=250.0)
    hit = (F.col("nth") % 4 == 0) & (F.abs("d") < 0.001)
    x = x.select("session", "channel", "sample_idx", "t", (F.when(hit, 100.0).otherwise(0.0) + noise("session", "sample_idx")).alias("value"))
    got, _ = sg.clean(x, (5.0, 1e9), (0.1, 0.1))
    return got.groupBy("session").agg((F.max("value") < 1.0).alias("clean"), F.count("value").alias("n"))


@query("SELECT 30.0::DOUBLE AS freq, 200 AS lags")
def wavelet_around(spark, sf):
    x = _tone(spark, sf, 30.0).withColumn("t", F.col("t") + F.col("session") * 1e4)
    refs = samples(spark, sf, fs=2.0).where("abs(d) < 0.01 and t > 0.6").groupBy("session").agg(F.min("t").alias("r")).select(F.col("session").alias("ref_id"), (F.col("r") + F.col("session") * 1e4).alias("r"))
    got = sg.wavelet_around(x, refs, 250.0, [10.0, 20.0, 30.0, 45.0, 60.0], -0.4, 0.4)
    return got.groupBy("freq").agg(F.avg("power").alias("p"), F.count(F.lit(1)).cast("int").alias("lags")).agg(F.max_by(F.struct("freq", "lags"), "p").alias("b")).select("b.freq", "b.lags")


@query(f"WITH {_N} SELECT session, 40.0::DOUBLE AS freq FROM s")
def signal_spectrum(spark, sf):
    got = sg.signal_spectrum(_tone(spark, sf, 40.0, size=0.2), 250.0, (5.0, 100.0))
    return got.groupBy("session").agg(F.round(F.max_by("freq", "power")).alias("freq"))


def _rhythm(spark, sf, shift: float = 0.0):
    return samples(spark, sf, fs=20.0).select(F.col("session").alias("unit"), "session", (F.col("t") + shift).alias("t"))


@query(f"WITH {_N} SELECT session AS unit, 20.0::DOUBLE AS freq FROM s")
def point_spectrum(spark, sf):
    got = sg.point_spectrum(_rhythm(spark, sf), 200.0, (8.0, 30.0))
    return got.groupBy("unit").agg(F.round(F.max_by("freq", "power")).alias("freq"))


@query(f"WITH {_N} SELECT session, 1.0::DOUBLE AS coherence FROM s")
def coherence(spark, sf):
    got = sg.coherence(_rhythm(spark, sf), _rhythm(spark, sf, 0.01), 200.0, (8.0, 30.0))
    return got.groupBy("session").agg(F.round(F.min_by("coherence", F.abs(F.col("freq") - 20.0)), 1).alias("coherence"))


@query(f"WITH {EV}, u AS (SELECT unit, count(DISTINCT event_id % 50) AS k FROM ev GROUP BY unit) SELECT unit, -4.0::DOUBLE AS slope, 1.0::DOUBLE AS rho FROM u WHERE k > 4")
def phase_precession(spark, sf):
    x = ev(spark, sf).select("unit", ((F.col("event_id") % 50) / 50.0).alias("x"))
    x = x.withColumn("phase", F.pmod(1.0 - 4.0 * F.col("x"), F.lit(2 * np.pi)))
    span = x.groupBy("unit").agg((F.max("x") - F.min("x")).alias("w"), F.countDistinct("x").alias("k"))
    got = sg.phase_precession(x).join(span, "unit").where("k > 4")
    return got.select("unit", F.round(F.col("slope") / F.col("w"), 1).alias("slope"), F.round(F.abs("rho"), 1).alias("rho"))


@query(
    """WITH e AS (SELECT vec_id, embedding AS e FROM embeddings), x AS (SELECT vec_id, unnest(range(2, len(e))) AS k, e FROM e)
SELECT vec_id, (k - 1)::INTEGER AS channel, round(-0.3 * (e[k - 1]::DOUBLE - 2 * e[k]::DOUBLE + e[k + 1]::DOUBLE) / 0.04, 4) AS csd FROM x"""
)
def current_source_density(spark, sf):
    x = table(spark, sf, "embeddings").select(F.lit(0).alias("session"), F.col("vec_id").alias("sample_idx"), F.posexplode("embedding").alias("channel", "value")).withColumn("value", F.col("value").cast("double"))
    return sg.current_source_density(x, 0.2).select(F.col("sample_idx").alias("vec_id"), "channel", F.round("csd", 4).alias("csd"))


@query(f"WITH {EV} SELECT DISTINCT kind, true AS parted, true AS two FROM ev")
def bimodal_threshold(spark, sf):
    x = ev(spark, sf).select("kind", (F.col("value") + (F.col("event_id") % 2) * 5000).alias("value"))
    ends = x.groupBy("kind").agg(F.max(F.when(F.col("value") < 2500, F.col("value"))).alias("lo"), F.min(F.when(F.col("value") >= 2500, F.col("value"))).alias("hi"))
    got = sg.bimodal(x, "value", ["kind"], n_boot=20).join(ends, "kind")
    return got.select("kind", F.col("threshold").between(F.col("lo") * 0.5, F.col("hi")).alias("parted"), (F.col("p") < 0.06).alias("two"))


@query(f"WITH {_N} SELECT session, 0.125::DOUBLE AS duration, true AS steady FROM s")
def theta_cycles(spark, sf):
    got = tr.theta_cycles(_tone(spark, sf, 8.0), 250.0, block=600.0)
    return got.groupBy("session").agg(F.round(F.percentile("duration", F.lit(0.5)) * 40) / 40, (F.avg(F.col("is_burst").cast("int")) > 0.4).alias("steady")).toDF("session", "duration", "steady")


# behaviour


def _shuttle(spark, sf):
    """Back and forth on a track of 100, a second each way, from its far end."""
    x = samples(spark, sf, fs=50.0)
    return x.select("session", "t", (F.abs(F.pmod("t", F.lit(2.0)) - 1.0) * 100).alias("lin"), F.when(F.pmod(F.floor("t"), F.lit(4)) == 1, "left").otherwise("right").alias("state"))


_LAPS = f"{_N}, k AS (SELECT session, unnest(range(floor(n * 0.5 + 1.5)::BIGINT)) AS k FROM s)"


@query(f"WITH {_LAPS} SELECT session, k::DOUBLE AS start, k + 1.0::DOUBLE AS stop, CASE WHEN k % 2 = 0 THEN 'inbound' ELSE 'outbound' END AS direction FROM k")
def linear_maze_trials(spark, sf):
    return tr.linear_maze(_shuttle(spark, sf)).select("session", F.round("start", 1).alias("start"), F.round("stop", 1).alias("stop"), "direction")


@query(f"WITH {_LAPS} SELECT session, k::DOUBLE AS start, CASE WHEN k % 4 = 1 THEN 'left' ELSE 'right' END AS side FROM k WHERE k % 2 = 1")
def t_maze_trials(spark, sf):
    return tr.t_maze(_shuttle(spark, sf)).select("session", F.round("start", 1).alias("start"), "side")


@query(f"WITH {_LAPS} SELECT session, k::DOUBLE AS k, CASE k % 4 WHEN 0 THEN 'Center_Right' WHEN 1 THEN 'Right_Center' WHEN 2 THEN 'Center_Left' ELSE 'Left_Center' END AS trajectory FROM k")
def w_maze_trials(spark, sf):
    x = samples(spark, sf, fs=50.0).select("session", "t", (50 + 50 * tone(0.25)).alias("x"), F.lit(0.0).alias("y"))
    got = tr.w_maze(x, [(1, 0.0, 0.0), (2, 50.0, 0.0), (3, 100.0, 0.0)], {1: "Left", 2: "Center", 3: "Right"}, 10.0, 10.0)
    return got.select("session", F.floor((F.col("start") + F.col("stop")) / 2).cast("double").alias("k"), "trajectory")


@query(f"WITH {SQL_EVENTS} SELECT session, nth FROM evs")
def cheeseboard_trials(spark, sf):
    x = samples(spark, sf, fs=100.0)
    x = x.select("session", "t", F.when(F.abs("d") < 0.12, 60.0).otherwise(noise("session", "sample_idx", size=1.0)).alias("x"), noise("sample_idx", "session", size=1.0).alias("y"))
    got = tr.cheeseboard(x, (0.0, 0.0), 15.0, 5.0, 0.1)
    return got.select("session", _NTH((F.col("start") + F.col("stop")) / 2))


@query(f"WITH {_N} SELECT session, 0 AS wrong, ((n * 0.5 + 1.5) * 20 + 1)::DOUBLE AS n FROM s")
def track_states(spark, sf):
    x = samples(spark, sf, fs=20.0).select("session", "t", (F.abs(F.pmod("t", F.lit(8.0)) - 4.0) * 25).alias("x"), noise("session", "sample_idx", size=2.0).alias("y"))
    got = sg.track_states(x, [(0, 0.0, 0.0, 50.0, 0.0), (1, 50.0, 0.0, 100.0, 0.0)])
    wrong = (F.abs(F.col("x") - 50) > 8) & ((F.col("x") > 50) != (F.col("segment") == 1))
    return got.groupBy("session").agg(F.sum((wrong | (F.abs(F.col("x") - F.col("lin")) > 8)).cast("int")).cast("int").alias("wrong"), F.count(F.lit(1)).cast("double").alias("n"))


# models


def _linear(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("b"), (3 * F.col("l_quantity") - 200 * F.col("l_discount")).alias("u"), (1.5 * F.col("l_quantity") - 100 * F.col("l_discount")).alias("v"), F.pmod("l_orderkey", F.lit(5)).alias("fold"))


def _weights(spark, model):
    rows = [(x, y, round(float(model.weights[i, j]), 5)) for i, x in enumerate(model.xs) for j, y in enumerate(model.ys)]
    return spark.createDataFrame(rows, "x string, y string, weight double")


_W = "SELECT * FROM (VALUES ('a', 'u', 3.0::DOUBLE), ('b', 'u', -2.0::DOUBLE), ('a', 'v', 1.5::DOUBLE), ('b', 'v', -1.0::DOUBLE)) t(x, y, weight)"


@query(_W)
def ridge_regression(spark, sf):
    return _weights(spark, mo.ridge(_linear(spark, sf), ["a", "b"], ["u", "v"]))


@query(_W)
def reduced_rank_regression(spark, sf):
    return _weights(spark, mo.reduced_rank(_linear(spark, sf), ["a", "b"], ["u", "v"], 1))


@query("SELECT 'u' AS y, 1.0::DOUBLE AS r2 UNION ALL SELECT 'v', 1.0::DOUBLE")
def kernel_reduced_rank(spark, sf):
    rows = _linear(spark, sf)
    got = mo.KernelReducedRank(["a", "b"], ["u", "v"], 1, 1e-6).fit(rows).predict(rows)
    scores = [en.regression_scores(got, y, f"pred_{y}").select(F.lit(y).alias("y"), F.round("r2", 6).alias("r2")) for y in ("u", "v")]
    return scores[0].unionByName(scores[1])


@query("SELECT f::INTEGER AS fold, 1.0::DOUBLE AS r2 FROM range(5) t(f)")
def cross_validated_regression(spark, sf):
    return mo.cross_validated(_linear(spark, sf), ["a", "b"], ["u", "v"], "fold", 5, 1e-9).withColumn("r2", F.round("r2", 6))


@query("SELECT round(1 - avg(pow(l_extendedprice - 1000 * l_quantity, 2)) / var_pop(l_extendedprice), 6) AS r2, round(sqrt(avg(pow(l_extendedprice - 1000 * l_quantity, 2))), 3) AS rmse FROM lineitem")
def regression_scores(spark, sf):
    li = table(spark, sf, "lineitem").select("l_extendedprice", (1000 * F.col("l_quantity")).alias("p"))
    return en.regression_scores(li, "l_extendedprice", "p").select(F.round("r2", 6).alias("r2"), F.round("rmse", 3).alias("rmse"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, round(sum((l_quantity - m) / s), 6) AS z FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem WHERE l_orderkey % 5 <> 0) GROUP BY ALL")
def standardised_on_training(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    got = en.standardise(li, ["l_quantity"], F.col("l_orderkey") % 5 != 0)
    return got.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 6).alias("z"))


@query("SELECT p_brand, (dense_rank() OVER (ORDER BY p_brand) - 1)::INTEGER AS index FROM (SELECT DISTINCT p_brand FROM part)")
def label_index(spark, sf):
    return mo.label_index(table(spark, sf, "part").select("p_brand").distinct(), "p_brand").select("p_brand", "index")


@query("SELECT true AS learned")
def classifier(spark, sf):
    rows = _linear(spark, sf).select("a", "b", (F.col("a") > 25).cast("double").alias("label"))
    scaled = en.standardise(rows, ["a", "b"], F.lit(True))
    got = mo.classifier(scaled, ["a", "b"], "label", (4,)).transform(scaled)
    return got.agg((F.avg((F.col("prediction") == F.col("label")).cast("int")) > 0.95).alias("learned"))


@query("SELECT 0.8::DOUBLE AS pole")
def identify_system(spark, sf):
    # x(k + 1) = 0.8 x(k) + u(k), unrolled over what still counts
    e = table(spark, sf, "events").select(F.lit(0).alias("session"), F.col("event_id").alias("i"), noise("event_id", size=2.0).alias("u"))
    from pyspark.sql import Window

    w = Window.partitionBy(F.floor(F.col("i") / 1000)).orderBy("i")
    past = [F.coalesce(F.lag("u", k).over(w), F.lit(0.0)) * 0.8 ** (k - 1) for k in range(1, 80)]
    rows = e.withColumn("y", sum(past[1:], past[0])).withColumn("session", F.floor(F.col("i") / 1000))
    a, _ = mo.identify_system(rows, ["u"], ["y"], "i", 1)
    return spark.createDataFrame([(round(float(a[0, 0]), 1),)], "pole double")


# fields of two-dimensional maps


def _bumps(spark, sf):
    """A map of 40 x 30 for each region: two bumps, whose centres depend on it."""
    r = table(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("unit"))
    x = r.withColumn("bx", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("by", F.explode(F.sequence(F.lit(0), F.lit(29))))
    hill = lambda x0, y0, h, w: h * F.exp(-(F.pow(F.col("bx") - x0, F.lit(2)) + F.pow(F.col("by") - y0, F.lit(2))) / (2 * w * w))
    return x.withColumn("rate", hill(10 + F.col("unit"), F.lit(10), 20.0, 2.5) + hill(F.lit(30), 15 + F.col("unit"), 12.0, 3.0))


_BUMPS = "SELECT r_regionkey::INTEGER AS unit, 1 AS field, 10.0::DOUBLE + r_regionkey AS x, 10.0::DOUBLE AS y FROM region UNION ALL SELECT r_regionkey::INTEGER, 2, 30.0::DOUBLE, 15.0::DOUBLE + r_regionkey FROM region"


@query(_BUMPS)
def place_fields_2d(spark, sf):
    return tu.field_centres(tu.place_fields(_bumps(spark, sf), 4.1, 0.2, 10, 600, 0.5))


@query(_BUMPS)
def fields_by_laplace(spark, sf):
    return tu.field_centres(tu.separate_fields(_bumps(spark, sf), "laplace", threshold=0.1, smallest=4))


@query(_BUMPS)
def fields_by_laplace_of_gaussian(spark, sf):
    return tu.field_centres(tu.separate_fields(_bumps(spark, sf), "laplace_of_gaussian", sigma=1.5, smallest=4)).where("field <= 2")


@query(_BUMPS)
def fields_by_dilation(spark, sf):
    return tu.field_centres(tu.separate_fields(_bumps(spark, sf), "dilation", sigma=1.5, seed=1.0, smallest=4)).where("field <= 2")


@query("SELECT r_regionkey::INTEGER AS unit, true AS first, true AS second FROM region")
def blobs(spark, sf):
    got = tu.blobs(_bumps(spark, sf), [2.0, 2.5, 3.0, 3.5, 4.0], 0.5)
    at = lambda x, y: F.max((F.hypot(F.col("bx") - x, F.col("by") - y) <= 1.5).cast("int")) == 1
    return got.groupBy("unit").agg(at(10 + F.col("unit"), F.lit(10)).alias("first"), at(F.lit(30), 15 + F.col("unit")).alias("second"))


@query("SELECT r_regionkey::INTEGER AS unit, true AS whole FROM region")
def linear_place_field(spark, sf):
    row = _bumps(spark, sf).where("by = 10").select("unit", "bx", "rate")
    got = tu.linear_place_fields(row, 5, 1.0, 0.5)
    return got.where("field").groupBy("unit").agg(((F.min("bx") <= 10 + F.col("unit")) & (F.max("bx") >= 10 + F.col("unit"))).alias("whole"))
