import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import dsp, images, special
from pulsegrid.operators import signals as sg


def test_butterworth_response():
    for kind, band, good, bad in [("bandpass", [6, 12], 9, 50), ("lowpass", [10], 2, 100), ("highpass", [50], 200, 5), ("bandstop", [40, 60], 10, 49)]:
        sos = dsp.butter_sos(4, band, 1000, kind)
        h = lambda f: np.prod([(np.exp(-2j * np.pi * f / 1000 * np.arange(3)) @ s[:3]) / (np.exp(-2j * np.pi * f / 1000 * np.arange(3)) @ s[3:]) for s in sos])  # noqa: B023, E731
        assert abs(abs(h(good)) - 1) < 0.02 and abs(h(bad)) < 0.02
        edge = band[0]
        assert abs(abs(h(edge)) - np.sqrt(0.5)) < 0.01


def test_section_equals_the_recursion():
    rng = np.random.default_rng(0)
    x, sos = rng.standard_normal(1000), dsp.butter_sos(3, [6, 12], 1250)
    y = x.copy()
    for b0, b1, b2, _, a1, a2 in sos:
        s1 = s2 = 0.0
        out = np.empty_like(y)
        for i, v in enumerate(y):
            out[i] = b0 * v + s1
            s1, s2 = b1 * v - a1 * out[i] + s2, b2 * v - a2 * out[i]
        y = out
    assert np.allclose(dsp.sos_filter(sos, x), y)


def test_zero_phase_keeps_a_tone_in_place():
    t = np.arange(5000) / 1000
    x = np.sin(2 * np.pi * 9 * t) + np.sin(2 * np.pi * 80 * t)
    y = dsp.zero_phase(dsp.butter_sos(3, [6, 12], 1000), x)
    assert np.abs(y - np.sin(2 * np.pi * 9 * t))[500:-500].max() < 0.02
    assert np.allclose(np.abs(dsp.analytic(np.cos(2 * np.pi * 10 * t)))[100:-100], 1, atol=1e-6)
    f = dsp.instantaneous_frequency(2 * np.pi * 7 * t, t)
    assert np.allclose(f[20:-20], 7)


def test_fir_and_whitening():
    t = np.arange(1000) / 1000
    x = np.sin(2 * np.pi * t) + 0.5 * np.sin(2 * np.pi * 50 * t)
    y = dsp.filter_signal(x, 1000, "bandpass", (40, 60))
    ok = ~np.isnan(y)
    assert ok.sum() > 900 and np.abs(y[ok]).max() < 0.6 and np.isnan(y[0])
    rng = np.random.default_rng(1)
    e, z = rng.standard_normal(20000), np.zeros(20000)
    for i in range(2, 20000):
        z[i] = 0.6 * z[i - 1] - 0.3 * z[i - 2] + e[i]
    rho, s = dsp.yule_walker(z, 2)
    assert np.allclose(rho, [0.6, -0.3], atol=0.03) and abs(s - 1) < 0.03


def test_tapers_are_orthonormal_and_concentrated():
    v, lam = dsp.dpss(256, 2.5, 4)
    assert np.allclose(v @ v.T, np.eye(4), atol=1e-8) and (lam > 0.9).all() and (lam <= 1 + 1e-9).all()
    rng = np.random.default_rng(2)
    t = np.sort(np.concatenate([k / 8 + rng.normal(0, 0.005, 1) for k in range(400)]))
    f, p, _ = dsp.spectrum_points(t, 200, (2, 30))
    assert abs(f[np.argmax(p)] - 8) < 0.3
    f, _, c = dsp.coherence_points(t, t + 0.01, 200, (2, 30))
    assert c[np.argmin(abs(f - 8))] > 0.8


def test_precession_slope():
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, 400)
    phase = np.mod(-4 * x + 1 + rng.normal(0, 0.1, 400), 2 * np.pi)
    slope, _, rho = dsp.precession(phase, x)
    assert abs(slope + 4) < 0.3 and rho < -0.5


def test_distributions():
    assert abs(special.student_cdf(2.228138852, 10) - 0.975) < 1e-8
    assert abs(special.poisson_cdf(2, 3.0) - 0.42319008) < 1e-7
    assert abs(special.kendall([1, 2, 3, 4], [1, 3, 2, 4]) - 2 / 3) < 1e-12
    assert special.correlation_p(0.0, 10) == pytest.approx(1.0)


def test_images():
    m = np.array([[1, 1, 0, 0], [0, 0, 0, 1], [1, 0, 1, 1]], bool)
    l = images.label(m)
    assert l.max() == 3 and l[0, 0] == l[0, 1] and l[1, 3] == l[2, 2] and l[2, 0] not in (l[0, 0], l[1, 3])
    y, x = np.mgrid[0:180, 0:240]
    rate = 20 * np.exp(-((x - 60) ** 2 + (y - 60) ** 2) / 200) + 12 * np.exp(-((x - 170) ** 2 + (y - 100) ** 2) / 300) + np.random.default_rng(0).uniform(0, 1, (180, 240))
    f = images.place_fields(rate, 3, 0.2, 10, 20_000, 2)
    assert f[60, 60] == 1 and f[100, 170] == 2 and f[0, 0] == 0
    labels, stats = images.place_fields_1d(np.exp(-((np.arange(100) - 30) ** 2) / 50) * 10)
    assert labels[30] == 1 and len(stats) == 1


def test_thresholds():
    rng = np.random.default_rng(4)
    two = np.r_[rng.normal(-3, 1, 500), rng.normal(3, 1, 500)]
    assert abs(sg.bimodal_threshold(two)) < 1.5
    assert np.isnan(sg.bimodal_threshold(rng.normal(0, 1, 500)))


def session(spark, bursts=(1.5, 3.0, 5.5)):
    rng = np.random.default_rng(5)
    fs = 1250.0
    t = np.arange(int(8 * fs)) / fs
    x = rng.normal(0, 1, len(t))
    for b in bursts:
        x += 12 * np.exp(-((t - b) ** 2) / (2 * 0.02**2)) * np.sin(2 * np.pi * 150 * t)
    return spark.createDataFrame([("s", 0, i, float(a), float(v)) for i, (a, v) in enumerate(zip(t, x))], "session string, channel int, sample_idx long, t double, value double"), fs


def test_ripples_are_found(spark):
    signal, fs = session(spark)
    got = sg.ripples(signal, fs, apart=0.05).orderBy("start").collect()
    assert [round(r.peak, 1) for r in got] == [1.5, 3.0, 5.5]
    assert all(120 < r.frequency < 180 and r.duration > 0.02 for r in got)


def test_cleaning_and_band(spark):
    signal, fs = session(spark, ())
    dirty = signal.withColumn("value", F.when(F.col("t").between(2.0, 2.01), 60.0).otherwise(F.col("value")))
    clean, bad = sg.clean(dirty)
    assert clean.agg(F.max("value")).first()[0] < 10 and bad.count() == 1
    b = sg.band_pass(signal, fs, (6, 12))
    assert {"filtered", "phase", "amplitude", "amplitude_filtered", "frequency"} <= set(b.columns) and b.count() == signal.count()
    assert sg.whiten(signal).where("white is null").count() == 0
    assert sg.signal_spectrum(signal, fs, (1, 40)).count() > 10


def test_up_down_states(spark):
    rng = np.random.default_rng(6)
    t = [x for u in range(10) for x in np.arange(0, 20, 0.001)[rng.random(20000) < 0.25] if all(abs(x - c) > 0.1 for c in (4, 7, 15))]
    p = spark.createDataFrame([(float(x),) for x in t], "t double")
    e = spark.createDataFrame([(0, 0.0, 20.0)], "epoch_id int, start double, stop double")
    got = sg.up_down_states(p, e, percentile=3.5).where("state = 'DOWN'").orderBy("start").collect()
    found = [(r.start + r.stop) / 2 for r in got]
    assert all(any(abs(f - c) < 0.05 for f in found) for c in (4, 7, 15))


def test_laps_and_track(spark):
    ramp = list(np.linspace(0, 100, 100))
    x = (ramp + ramp[::-1]) * 2 + ramp
    p = spark.createDataFrame([("s", float(i), float(v)) for i, v in enumerate(x)], "session string, t double, lin double")
    got = sg.laps(p).orderBy("start").collect()
    assert [r.direction for r in got] == ["outbound", "inbound", "outbound", "inbound", "outbound"]
    xy = spark.createDataFrame([("s", float(i), float(i), 0.1) for i in range(50)], "session string, t double, x double, y double")
    s = sg.track_states(xy, [(0, 0, 0, 25, 0), (1, 25, 0, 50, 0)]).orderBy("t").collect()
    assert s[0].segment == 0 and s[-1].segment == 1 and abs(s[30].lin - 30) < 3


def test_blocks_of_time_give_what_the_whole_channel_gives(spark):
    signal, fs = session(spark)
    signal = signal.cache()
    key = lambda d, c: np.array([r[0] for r in d.orderBy("t").select(c).collect()], float)
    whole, parts = sg.band_pass(signal, fs, (100.0, 200.0)), sg.band_pass(signal, fs, (100.0, 200.0), block=1.5, margin=0.5)
    assert parts.count() == signal.count()
    for c in ("filtered", "amplitude"):
        assert np.abs(key(whole, c) - key(parts, c))[200:-200].max() < 1e-2
    fir = [key(sg.filter_signal(signal, fs, "lowpass", 50.0, **o), "filtered") for o in ({}, {"block": 1.0, "margin": 0.3})]
    assert np.isnan(fir[0]).sum() == np.isnan(fir[1]).sum() and np.nanmax(np.abs(fir[0] - fir[1])) < 1e-9
    got = sg.ripples(signal, fs, apart=0.05, block=2.0, margin=0.5).orderBy("start").collect()
    assert [round(r.peak, 1) for r in got] == [1.5, 3.0, 5.5]
