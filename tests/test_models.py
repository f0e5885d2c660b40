import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import correlate as co, models, trials


def table(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 3))
    w = np.outer([1.0, 2.0, -1.0], [1.0, 0.5])
    y = x @ w + 0.01 * rng.standard_normal((n, 2))
    rows = [(int(i % 5), *map(float, x[i]), *map(float, y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "fold int, a double, b double, c double, y double, z double"), w


def test_regressions_recover_the_map(spark):
    rows, w = table(spark)
    xs, ys = ["a", "b", "c"], ["y", "z"]
    for m in (models.ridge(rows, xs, ys), models.reduced_rank(rows, xs, ys, 1), models.KernelReducedRank(xs, ys, 1, 0.01).fit(rows).model):
        assert np.allclose(m.weights, w, atol=0.02) and m.score(rows) > 0.99
    assert abs(models.ridge(rows, xs, ys).predict(rows).agg(F.avg(F.col("pred_y") - F.col("y"))).first()[0]) < 0.01
    assert all(r.r2 > 0.99 for r in models.cross_validated(rows, xs, ys, "fold", 5).collect())


def test_system_identification_finds_the_poles(spark):
    rng = np.random.default_rng(1)
    a = np.array([[0.9, 0.2], [-0.2, 0.9]])
    s, rows = np.zeros(2), []
    for t in range(1500):
        u = rng.standard_normal()
        rows.append(("s", t, float(u), float(s[0] + 0.01 * rng.standard_normal())))
        s = a @ s + np.array([1.0, 0.5]) * u
    got, _ = models.identify_system(spark.createDataFrame(rows, "session string, t int, u double, y double"), ["u"], ["y"], "t", 2)
    assert np.allclose(sorted(np.linalg.eigvals(got), key=lambda v: v.imag), sorted(np.linalg.eigvals(a), key=lambda v: v.imag), atol=0.1)


def test_trials(spark):
    p = [("s", float(i), 50.0 if 20 <= i < 60 else 0.0 + (i % 2) * 0.1, 0.0) for i in range(100)]
    got = trials.cheeseboard(spark.createDataFrame(p, "session string, t double, x double, y double"), (0.0, 0.0)).collect()
    assert [(r.start, r.stop) for r in got] == [(20.0, 59.0)]
    walk = [("s", float(t), float(t % 10) * 3, float(t // 10 % 10) * 3) for t in range(400)]
    spans = trials.open_field(spark.createDataFrame(walk, "session string, t double, x double, y double"), step=20.0, method="proportion").orderBy("start").collect()
    assert len(spans) >= 3 and spans[0].start == 0


def test_theta_cycles(spark):
    t = np.arange(0, 4, 1 / 250)
    rows = [("s", 0, float(a), float(np.sin(2 * np.pi * 8 * a))) for a in t]
    c = trials.theta_cycles(spark.createDataFrame(rows, "session string, channel int, t double, value double"), 250.0)
    mid = c.where("start between 0.5 and 3.3").collect()
    assert len(mid) > 18 and all(abs(r.duration - 0.125) < 0.02 and r.is_burst for r in mid)
    assert trials.burst_epochs(c).count() >= 1


def test_correlogram_tests(spark):
    rng = np.random.default_rng(2)
    n = [int(v) for v in rng.poisson(20, 101)]
    peak = [v + (60 if 45 <= i <= 55 else 0) for i, v in enumerate(n)]
    rows = [(0, 1, i, v) for i, v in enumerate(n)] + [(0, 2, i, v) for i, v in enumerate(peak)]
    got = {r.unit2: r.modulated for r in co.significant_modulation(spark.createDataFrame(rows, "unit int, unit2 int, bin int, n long"), kernel=10).collect()}
    assert got == {1: False, 2: True}
    counts = spark.createDataFrame([(0, i, 3 if i == 5 else 0) for i in range(11)], "unit int, bin int, n long")
    auto = spark.createDataFrame([(0, 5, 10)], "unit int, bin int, n long")
    r = {x.bin: x.rate for x in co.deconvolved(counts, auto).collect()}
    assert abs(r[5] - 0.3) < 1e-9 and r[0] == 0


def test_kernel_reduced_rank_learns_from_all_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((6000, 3))
    y = x @ rng.standard_normal((3, 2)) + rng.standard_normal((6000, 2))
    rows = spark.createDataFrame(np.c_[x, y].tolist() + [[None, 0.0, 0.0, 1.0, 1.0]], "a double, b double, c double, y double, z double")
    got = models.KernelReducedRank(["a", "b", "c"], ["y", "z"], 1, 2.0).fit(rows).model.weights
    full = np.linalg.solve(x.T @ x + 2.0 * np.eye(3), x.T @ y)
    v = np.linalg.svd(x @ full, full_matrices=False)[2][:1]
    assert np.abs(got - full @ v.T @ v).max() < 1e-9


def open_field_in_memory(t, x, y, size, step, least):
    """Spans of one session by correlation of visited places, as plain loops over histograms."""
    bins = np.linspace(t.min(), t.max(), int(np.ceil((t.max() - t.min()) / step)))
    xe, ye = (np.arange(np.floor(v.min()), np.ceil(v.max()) + size, size) for v in (x, y))
    seen = lambda keep: np.histogram2d(x[keep], y[keep], (xe, ye))[0].ravel() > 0
    every, out, first = seen(np.ones(len(t), bool)), [], 0
    for i in range(len(bins) - 1):
        keep = (t >= bins[first]) & ((t < bins[i + 1]) if i < len(bins) - 2 else (t <= bins[i + 1]))
        if np.corrcoef(every, seen(keep))[0, 1] > least:
            out.append((bins[first], bins[i + 1]))
            first = i + 1
    return out


def test_open_field_by_correlation(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for s in ("a", "b"):
        xy = np.cumsum(rng.normal(0, 1.5, (900, 2)), axis=0)
        t = np.sort(rng.uniform(0, 900, 900))
        want[s] = open_field_in_memory(t, xy[:, 0], xy[:, 1], 3, 60.0, 0.6)
        rows += [(s, float(a), float(b), float(c)) for a, (b, c) in zip(t, xy)]
    rows += [("a", 5.0, None, 1.0), ("a", 6.0, float("nan"), 1.0)]
    got = trials.open_field(spark.createDataFrame(rows, "session string, t double, x double, y double").repartition(5)).orderBy("start").collect()
    for s in want:
        assert [(r.start, r.stop) for r in got if r.session == s] == [tuple(map(pytest.approx, w)) for w in want[s]] and want[s]
    with pytest.raises(ValueError, match="share"):
        trials.open_field(spark.createDataFrame(rows, "session string, t double, x double, y double"), method="share")
