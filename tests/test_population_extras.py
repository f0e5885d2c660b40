import numpy as np
from pyspark.sql import functions as F

from pulsegrid.functions import dsp
from pulsegrid.operators import correlate as co, ensemble as en, grid, tuning as tu


def test_best_pairs_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for shape in ((4, 4), (3, 5), (5, 3)):
        m = rng.random(shape)
        got = sum(m[i, j] for i, j in en.best_pairs(m))
        a = m if shape[0] <= shape[1] else m.T
        assert abs(got - max(sum(a[i, p[i]] for i in range(len(a))) for p in permutations(range(a.shape[1]), len(a)))) < 1e-12


def test_cross_svd_finds_the_shared_pair(spark):
    rng = np.random.default_rng(1)
    rows = []
    for b in range(400):
        s = rng.standard_normal()
        rows += [(u, b, float((2 * s if u in (0, 3) else 0) + rng.standard_normal())) for u in range(6)]
    z = grid.zscore(spark.createDataFrame(rows, "unit int, bin int, n double"), "n", ["unit"])
    g = spark.createDataFrame([(u, "a" if u < 3 else "b") for u in range(6)], "unit int, grp string")
    w = {r.unit: abs(r.weight) for r in en.cross_svd(z, g, 1).collect()}
    assert w[0] > 0.9 and w[3] > 0.9 and max(w[1], w[2], w[4], w[5]) < 0.4


def test_planted_assemblies_have_their_size(spark):
    x = en.planted_assemblies(spark, [[0, 1]], n_units=4, n_bins=300)
    assert x.count() == 1200 and x.where("n < 0").count() == 0


def test_dense_pairs_equal_the_plain_form(spark):
    rows = [(u, b, float((b * (u + 2)) % 7)) for u in range(6) for b in range(25)] + [(9, b, 1.0) for b in range(25)]
    s = spark.createDataFrame(rows, "unit int, bin int, n double")
    a = {(r.unit, r.unit2): r.r for r in co.pairwise(s, "bin", "n").collect()}
    b = {(r.unit, r.unit2): r.r for r in co.pairwise_dense(s, "bin", "n", blocks=3).collect()}
    assert a.keys() == b.keys() and all((a[k] is None and b[k] is None) or abs(a[k] - b[k]) < 1e-9 for k in a)


def test_pass_mapping_and_precession(spark):
    rows = [(0, float(i), float(i) - 10, 0.0) for i in range(21)]
    got = tu.pass_on_unit_circle(spark.createDataFrame(rows, "pass_id int, t double, x double, y double"), (0.0, 0.0), F.lit(10.0)).orderBy("t").collect()
    assert abs(got[0].along + 1) < 1e-9 and abs(got[-1].along - 1) < 1e-9 and abs(got[10].r) < 1e-9
    rng = np.random.default_rng(2)
    phases = np.concatenate([2 * np.pi * k / 1.15 + rng.normal(0, 0.3, 2) for k in range(200)])
    f, m = dsp.nonspatial_precession(phases)
    assert abs(f - 1.15) < 0.12 and m > 2
