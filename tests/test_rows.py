"""Equal rows, ties, borders of buckets and other places where rows get lost."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import dsp, images
from pulsegrid.operators import correlate as co, decode as de, ensemble as en, intervals as iv, joins, perievent as pe, sequences as sq, signals as sg


def test_equal_points_all_stay(spark):
    p = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (5.0, "b"), (20.0, "c"), (None, "d")], "t double, name string")
    e = spark.createDataFrame([(7, 0.0, 2.0), (3, 1.0, 6.0)], "epoch_id int, start double, stop double")
    got = sorted((r.t or -1, r.name, r.interval) for r in iv.membership(p, e, "t", 4.0).collect())
    assert got == [(-1, "d", None), (1.0, "a", 3), (1.0, "a", 3), (5.0, "b", 3), (20.0, "c", None)], "the last by start, not the greatest id"


def test_equal_intervals_all_stay_in_a_semi_join(spark):
    a = spark.createDataFrame([(0.0, 9.0, 1), (0.0, 9.0, 1), (0.0, 9.0, 2), (50.0, 51.0, 3)], "start double, stop double, k int")
    b = spark.createDataFrame([(1.0, 2.0), (4.0, 8.5)], "start2 double, stop2 double")
    assert sorted(r.k for r in joins.overlap_join(a, b, 2.0, how="left_semi").collect()) == [1, 1, 2]


def test_projection_keeps_equal_rows_and_rows_without_a_place(spark):
    rows = spark.createDataFrame([(5.0, 1.0), (5.0, 1.0), (None, 2.0), (0.0, 7.0)], "x double, y double")
    seg = spark.createDataFrame([(0, 0.0, 0.0, 10.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0, 10.0, 10.0), (2, 3.0, 3.0, 3.0, 3.0, 20.0)], "segment int, x0 double, y0 double, x1 double, y1 double, before double")
    got = sorted((r.segment if r.segment is not None else -1, r.lin) for r in sq.project_to_track(rows, seg).collect())
    assert got == [(-1, None), (0, 5.0), (0, 5.0), (1, 17.0)]


@pytest.mark.parametrize("width", [0.7, 3.0, 1000.0])
def test_neighbours_in_buckets_of_any_width(spark, width):
    rng = np.random.default_rng(3)
    left = [(int(k), float(t)) for k, t in zip(rng.integers(0, 3, 60), rng.integers(0, 40, 60))]
    right = [(int(k), float(t), float(v)) for k, t, v in zip(rng.integers(0, 2, 25), rng.integers(0, 40, 25), rng.random(25))]
    got = joins.neighbours(spark.createDataFrame(left, "k int, t double"), spark.createDataFrame(right, "k int, t double, v double"), "t", ["v"], ["k"], width).collect()
    assert len(got) == len(left)
    for r in got:
        before, after = [x for x in right if x[0] == r.k and x[1] <= r.t], [x for x in right if x[0] == r.k and x[1] >= r.t]
        b, a = max(before, key=lambda x: (x[1], x[2]), default=None), min(after, key=lambda x: (x[1], -x[2]), default=None)
        assert (r._before and (r._before._t, r._before._v.v)) == (b and b[1:])
        assert (r._after and (r._after._t, r._after._v.v)) == (a and a[1:])


@pytest.mark.parametrize("width", [1.0, 2.0, 500.0])
def test_runs_of_candidates_cross_the_borders_of_chunks(spark, width):
    com = [3, 4, 5, 5, 40, 6, 7, 8, 9, 10] * 40
    post = spark.createDataFrame([(i, c, 1.0) for i, c in enumerate(com)], "tbin int, bx int, p double")
    speed = spark.createDataFrame([(0.0, 1000.0, 1.0)], "lo double, hi double, speed double")
    got = sorted((r.first, r.last, r.n) for r in de.replay_candidates(post, speed, 0.5, width, max_jump=20.0, merge_gap=2, min_bins=3).collect())
    ok = [i == 0 or abs(com[i] - com[i - 1]) < 20 for i in range(len(com))]
    want, run = [], []
    for i in [i for i, g in enumerate(ok) if g]:
        if run and i - run[-1] > 2:
            want.append(run)
            run = []
        run.append(i)
    want = [(r[0], r[-1], len(r)) for r in [*want, run] if len(r) >= 3]
    assert got == want


def test_fields_end_at_the_least_rate():
    rate = np.zeros((20, 20))
    rate[5:15, 5:15] = 2.0
    rate[8:12, 8:12] = 10.0
    assert (images.place_fields(rate, 3.0, 0.1, 1, 400) > 0).sum() == 16
    assert (images.place_fields(rate, 1.0, 0.1, 1, 400) > 0).sum() == 100


def test_bins_without_points_are_zero(spark):
    p = spark.createDataFrame([(1, 0.0), (1, 1.0), (2, 50.0), (3, 1.2)], "unit int, t double")
    r = spark.createDataFrame([(9, 0.0), (8, 500.0)], "ref_id int, r double")
    got = {(x.ref_id, x.bin): x.rate for x in pe.peth_matrix(p, r, 1.0, 4).collect()}
    assert len(got) == 10 and sum(got.values()) == 3 and all(not v for (ref, _), v in got.items() if ref == 8)
    assert co.correlogram(p, 1.0, 4).count() == 15
    pairs = co.correlogram(p, 1.0, 4, same=False).collect()
    assert len(pairs) == 15 and sum(x.n for x in pairs) == 2


def test_rotation_over_tasks_equals_the_one_at_hand(spark, monkeypatch, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = np.random.default_rng(5)
    z = [(u, b, float(2 * (u < 3 and b % 7 == 0) + 2 * (3 <= u < 6 and b % 5 == 0) + 0.5 * rng.standard_normal())) for b in range(400) for u in range(9)]
    z = spark.createDataFrame(z, "unit int, bin int, z double").repartition(4, "bin").checkpoint()
    here = {(r.assembly, r.unit): r.weight for r in en.assemblies(z, method="ica", bound=0.8).collect()}
    monkeypatch.setattr(en.Projected, "MOST", 0)
    spread = {(r.assembly, r.unit): r.weight for r in en.assemblies(z, method="ica", bound=0.8).collect()}
    assert len(here) == 18 and here.keys() == spread.keys() and all(abs(here[k] - spread[k]) < 1e-3 for k in here)


def test_matrix_of_units_with_missing_bins(spark):
    rows = [(u, b, float((ord(u) + 1) * b % 5)) for u in ("x", "y", "z") for b in range(12) if not (u == "z" and b % 3 == 0)]
    units, m, n = en.correlation_matrix(spark.createDataFrame(rows, "unit string, bin int, z double"))
    at = {(u, b): v for u, b, v in rows}
    assert units == ["x", "y", "z"] and n == 12
    for i, a in enumerate(units):
        for j, c in enumerate(units):
            both = [at[a, b] * at[c, b] for b in range(12) if (a, b) in at and (c, b) in at]
            assert abs(m[i, j] - np.mean(both)) < 1e-12


def test_tapers_of_any_length_and_dips_of_all_values():
    dense, stepped = dsp.dpss(900, 2.5, 4)[0].T, dsp.slepian(900, 2.5, 4, dense=256)
    assert np.abs(np.abs(dense) - np.abs(stepped)).max() < 1e-9
    rng = np.random.default_rng(1)
    two = np.r_[rng.standard_normal(2500) - 3, rng.standard_normal(2500) + 3]
    assert sg.dip(two, 20)[1] < 0.06 < sg.dip(rng.standard_normal(5000), 20)[1]
