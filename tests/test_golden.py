"""Small exact cases: interval membership, peri-event counts, runs, sequences."""

import math

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import correlate as co, decode as de, ensemble as en, grid, intervals as iv, joins, perievent as pe, sequences as sq, stats as st, tuning as tu


def pts(spark, ts, unit=0):
    return spark.createDataFrame([(unit, float(t)) for t in ts], "unit int, t double")


def eps(spark, pairs):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pairs)], "epoch_id int, start double, stop double")


def refs(spark, rs):
    return spark.createDataFrame([(i, float(r)) for i, r in enumerate(rs)], "ref_id int, r double")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_membership_is_closed(spark):
    got = iv.membership(pts(spark, range(1, 11)).select("t"), eps(spark, [(2, 4), (5, 7), (8, 9)]), "t", 3.0)
    assert [r.interval is not None for r in got.orderBy("t").collect()] == [False] + [True] * 8 + [False]


def test_membership_takes_the_last_of_overlapping_epochs(spark):
    got = iv.membership(pts(spark, [1, 3, 9]).select("t"), eps(spark, [(0, 10), (2, 4)]), "t", 3.0)
    assert rows(got, "t", "interval") == [(1.0, 0), (3.0, 1), (9.0, 0)]


def test_count_events_is_open(spark):
    got = pe.count_events(pts(spark, [1, 2, 3, 4, 5]).select("t"), refs(spark, [0, 1, 2, 3]), 1.0, 3.0)
    assert rows(got, "ref_id", "n") == [(0, 1), (1, 1), (2, 1), (3, 1)]


def test_relative_times(spark):
    got = iv.relative_times(pts(spark, range(10)).select("t"), eps(spark, [(1, 3), (4, 6), (7, 9)]), "t", 3.0).orderBy("t").collect()
    assert [r.rel for r in got] == [None, 0, 0.5, 1, 0, 0.5, 1, 0, 0.5, 1]
    assert [r.interval for r in got] == [None, 0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_relative_times_at_a_shared_border_belong_to_the_earlier(spark):
    got = iv.relative_times(pts(spark, [3]).select("t"), eps(spark, [(1, 3), (3, 5)]), "t", 3.0).collect()
    assert (got[0].interval, got[0].rel) == (0, 1.0)


def test_nearest_takes_the_later_of_a_tie(spark):
    got = pe.nearest_delay(pts(spark, [0, 4, 15, 20]).select("t"), pts(spark, [1, 5, 8, 10, 21, 40, 90]).select("t"), width=7.0)
    assert rows(got, "t", "nearest", "delay") == [(0, 1, -1), (4, 5, -1), (15, 10, 5), (20, 21, -1)]
    tie = pe.nearest_delay(pts(spark, [5]).select("t"), pts(spark, [4, 6]).select("t"), width=1.0)
    assert rows(tie, "nearest") == [(6,)]


def test_runs(spark):
    m = spark.createDataFrame(list(enumerate([0, 0, 1, 1, 1, 0, 1, 1, 0, 0, 1, 1])), "i int, v int")
    assert rows(iv.runs(m, F.col("v") == 1, "i"), "first", "last") == [(2, 4), (6, 7), (10, 11)]


@pytest.mark.parametrize("time,total", [(8, 8), (10, 10), (30, 15)])
def test_truncate(spark, time, total):
    e = eps(spark, [(0, 2), (5, 7), (10, 13), (15, 18), (20, 25)])
    got = iv.truncate(e, float(time)).agg(F.sum(F.col("stop") - F.col("start"))).first()[0]
    assert got == total


def test_shift(spark):
    got = iv.shift_epochs(eps(spark, [(1, 3), (5, 8), (10, 12)]), eps(spark, [(2, 4), (7, 9)]), 4.0)
    assert rows(got, "start", "stop") == [(0, 1), (2, 3)]


def test_sync_keeps_ordinals(spark):
    s = spark.createDataFrame([(0, 2.1), (1, 1.0), (2, 1.1), (3, 5.0), (4, 1.9)], "idx int, t double")
    got = pe.sync(s, refs(spark, [2.0, 1.0]), -0.15, 0.15)
    assert rows(got, "ref_id", "idx") == [(0, 0), (0, 4), (1, 1), (1, 2)]


def test_cross_correlogram(spark):
    got = pe.psth(pts(spark, [1.11, 1.31, 2.11, 2.31]), refs(spark, [1, 2]), 0.2, 4).orderBy("bin").collect()
    assert [round(r.rate, 9) for r in got] == [0, 0, 0, 5, 5]


def test_count_in_intervals(spark):
    p = pts(spark, [0.1, 0.3, 0.5, 1.2, 1.8], 0).unionByName(pts(spark, [0.2, 0.8, 1.5], 1))
    got = pe.count_in_intervals(p, eps(spark, [(0, 0.7), (1, 2)]), 1.0)
    assert rows(got, "unit", "epoch_id", "n", "active") == [(0, 0, 3, 1), (0, 1, 2, 1), (1, 0, 1, 1), (1, 1, 1, 1)]


def test_rank_order(spark):
    p = spark.createDataFrame([(u, 0.1 * (u + 1)) for u in range(5)], "unit int, t double")
    got = pe.rank_order(p, eps(spark, [(0, 1)]), 1.0)
    assert [round(v, 6) for _, v in rows(got, "unit", "order")] == [0, 0.2, 0.4, 0.6, 0.8]
    got = pe.rank_order(p, eps(spark, [(0, 1)]), 1.0, ref="epoch")
    assert [round(v, 6) for _, v in rows(got, "unit", "order")] == [0.1, 0.2, 0.3, 0.4, 0.5]


def test_multitask(spark):
    env = ["sleep", "linear", "linear", "sleep", "wheel", "sleep"]
    e = spark.createDataFrame([(0, i, x) for i, x in enumerate(env)], "session int, epoch_id int, env string")
    got = sq.multitask_pre_post(e, F.col("env") == "sleep", F.col("env") != "sleep")
    assert rows(got, "pre", "task", "post") == [(0, 1, 3), (0, 2, 3), (3, 4, 5)]


def test_pre_task_post(spark):
    e = spark.createDataFrame([(0, i, x) for i, x in enumerate(["a", "sleep", "maze", "sleep", "maze", "sleep"])], "session int, epoch_id int, env string")
    assert rows(sq.pre_task_post(e, F.col("env") == "sleep"), "pre", "task", "post") == [(1, 2, 3)]


def test_tracker_jumps_null_the_first_fast_sample(spark):
    p = spark.createDataFrame([(0, float(i), 100.0 if i == 3 else float(i), 0.0) for i in range(6)], "session int, t double, x double, y double")
    got = sq.drop_jumps(p, 50.0).orderBy("t").collect()
    assert [r.x is None for r in got] == [False, False, False, True, False, False]


def test_merge_complement_and_intersection(spark):
    e = eps(spark, [(0, 2), (1, 3), (3.5, 4), (8, 9)])
    assert rows(iv.merge(e), "start", "stop") == [(0, 3), (3.5, 4), (8, 9)]
    assert rows(iv.merge(e, gap=0.5), "start", "stop") == [(0, 4), (8, 9)]
    domain = spark.createDataFrame([(-1.0, 10.0)], "start double, stop double")
    assert rows(iv.complement(e, domain), "start", "stop") == [(-1, 0), (3, 3.5), (4, 8), (9, 10)]
    assert rows(iv.intersect(e, eps(spark, [(1.5, 8.5)]), 2.0), "start", "stop") == [(1.5, 2), (1.5, 3), (3.5, 4), (8, 8.5)]


def test_the_first_touching_partner_counts(spark):
    other = spark.createDataFrame([(0, 5.0, 6.0), (1, 4.0, 5.0)], "other_id int, start double, stop double")
    got = iv.overlap_length(eps(spark, [(0, 5)]), other.where("other_id = 0"), 3.0)
    assert rows(got, "overlap") == [(0.0,)]


def test_sliding_windows_leave_out_one_that_ends_at_the_stop(spark):
    got = iv.sliding_windows(eps(spark, [(0, 10)]), 2.0, 2.0)
    assert rows(got, "start") == [(0,), (2,), (4,), (6,)]


def test_range_join_equals_a_plain_join_over_bucket_borders(spark):
    import random

    rnd = random.Random(5)
    p = pts(spark, [rnd.uniform(-50, 50) for _ in range(300)] + [0.0, 7.0, -7.0]).select("t")
    w = spark.createDataFrame([(i, a := rnd.uniform(-50, 50), a + rnd.choice([0.0, 1.0, 25.0])) for i in range(80)] + [(99, -7.0, 7.0)], "w int, lo double, hi double")
    for ends in joins.ENDS:
        fast = joins.range_join(p, w, "t", "lo", "hi", 7.0, ends=ends).select("t", "w")
        slow = p.join(w, joins.within(F.col("t"), F.col("lo"), F.col("hi"), ends)).select("t", "w")
        assert rows(fast, "t", "w") == rows(slow, "t", "w")


def test_asof_carries_over_empty_buckets(spark):
    left = spark.createDataFrame([(0, 5.0), (0, 1000.0), (1, 3.0), (0, 0.5)], "k int, t double")
    right = spark.createDataFrame([(0, 1.0, 10.0), (0, 5.0, 50.0), (1, 4.0, 40.0)], "k int, t double, v double")
    back = joins.asof_join(left, right, "t", ["v"], ["k"], width=10.0)
    assert {(r.k, r.t): r.v for r in back.collect()} == {(0, 5.0): 50.0, (0, 1000.0): 50.0, (1, 3.0): None, (0, 0.5): None}
    ahead = joins.asof_join(left, right, "t", ["v"], ["k"], width=10.0, direction="forward")
    assert {(r.k, r.t): r.v for r in ahead.collect()} == {(0, 5.0): 50.0, (0, 1000.0): None, (1, 3.0): 40.0, (0, 0.5): 10.0}
    strict = joins.asof_join(left, right, "t", ["v"], ["k"], width=10.0, strict=True)
    assert {(r.k, r.t): r.v for r in strict.collect()}[(0, 5.0)] == 10.0


def test_statistics(spark):
    w = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, 0)], "a int, w int")
    assert st.repeat_rows(w, "w").count() == 6
    p = spark.createDataFrame([(float(i), 2.0 * i) for i in range(1, 6)], "a double, b double")
    assert {round(r.residual, 9) for r in st.regress_out(p, "a", "b").collect()} == {3.0}
    x = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    ci = st.confidence_interval(x, "v").first()
    half = 2.2621571628 * math.sqrt(sum((i - 4.5) ** 2 for i in range(10)) / 9) / math.sqrt(10)
    assert abs(ci.upper - 4.5 - half) < 1e-6 and abs(ci.lower - 4.5 + half) < 1e-6
    boot = st.bootstrap(x.withColumn("k", F.lit(0)), "v", ["k"], F.avg("_v"), 200).first()
    assert 2 < boot.lower < 4.5 < boot.upper < 7


def test_decoder_sums_to_one_and_falls_back(spark):
    c = spark.createDataFrame([(0, 0, 2), (0, 1, 0), (1, 0, 0), (1, 1, 0)], "tbin int, unit int, n int")
    t = spark.createDataFrame([(u, b, float(u + b + 1)) for u in range(2) for b in range(3)], "unit int, bx int, rate double")
    o = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 0.0)], "bx int, occ double")
    got = de.bayes(c, t, o, 0.1).groupBy("tbin").agg(F.sum("p").alias("s"), F.count("p").alias("n")).collect()
    assert all(abs(r.s - 1) < 1e-9 and r.n == 2 for r in got)
    back = de.bayes(c, t, o, 0.1, fallback=True).where("tbin = 1").orderBy("bx").collect()
    assert [round(r.p, 9) for r in back] == [0.25, 0.75]


def test_weighted_correlation_of_a_diagonal(spark):
    p = spark.createDataFrame([(0, k, k, 1.0) for k in range(5)] + [(1, k, 4 - k, 1.0) for k in range(5)], "event int, tbin int, bx int, p double")
    assert [round(r.corr_bx, 9) for r in de.weighted_correlation(p).orderBy("event").collect()] == [1.0, -1.0]
    jumps = de.jump_distance(de.estimate(p, ["event", "tbin"]))
    assert rows(jumps, "event", "max_jump", "mean_jump") == [(0, 1.0, 1.0), (1, 1.0, 1.0)]


def test_skew_bias_is_antisymmetric_without_ties(spark):
    s = spark.createDataFrame([(0, u, t) for u, t in [(0, 1.0), (0, 2.0), (1, 1.5), (1, 3.0), (2, 0.5)]], "epoch int, unit int, t double")
    b = {(r.unit, r.unit2): r.bias for r in de.skew_bias(s).collect()}
    assert b[(0, 1)] == 0.5 and all(abs(b[(i, j)] + b[(j, i)]) < 1e-12 for i, j in b)
    assert b[(2, 0)] == 1.0


def test_assemblies_find_a_planted_group(spark):
    import random

    rnd = random.Random(1)
    data = []
    for b in range(400):
        on = rnd.random() < 0.1
        data += [(u, b, rnd.gauss(0, 1) + (4 if on and u < 4 else 0)) for u in range(10)]
    z = grid.zscore(spark.createDataFrame(data, "unit int, bin int, n double"), "n", ["unit"])
    for method in ("pca", "ica"):
        m = en.members(en.assemblies(z, method=method)).collect()
        first = {r.unit for r in m if r.member and r.assembly == 0}
        assert first == {0, 1, 2, 3}
    assert min(en.null_eigenvalues(z, 2, 400)) < 2


def test_maps(spark):
    cells = spark.createDataFrame([(0, x, y, float(r)) for x, y, r in [(0, 0, 5), (0, 1, 4), (3, 3, 9), (3, 4, 8), (2, 0, 0), (4, 4, 1)]], "unit int, bx int, by int, rate double")
    f = tu.sort_by_rate(tu.remove_by_area(tu.label_fields(cells, 2.0), 2))
    got = {(r.bx, r.by): r.field for r in f.collect()}
    assert got[(3, 3)] == got[(3, 4)] == 1 and got[(0, 0)] == got[(0, 1)] == 2 and got[(4, 4)] == 0
    assert rows(tu.field_centres(f), "field", "x", "y") == [(1, 3, 3), (2, 0, 0)]


def test_reference_epochs_and_spectra_of_pairs(spark):
    s = spark.createDataFrame([(u, b, float((b * (u + 1)) % 5)) for u in range(3) for b in range(20)], "unit int, bin int, n double")
    r = {(x.unit, x.unit2): x.r for x in co.pairwise(s, "bin", "n").collect()}
    assert len(r) == 3 and all(v is None or -1 <= v <= 1 for v in r.values())
    constant = spark.createDataFrame([(0, b, 1.0) for b in range(5)] + [(1, b, float(b)) for b in range(5)], "unit int, bin int, n double")
    assert co.pairwise(constant, "bin", "n").first().r is None
