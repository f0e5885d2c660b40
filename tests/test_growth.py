"""Steps whose cost must not grow faster than their input, and what they must still give."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from pulsegrid import catalog
from pulsegrid.functions import dsp
from pulsegrid.operators import correlate as co, decode as de, ensemble as en, grid, joins, perievent as pe, sequences as sq, signals as sg, trials as tr
from pulsegrid.plans import extra_queries as xq, signals
from pulsegrid.sources import session_metadata as md
from pulsegrid.streaming import windows as stream

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString().lower().replace(" ", "")


def test_no_frame_is_read_anew_for_every_row(spark):
    x = spark.createDataFrame([(1, float(i), None if i % 3 else float(i), 0.0) for i in range(12)], "session int, t double, x double, y double")
    filled = grid.interpolate_nulls(x, "x", "t", ["session"])
    assert [r.x for r in filled.orderBy("t").collect()] == [float(min(i, 9)) for i in range(12)]
    path = sq.segment_path(x.withColumn("x", F.col("t")), [(7, 0.0, 0.0), (8, 11.0, 0.0)], 1.5)
    assert [(r.start, r.stop, r.from_well, r.to_well) for r in path.collect()] == [(2.0, 9.0, 7, 8)]
    zeros = grid.border_zeros_to_null(x.withColumn("v", F.col("t").between(3, 5).cast("int")), "v", "t", ["session"])
    assert [r.v for r in zeros.orderBy("t").collect()] == [None] * 3 + [1] * 3 + [None] * 6
    near = joins.neighbours(x.select("session", "t"), x.where("x is not null").select("session", "t", "x"), "t", ["x"], ["session"], 2.0)
    for got in (filled, path, zeros, near):
        assert "unboundedfollowing" not in plan(got)


def test_made_samples_are_planned_by_their_own_size(spark):
    x = signals.samples(spark, SF, fs=100.0, channels=2)
    assert x.inputFiles() and all("samples-" in f for f in x.inputFiles())
    of = x.groupBy("session", "channel").agg(F.count(F.lit(1)).alias("n"), F.max("sample_idx").alias("m"), F.countDistinct("sample_idx").alias("k")).collect()
    assert all(r.n == r.k == r.m + 1 for r in of) and len({r.session for r in of}) * 2 == len(of)


def test_transforms_of_points_by_pieces_of_frequencies(monkeypatch):
    rng = np.random.default_rng(3)
    times = np.sort(rng.uniform(0, 40, 1500))
    whole = dsp.spectrum_points(times, 200.0, (5.0, 90.0))
    monkeypatch.setattr(dsp, "_PHASES", 1 << 14)
    tracemalloc.start()
    parts = dsp.spectrum_points(times, 200.0, (5.0, 90.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(whole[2], parts[2], atol=1e-9) and len(whole[0]) * len(times) * 16 > 60e6 > 2 * peak


def test_streams_leave_their_rows_in_files(spark):
    twice = lambda e: stream.drop_repeats(e.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))), "event_id", "40 days")
    got = xq._streamed(spark, SF, twice)
    assert got.inputFiles() and got.count() == spark.read.parquet(f"{SF}/events.parquet").select("event_id").distinct().count()
    counts = xq._streamed(spark, SF, lambda e: stream.binned_counts(e, "1 day", "1 hour"), None)
    assert counts.inputFiles() and counts.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()


def pairs_by_rows(rows, lag=0):
    return {(u, v): [(x, y) for (a, i), x in rows.items() for (b, j), y in rows.items() if a == u and b == v and j == i + lag] for u in {k[0] for k in rows} for v in {k[0] for k in rows} if u < v}


def sparse(seed):
    rng = np.random.default_rng(seed)
    return {(u, i): (None if rng.random() < 0.1 else float(rng.integers(-3, 4))) for u in range(9) for i in range(-3, 8) if rng.random() < 0.6} | {(9, 50): 1.0}


def test_lagged_correlations_by_blocks(spark):
    rows = sparse(2)
    z = spark.createDataFrame([(u, i, v) for (u, i), v in rows.items()], "unit int, bin int, z double")
    got_df = co.cross_correlation(z, "bin", "z", 3, blocks=3)
    got = {(r.unit, r.unit2, r.lag): r.r for r in got_df.collect()}
    power = {u: sum(v * v for (a, _), v in rows.items() if a == u and v is not None) for u in range(10)}
    want = {}
    for lag in range(-3, 4):
        for (u, v), met in pairs_by_rows(rows, lag).items():
            p = [x * y for x, y in met if x is not None and y is not None]
            if met:
                want[u, v, lag] = sum(p) / (power[u] * power[v]) ** 0.5 if p and power[u] * power[v] else None
    assert got.keys() == want.keys() and all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-12 for k in want)
    assert "flatmapcogroups" in plan(got_df)


def test_proximity_by_blocks(spark):
    rng = np.random.default_rng(4)
    a, b = ({k: rng.standard_normal(5).tolist() for k in ks} for ks in (range(0, 30), range(10, 45)))
    rows = lambda d: spark.createDataFrame(list(d.items()), "k long, v array<double>")
    got_df = en.proximity(rows(a), rows(b), "v", "k", block=7)
    got = {r.k: r.proximity for r in got_df.collect()}
    d = lambda x, y: float(np.linalg.norm(np.subtract(x, y)))
    want = {k: 1 - d(v, b[k]) / np.mean([d(v, w) for w in b.values()]) if k in b else None for k, v in a.items()}
    assert got.keys() == want.keys() and all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-9 for k in want)
    assert "cartesianproduct" not in plan(got_df) and "nestedloop" not in plan(got_df)


def test_covariance_of_groups_by_blocks(spark):
    rows = sparse(1)
    z = spark.createDataFrame([(u, i, v) for (u, i), v in rows.items()], "unit int, bin int, z double")
    g = spark.createDataFrame([(u, "abc"[u % 3]) for u in range(10)], "unit int, grp string")
    got_df = en.cross_structural_covariance(z, g, blocks=4)
    got = {(r.unit, r.unit2): r.cov for r in got_df.collect()}
    want = {}
    for (u, v), met in pairs_by_rows(rows).items():
        if met and u % 3 != v % 3:
            p = [x * y for x, y in met if x is not None and y is not None]
            want[u, v] = sum(p) / len(p) if p else None
    assert got.keys() == want.keys() and all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-12 for k in want)
    assert "sortmergejoin" not in plan(got_df) and "flatmapcogroups" in plan(got_df)


def test_assemblies_from_fewer_bins_than_units(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((40, 12)) + 3 * np.outer(np.arange(40) % 4 == 0, np.arange(12) % 3 == 0)
    x = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, keepdims=True)
    z = spark.createDataFrame([(u, b, float(x[u, b])) for u in range(40) for b in range(12)], "unit int, bin int, z double")
    get = lambda **k: {(r.assembly, r.unit): r.weight for r in en.assemblies(z, bound=4.0, **k).collect()}
    ica = get(method="ica")
    for v in (np.array([[ica[k, u] for u in range(40)] for k in range(len(ica) // 40)]),):
        assert np.allclose(np.linalg.norm(v, axis=1), 1) and all(r[np.abs(r).argmax()] > 0 for r in v)
    with monkeypatch.context() as m:
        m.setattr(en, "correlation_matrix", None)  # no matrix of units x units is made
        few = get()
    monkeypatch.setattr(en, "_assemblies_of_bins", lambda *a: None)
    many = get()
    assert few.keys() == many.keys() and len(few) >= 40 and all(abs(few[k] - many[k]) < 1e-9 for k in few)
    span = lambda w: np.linalg.qr(np.array([[w[k, u] for u in range(40)] for k in range(len(w) // 40)]).T)[0]
    a, b = span(ica), span(many)
    assert np.allclose(a @ a.T, b @ b.T, atol=1e-9)


def test_explained_variance_of_windows_leaves_sums(spark):
    rng = np.random.default_rng(7)
    rows = [(w, u, b, float(rng.integers(0, 4) if u else 2)) for w in (-1, 0, 1, 4, 5) for u in range(14) for b in range(6)]
    s = spark.createDataFrame(rows, "window long, unit int, bin int, n double")
    by = co.pairwise_dense(s.where("window >= 0"), "bin", "n", keys=["window"])
    want = en.explained_variance_windows(co.pairwise_dense(s.where("window < 0").drop("window"), "bin", "n"), by.where("window < 2"), by.where("window >= 4"))
    got = en.explained_variance_windows_of(s, "bin", "n", "window", -1, [0, 1], [4, 5], blocks=3)
    a, b = ({r.window: tuple(r)[1:] for r in d.collect()} for d in (want, got))
    assert a.keys() == b.keys() == {4, 5} and all(np.allclose(a[k], b[k], atol=1e-10) for k in a)


def test_order_bias_of_shuffles_leaves_sums(spark):
    rng = np.random.default_rng(8)
    rows = [(e, int(rng.integers(0, 13)), float(rng.integers(0, 40))) for e in range(3) for _ in range(70)] + [(3, 5, 1.0)]
    p = spark.createDataFrame(rows, "epoch int, unit int, t double")
    task, post = p.where("epoch = 0").drop("epoch"), p.where("epoch > 0")
    ref = de.skew_bias(task.withColumn("_one", F.lit(0)), ["_one"]).drop("_one")
    want = {r.epoch: r.cosine for r in de.bias_similarity(ref, de.skew_bias(post)).collect()}
    got_df = de.bias_significance(task, post, 5)
    got = {r.epoch: r for r in got_df.collect()}
    assert got.keys() == want.keys() == {1, 2} and all(abs(got[e].cosine - want[e]) < 1e-12 and 1 / 6 <= got[e].p <= 1 for e in want)
    sums = de._bias_sums(task, post.withColumn("shuffle", F.lit(0)), ["epoch"], "shuffle", "unit")
    assert "unit2" not in plan(got_df) and sums.where("_d is null").count() == 0


def test_cross_correlograms_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(f"u{int(rng.integers(0, 60))}", float(rng.integers(0, 400)) / 4) for _ in range(900)] + [("none", None)]
    p = spark.createDataFrame(rows, "unit string, t double")
    monkeypatch.setattr(co, "_MET", 1 << 8)
    for same in (False, True):
        got_df = co.correlogram(p, 0.5, 6, same=same, pairs=True)
        got = {(r.unit, r.unit2, r.bin): r.n for r in got_df.collect()}
        units = sorted({u for u, _ in rows})
        want = {(u, v, k): 0 for u in units for v in units if (u <= v if same else u < v) for k in range(7)}
        for u, r in rows:
            for v, t in rows:
                if None not in (r, t) and r - 1.75 <= t <= r + 1.75 and (k := int((t - (r - 1.75)) // 0.5)) < 7 and (u, v, k) in want and not (u == v and k == 3):
                    want[u, v, k] += 1
        assert got == want and "range" not in plan(got_df) and "flatmapcogroups" in plan(got_df)
        some = co.correlogram(p, 0.5, 6, same=same, pairs=True, empty=False)
        assert some.where("n = 0 and bin <> 3").count() == 0 and some.agg(F.sum("n")).first()[0] == sum(want.values())


def test_lists_of_sessions_are_parsed_once_a_file(spark):
    import json

    n = 300
    one = list(range(1, n + 1))
    cells = {"UID": one, "rate": [u / 2 for u in one], "short": [1, 2], "tags": {"Bad": [2, 2, 5], "Good": one}, "general": {"basename": "s"}}
    phases = {f"PhaseLockingData_{s}": {"phasedistros": [one, [-u for u in one]]} for s in ("rem", "wake")}
    table = lambda d: spark.createDataFrame([("s", "b", json.dumps(d))], "session string, basepath string, data string")
    u = {r.nth: r for r in md.units(table(cells)).collect()}
    assert len(u) == n and all(u[i].uid == i + 1 and u[i].fields == {"UID": str(i + 1), "rate": str((i + 1) / 2)} and u[i].general["basename"] == "s" for i in u)
    assert {i for i in u if u[i].bad} == {1, 4} and u[1].tags == ["Bad", "Good"] and u[2].tags == ["Good"]
    m = {(r.epoch, r.nth): r.fields for r in md.metrics_by_epoch(table({"pre": {"particip": one, "gain": one, "two": [1, 2]}, "post": []})).collect()}
    assert m == {("pre", i): {"particip": str(i + 1), "gain": str(i + 1)} for i in range(n)}
    d = {(r.state, r.nth): r.distribution for r in md.phase_distributions(table(phases)).collect()}
    assert d == {(s, i): [i + 1.0, -i - 1.0] for s in ("rem", "wake") for i in range(n)}
    b = {r.i: r for r in md.behaviour(table({"timestamps": one, "position": {"x": one, "y": one}, "more": one})).collect()}
    assert len(b) == n and all(b[i].x == i + 1.0 and b[i].fields == {"more": i + 1.0} for i in b)
    for df in (md.units(table(cells)), md.metrics_by_epoch(table(cells)), md.phase_distributions(table(phases)), md.behaviour(table(cells))):
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        upper = lines[: next(i for i, x in enumerate(lines) if "Generate" in x) + 1]
        assert not any("from_json" in x for x in upper)  # nothing is parsed where there is a row for each value already


def test_lags_are_counted_without_pairs(spark, monkeypatch):
    rng = np.random.default_rng(10)
    monkeypatch.setattr(pe, "_AT_ONCE", 64)
    width, half = 0.1, 7 / 2 * 0.1
    rows = [(int(rng.integers(0, 3)), f"u{i % 5}", float(rng.integers(-300, 300)) / 20 + (1e6 if i % 7 == 0 else 0)) for i in range(600)] + [(0, "u0", None), (None, "u1", 0.0)]
    marks = [(int(rng.integers(0, 3)), i, float(rng.integers(-300, 300)) / 20 + (1e6 if i % 5 == 0 else 0)) for i in range(150)] + [(1, 500, None), (None, 501, 0.0)]
    p, r = spark.createDataFrame(rows, "session int, unit string, t double"), spark.createDataFrame(marks, "session int, ref_id int, r double")
    hits = [(s, u, i, k) for s, u, t in rows for q, i, m in marks if None not in (s, t, m) and s == q and m - half <= t <= m + half and 0 <= (k := int(np.floor((t - (m - half)) / width))) < 7]
    for by, pick in (((), lambda h: ()), (("unit",), lambda h: (h[1],)), (("ref_id",), lambda h: (h[2],)), (("session", "unit"), lambda h: (h[0], h[1])), (("unit", "ref_id"), lambda h: (h[1], h[2]))):
        got_df = pe.lag_counts(p, r, width, 6, ["session"], by)
        got = {tuple(x[c] for c in (*by, "bin")): x.n for x in got_df.collect()}
        want = {}
        for h in hits:
            want[(*pick(h), h[3])] = want.get((*pick(h), h[3]), 0) + 1
        assert got == want
        assert ("flatmapcogroups" in plan(got_df)) == (len(by) < 2 or "ref_id" not in by)


def test_theta_cycles_by_blocks_of_time(spark):
    rng = np.random.default_rng(11)
    t = np.arange(0, 60, 0.004)
    v = np.sin(2 * np.pi * 8 * t) + 0.05 * rng.standard_normal(len(t))
    x = spark.createDataFrame([(s, 0, i, float(a), float(b)) for s in (1, 2) for i, (a, b) in enumerate(zip(t, v))], "session int, channel int, sample_idx long, t double, value double")
    rows = lambda **k: {(r.session, r.start): (r.peak, r.stop, r.amplitude, r.is_burst) for r in tr.theta_cycles(x, 250.0, **k).collect()}
    whole, parts = rows(), rows(block=7.0)
    assert len(whole) > 900 and whole.keys() == parts.keys()
    assert all(a[:2] == b[:2] and a[3] == b[3] and abs(a[2] - b[2]) < 1e-6 for a, b in ((whole[k], parts[k]) for k in whole))


def test_queries_on_signals_take_blocks_of_time(spark):
    for name in ("band_pass", "filter_fir", "theta_cycles"):
        assert "_block" in plan(catalog.queries()[name](spark, SF))


def test_structures_leave_a_task_in_small_batches(spark, monkeypatch):
    import json

    from pulsegrid.sources.session_files import build_mat

    monkeypatch.setattr(md, "_TEXT", 100)  # a batch for every few files
    made = [(f"a/s{i}/s{i}.mat", bytearray(build_mat({"one" if i % 3 else "two": {"x": np.arange(i + 2.0)[None]}}))) for i in range(40)]
    got_df = md.structs(spark.createDataFrame(made, "path string, content binary").coalesce(1), "one")
    got = {r.session: (r.basepath, json.loads(r.data)) for r in got_df.collect()}
    assert got == {f"s{i}": (f"a/s{i}", {"x": [float(k) for k in range(i + 2)]}) for i in range(40) if i % 3}
    assert "mapinarrow" in plan(got_df)


def test_explained_variance_holds_few_correlations(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(u, p, b, float(rng.integers(0, 5) if u else 1)) for u in range(40) for p in range(3) for b in range(8)]
    s = spark.createDataFrame(rows, "unit int, period int, bin int, n double")
    pairs = [co.pairwise_dense(s.where(f"period = {p}"), "bin", "n").select("unit", "unit2", F.col("r").alias(c)) for p, c in enumerate(("pre", "task", "post"))]
    want = en.explained_variance(pairs[0].join(pairs[1], ["unit", "unit2"]).join(pairs[2], ["unit", "unit2"])).first()
    monkeypatch.setattr(en, "_SLICE", 7)
    got = en.explained_variance_of(s, "bin", "n", "period", 0, 1, 2, blocks=2).first()
    assert np.allclose(tuple(got), tuple(want), atol=1e-10)


def test_the_dip_takes_one_pass_for_all_modes(monkeypatch):
    def corners(x, y, sign):
        keep = []
        for i in range(len(x)):
            while len(keep) > 1 and sign * ((x[keep[-1]] - x[keep[-2]]) * (y[i] - y[keep[-2]]) - (y[keep[-1]] - y[keep[-2]]) * (x[i] - x[keep[-2]])) <= 0:
                keep.pop()
            keep.append(i)
        return np.abs(np.interp(x, x[keep], y[keep]) - y).max()

    passes, one = [], sg._minorants
    monkeypatch.setattr(sg, "_minorants", lambda x, y, ends: passes.append(len(ends)) or one(x, y, ends))
    rng = np.random.default_rng(13)
    for x in (rng.standard_normal(300), np.r_[rng.standard_normal(150), rng.standard_normal(150) + 8], rng.integers(0, 9, 300)):
        v, f = np.sort(x.astype(float)), np.arange(1, 301) / 300
        want = min(max(corners(v[: m + 1], f[: m + 1], 1), corners(v[m:], f[m:], -1)) for m in np.unique(np.linspace(1, 298, 50).astype(int)))
        assert abs(sg.dip(x, 0)[0] - want / 2) < 1e-12
    assert passes == [50] * 6


def test_matches_come_out_in_order_of_time(spark):
    rng = np.random.default_rng(14)
    times, marks = rng.integers(0, 60, 500) / 2.0, rng.integers(0, 60, 200) / 2.0
    p = spark.createDataFrame([(i, float(t)) for i, t in enumerate(times)], "event_id int, t double").repartition(5)
    r = spark.createDataFrame([(i, float(m)) for i, m in enumerate(marks)], "ref_id int, r double").repartition(5)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in ("-1", kept):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            for got_df, inside in ((pe.sync(p, r, -1.0, 4.0), lambda x: -1 <= x <= 4), (pe.raster(p, r, -1.0, 4.0), lambda x: -1 < x < 4)):
                got = [(x.event_id, x.ref_id, x.t, x.r, x.lag) for x in got_df.collect()]
                assert sorted(got) == sorted((i, j, t, m, t - m) for i, t in enumerate(times) for j, m in enumerate(marks) if inside(t - m))
                if limit == "-1":  # points of a bucket by time, each with its references by time
                    by, of = {}, {}
                    for x in got:
                        by.setdefault(x[2] // 5, []).append(x[2])
                        of.setdefault((x[0], x[2] // 5), []).append(x[3])
                    assert all(v == sorted(v) for v in (*by.values(), *of.values()))
                    assert sum(a[0] != b[0] for a, b in zip(got, got[1:])) + 1 == len({x[0] for x in got})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_many_small_files_take_few_tasks(spark, tmp_path):
    from pulsegrid.sources import mat_sink, session_files as sf, stores

    rows = [(f"s{i}", float(k), k + 0.5, k + 0.25, float(i)) for i in range(200) for k in range(1 + i % 3)]
    mat_sink.save_ripples(spark.createDataFrame(rows, "session string, start double, stop double, peak double, amplitude double"), str(tmp_path))
    (tmp_path / "_writing").mkdir()
    (tmp_path / "_writing" / "s.ripples.events.mat").write_bytes(b"")
    found = mat_sink.session_files(spark, str(tmp_path), "ripples.events.mat")
    assert found.rdd.getNumPartitions() == 4  # as many as cores, not one for 32 files
    assert {(r.session, r.path) for r in found.collect()} == {(f"s{i}", f"s{i}/s{i}.ripples.events.mat") for i in range(200)}
    got = sf.mat_events(stores.read_files(spark, str(tmp_path), ".ripples.events.mat"), "ripples").collect()
    assert sorted((r.session, r.start, r.stop, r.peak, r.amplitude) for r in got) == sorted(rows)
    assert stores.read_files(spark, str(tmp_path), ".nothing").count() == 0


def shuffled(spark, job) -> int:
    """Bytes that the stages of a job write for others to read."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}

    before = written()
    job()
    return sum(n for k, n in written().items() if k not in before)


def test_vectors_meet_without_copies(spark):
    rng = np.random.default_rng(8)
    x, group = rng.standard_normal((300, 24)).astype("float32"), rng.integers(0, 3, 300)
    x[7] = 0
    v = spark.createDataFrame([(i * 3, [float(e) for e in x[i]], int(group[i])) for i in range(300)], "vec_id long, embedding array<float>, label int")
    y = x.astype(float)
    with np.errstate(invalid="ignore"):
        y = y / np.linalg.norm(y, axis=1, keepdims=True)
    want = {(i * 3, j * 3): None if 7 in (i, j) else y[i] @ y[j] for i in range(300) for j in range(i + 1, 300) if group[i] != group[j]}
    cost = []
    for blocks in (1, 3, 24):
        got = {}
        cost.append(shuffled(spark, lambda: got.update({(r.vec_id, r.key2): r.cosine for r in en.similarity_pairs(v, "embedding", "vec_id", "label", blocks).collect()})))
        assert got.keys() == want.keys() and all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-12 for k in want)
    assert cost[2] < 2 * cost[1]  # however many blocks meet


def test_patterns_meet_without_copies(spark):
    x = np.random.default_rng(9).standard_normal((300, 24))
    v = spark.createDataFrame([(i, [float(e) for e in x[i]]) for i in range(300)], "vec_id long, embedding array<double>")
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    cost, found = [], []
    for blocks in (3, 24):
        got = {}
        cost.append(shuffled(spark, lambda: got.update({(r.vec_id, r.key2): (r.similarity, r.p) for r in en.similarity_index(v, "embedding", "vec_id", 5, blocks=blocks).collect()})))
        assert len(got) == 300 * 299 // 2 and all(abs(s - abs(y[i] @ y[j])) < 1e-12 for (i, j), (s, _) in got.items())
        found.append({k: p for k, (_, p) in got.items()})
    assert found[0] == found[1] and cost[1] < 2 * cost[0]


def test_series_meet_without_copies(spark):
    x = np.random.default_rng(10).standard_normal((300, 20)).round(2)
    x[4] = 1.0
    s = spark.createDataFrame([(u, i, float(x[u, i])) for u in range(300) for i in range(20)], "unit long, bin int, n double")
    for method in ("pearson", "spearman"):
        of = x if method == "pearson" else np.array([(np.searchsorted(np.sort(r), r, "left") + np.searchsorted(np.sort(r), r, "right")) / 2 for r in x])
        with np.errstate(invalid="ignore"):
            want = np.corrcoef(of)
        cost = []
        for blocks in (3, 24):
            got = {}
            cost.append(shuffled(spark, lambda: got.update({(r.unit, r.unit2): r.r for r in co.pairwise_dense(s, "bin", "n", method=method, blocks=blocks).collect()})))
            assert len(got) == 300 * 299 // 2 and all(r is None if 4 in k else abs(r - want[k]) < 1e-12 for k, r in got.items())
        assert cost[1] < 2 * cost[0]
