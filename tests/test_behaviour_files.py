import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import linearize as li
from pulsegrid.sources import behaviour_files as bf, session_files as sf, session_metadata as sm

MAZE = [(0, 0.0, 0.0, 40.0, 0.0), (1, 40.0, 0.0, 80.0, 0.0)]


def written(tmp_path, x, y, sessions=("a", "b")):
    for k, s in enumerate(sessions):
        (tmp_path / s).mkdir()
        b = {"timestamps": np.arange(len(x))[None] / 10, "position": {"x": (x + k)[None], "y": y[None], "units": "cm"}, "notes": "kept"}
        (tmp_path / s / f"{s}.animal.behavior.mat").write_bytes(sf.build_mat({"behavior": b}))
        e = [{"name": str(i), "startTime": 10.0 * i, "stopTime": 10.0 * i + 9.95, "environment": n} for i, n in enumerate(("linear", "sleep"))]
        tags = {"Ripple": {"channels": np.array([[4.0, 9.0]])}, "CA1sp": {"channels": 2.0}, "Bad": {"channels": np.array([[7.0]])}} if k == 0 else {"CA1sp": {"channels": 3.0}}
        (tmp_path / s / f"{s}.session.mat").write_bytes(sf.build_mat({"session": {"epochs": e, "channelTags": tags}}))


def position(tmp_path, s):
    return sf.parse_mat((tmp_path / s / f"{s}.animal.behavior.mat").read_bytes())["behavior"]


def test_jumps_leave_the_files(spark, tmp_path):
    x, y = np.linspace(0, 20, 200), np.zeros(200)
    x[50], x[150] = 500, 500
    written(tmp_path, x, y)
    spans = bf.epochs(spark, str(tmp_path)).where("environment = 'linear'")
    bf.filter_jumps(spark, str(tmp_path), spans=spans)
    for k, s in enumerate("ab"):
        got = position(tmp_path, s)
        gone = np.flatnonzero(np.isnan(got["position"]["x"].ravel()))
        assert gone.tolist() == [50] and np.isnan(got["position"]["y"].ravel()[50])  # the second jump lies in the other epoch
        assert got["position"]["x"].ravel()[150] == 500 + k and got["position"]["units"] == "cm" and got["notes"] == "kept"
    bf.filter_jumps(spark, str(tmp_path), interval=(14.0, 16.0))
    assert np.flatnonzero(np.isnan(position(tmp_path, "a")["position"]["x"].ravel())).tolist() == [50, 150]


def test_tracks_are_written_into_the_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    x, y = np.abs(np.cumsum(rng.normal(0, 2, 200))) % 80, rng.normal(0, 2, 200)
    x[7] = np.nan
    written(tmp_path, x, y)
    bf.linearize_track(spark, str(tmp_path), MAZE, interval=(0.0, 9.95), per_segment=20, spread=4.0, stay=2.0, block=5.0, margin=1.0)
    got = position(tmp_path, "b")
    rows = spark.createDataFrame([("b", i, i / 10, float(a + 1), float(c)) for i, (a, c) in enumerate(zip(x[:100], y[:100]))], "session string, i int, t double, x double, y double")
    want = {r.i: (r.lin, r.segment) for r in li.track_path(rows, MAZE, per_segment=20, spread=4.0, stay=2.0).collect()}
    lin, states = got["position"]["linearized"].ravel(), got["states"].ravel()
    assert [None if np.isnan(v) else v for v in lin[:100]] == [want[i][0] for i in range(100)] and np.isnan(lin[100:]).all()
    assert [None if np.isnan(v) else int(v) for v in states[:100]] == [want[i][1] for i in range(100)]
    assert not np.isnan(got["position"]["projected_x"].ravel()[:7]).any()


def test_circles_are_written_into_the_files(spark, tmp_path):
    a = np.linspace(0, 12 * np.pi, 200)
    written(tmp_path, 50 + 30 * np.cos(a), 20 + 30 * np.sin(a))
    told = {r.session: r for r in bf.linearize_circle(spark, str(tmp_path)).collect()}
    assert told["b"].center_x == pytest.approx(51, abs=0.1) and told["b"].radius == pytest.approx(30, abs=0.1)
    got = position(tmp_path, "b")
    assert got["circle_params"]["center_y"][0, 0] == told["b"].center_y and got["circle_params"]["radius"][0, 0] == told["b"].radius
    assert got["position"]["theta"].ravel() == pytest.approx(np.mod(np.arctan2(got["position"]["y_centered"], got["position"]["x_centered"]).ravel(), 2 * np.pi))
    assert got["position"]["linearized"].ravel() == pytest.approx(got["position"]["theta"].ravel() * told["b"].radius)


def test_roles_of_channels(spark, tmp_path):
    written(tmp_path, np.zeros(3), np.zeros(3), ("a", "b"))
    sessions = sm.structs(bf.mat_sink.session_files(spark, str(tmp_path), "session.mat").select(F.concat(F.lit("/"), "path").alias("path"), "content"), "session")
    roles = bf.channel_roles(sessions)
    assert sorted((r.session, r.ripple, r.sharp_wave, r.noise) for r in roles.collect()) == [("a", 3, None, 6), ("b", 2, None, None)]
    signal = spark.createDataFrame([(s, c, 0.5) for s in "ab" for c in range(8)], "session string, channel int, value double")
    assert sorted((r.session, r.role, r.channel) for r in bf.with_roles(signal, roles).collect()) == [("a", "noise", 6), ("a", "ripple", 3), ("b", "ripple", 2)]


def test_files_are_read_once_a_step(spark, tmp_path, monkeypatch):
    from pulsegrid.sources import stores

    files = [(f"s{k}/s{k}.{bf.NAME}", bytearray(sf.build_mat({"behavior": {"timestamps": np.arange(5.0)[None], "position": {"x": np.array([[0.0, 1, 2, 90, 4]]) + k, "y": np.ones((1, 5))}}}))) for k in range(3)]
    stores.save_files(spark.createDataFrame(files, "path string, content binary"), str(tmp_path))
    kept, one = [], bf.staged
    monkeypatch.setattr(bf, "staged", lambda df, name: kept.append(name) or one(df, name))
    bf.filter_jumps(spark, str(tmp_path), 30.0)
    bf.linearize_circle(spark, str(tmp_path))
    assert kept.count("tracking") == 2  # what a step reads again is not the files
    got = {(r.session, r.i): r.x for r in bf.samples(spark, str(tmp_path)).collect()}
    assert len(got) == 15 and all(got[f"s{k}", 3] is None and got[f"s{k}", 2] == 2 + k for k in range(3))


def test_contents_of_files_stay_off_the_driver(spark):
    from pulsegrid.sources import mat_sink

    files = spark.createDataFrame([("a", "a/a.x", bytearray(sf.build_mat({"behavior": {"v": 1.0}})))], "session string, path string, content binary")
    values = spark.createDataFrame([("a", 1, 5.0), ("a", 0, 4.0), ("b", 0, 1.0)], "session string, i long, v double")
    got = mat_sink.rewritten(files, values, {"v": ["behavior", "v"]})
    (one,) = got.collect()
    assert one.path == "a/a.x" and sf.parse_mat(bytes(one.content))["behavior"]["v"].ravel().tolist() == [4.0, 5.0]
    assert "broadcasthashjoin" not in got._jdf.queryExecution().toString().lower()


def test_samples_stay_off_the_driver(spark, tmp_path, monkeypatch):
    a = np.linspace(0, 12 * np.pi, 200)
    written(tmp_path, 50 + 30 * np.cos(a), 20 + 30 * np.sin(a))
    plans, one = [], bf.mat_sink.update_behavior
    monkeypatch.setattr(bf.mat_sink, "update_behavior", lambda s, r, values, paths: plans.append(values._jdf.queryExecution().toString().lower()) or one(s, r, values, paths))
    bf.filter_jumps(spark, str(tmp_path))
    bf.linearize_circle(spark, str(tmp_path))
    assert len(plans) == 3 and not any("broadcasthashjoin" in p for p in plans)
