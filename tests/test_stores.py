import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import binary_signal as bs, mat_sink, session_files as sf, stores


def recording(tmp_path, n=1000, channels=4):
    x = np.arange(n * channels, dtype=np.int16).reshape(n, channels)
    a, b = str(tmp_path / "a.dat"), str(tmp_path / "b.dat")
    x[:600].tofile(a)
    x[600:].tofile(b)
    return x, [a, b]


def reader(paths, **options):
    return bs._Reader({"path": ",".join(paths), "channels": "4", "fs": "100", "block": "50", **options})


def pushed(r, *filters):
    assert list(r.pushFilters(list(filters))) == list(filters)  # Spark evaluates them all again
    return r


def test_conditions_prune_blocks_and_bytes(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    _, paths = recording(tmp_path)
    assert len(reader(paths).partitions()) == 20
    r = pushed(reader(paths), GreaterThanOrEqual(("sample_idx",), 590), LessThan(("sample_idx",), 612))
    assert [(os.path.basename(p.path), p.lo, p.hi) for p in r.partitions()] == [("a.dat", 590, 600), ("b.dat", 0, 13)]
    r = pushed(reader(paths), EqualTo(("channel",), 2), In(("sample_idx",), (10, 12)))
    assert [(p.lo, p.hi) for p in r.partitions()] == [(10, 13)] and r.chosen == [2]
    assert pushed(reader(paths), EqualTo(("channel",), 9)).partitions() == []
    r = pushed(reader(paths), GreaterThanOrEqual(("t",), 9.97))
    assert sum(p.hi - p.lo for p in r.partitions()) <= 5


def test_a_plan_reads_only_what_was_asked(spark, tmp_path):
    x, paths = recording(tmp_path)
    df = bs.read(spark, paths, 4, 100.0, block=50)
    some = df.where("sample_idx between 595 and 604 and channel in (1, 3)")
    assert some.rdd.getNumPartitions() == 2
    assert {(r.channel, r.sample_idx): r.value for r in some.collect()} == {(c, i): float(x[i, c]) for c in (1, 3) for i in range(595, 605)}
    assert df.where("t >= 3.0 and t < 3.2").count() == 80
    uri = [f"file://{p}" for p in paths]
    assert bs.read(spark, uri, 4, 100.0).where("sample_idx = 700").count() == 4


def test_recordings_are_cut_like_matrices(spark, tmp_path):
    x, paths = recording(tmp_path)
    rec = bs.Recording(spark, paths, 4, 100.0, block=50)
    assert rec.shape == (1000, 4) and rec.T.shape == (4, 1000) and len(rec.T) == 4 and rec.T.T.shape == rec.shape

    def same(df, rows, columns):
        rows, columns = np.atleast_1d(np.arange(1000)[rows]), np.atleast_1d(np.arange(4)[columns])
        assert sorted((r.sample_idx, r.channel, r.value) for r in df.collect()) == sorted((int(i), int(c), float(x[i, c])) for i in rows for c in columns)

    same(rec[590:610, [0, -1]], slice(590, 610), [0, -1])
    same(rec[-3], -3, slice(None))
    same(rec[::250, 2], slice(None, None, 250), 2)
    same(rec[20:10:-3], slice(20, 10, -3), slice(None))
    mask = np.zeros(1000, bool)
    mask[[5, 700]] = True
    same(rec[mask, 1:3], mask, slice(1, 3))
    same(rec.T[1, 3:6], slice(3, 6), 1)
    assert rec[5:5].count() == 0 and rec[[]].count() == 0
    for bad in (1000, (0, 4), (0, 0, 0), np.ones(7, bool)):
        with pytest.raises(IndexError):
            rec[bad]


def test_blocks_written_are_the_recording(spark, tmp_path):
    x, paths = recording(tmp_path)
    raw = bs.read(spark, paths, 4, 100.0)
    stores.save_files(bs.block_files(raw, "part", 4, block=300), str(tmp_path / "out"))
    files = stores.files_below(str(tmp_path / "out"))
    assert [os.path.basename(f) for f in files] == [f"part-{k:08d}.dat" for k in range(4)]
    assert (np.concatenate([np.fromfile(f, np.int16) for f in files]).reshape(-1, 4) == x).all()


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    def fail(frames):
        for f in frames:
            if (f["path"] == "s3/x.bin").any():
                raise RuntimeError("lost")
            yield f

    rows = spark.createDataFrame([(f"s{i}/x.bin", bytes([i])) for i in range(6)], "path string, content binary").repartition(6)
    root = str(tmp_path / "out")
    with pytest.raises(Exception, match="lost"):
        stores.save_files(rows.mapInPandas(fail, "path string, content binary"), root)
    assert not [f for f in stores.files_below(root) if "_writing" not in f]  # a task that was still running may leave a file there
    root = str(tmp_path / "again")
    stores.save_files(rows, root)
    assert [open(f, "rb").read() for f in stores.files_below(root)] == [bytes([i]) for i in range(6)]
    stores.save_files(rows.where("path = 's2/x.bin'").withColumn("content", F.lit(b"new")), root)  # replaced by a move
    assert open(f"{root}/s2/x.bin", "rb").read() == b"new" and len(stores.files_below(root)) == 6
    with pytest.raises(Exception, match="same file"):
        stores.save_files(rows.withColumn("path", F.lit("one")), root)
    assert len(stores.files_below(root)) == 6


def test_event_files_are_read_back(spark, tmp_path):
    rows = [("a", 2.0, 2.5, 2.2, 7.0, 150.0, 5.0), ("a", 1.0, 1.25, 1.1, 3.0, 140.0, 4.0), ("b", 9.0, 9.5, 9.1, 1.0, 120.0, 3.5)]
    e = spark.createDataFrame(rows, "session string, start double, stop double, peak double, amplitude double, frequency double, peak_normed_power double")
    every = spark.createDataFrame([("a",), ("b",), ("quiet",)], "session string")
    mat_sink.save_ripples(e, str(tmp_path), channel=3, parameters={"low": 1.0}, intervals=[(0.0, 10.0)], detected_on="2024-01-01", sessions=every)
    got = sf.read_mat_events(spark, str(tmp_path / "*" / "*.ripples.events.mat"), "ripples").orderBy("session", "start").collect()
    assert [(r.session, r.start, r.stop, r.peak, r.amplitude, r.duration, r.frequency) for r in got] == [(s, a, b, p, m, b - a, f) for s, a, b, p, m, f, _ in sorted(rows)]
    tree = sf.parse_mat((tmp_path / "a" / "a.ripples.events.mat").read_bytes())["ripples"]
    info = tree["detectorinfo"]
    assert info["detectionchannel"][0, 0] == 3 and info["detectionchannel1"][0, 0] == 4 and info["detectionparms"]["low"][0, 0] == 1 and info["detectiondate"] == "2024-01-01"
    assert tree["peakNormedPower"].ravel().tolist() == [4.0, 5.0] and tree["center"].ravel().tolist() == [1.125, 2.25] and tree["timestamps"].shape == (2, 2)
    quiet = sf.parse_mat((tmp_path / "quiet" / "quiet.ripples.events.mat").read_bytes())["ripples"]
    assert quiet["timestamps"].shape == (0, 2) and quiet["peaks"].size == 0
    mat_sink.save_dentate_spikes(e, str(tmp_path), hilus=5, molecular=9, noise=1)
    ds = sf.parse_mat((tmp_path / "b" / "b.DS2.events.mat").read_bytes())["DS2"]
    assert ds["amplitudeUnits"] == "mV" and ds["amplitudes"].ravel().tolist() == [1.0] and ds["detectorinfo"]["noise_channel"][0, 0] == 1 and ds["detectorinfo"]["ml_channel"][0, 0] == 9


def test_map_files(spark, tmp_path):
    maps = spark.createDataFrame([("s", u, x, y, float(10 * u + x + y)) for u in (4, 7) for x in range(3) for y in range(2) if (x, y) != (2, 1)], "session string, unit long, x int, y int, rate double")
    fields = spark.createDataFrame([("s", 7, 0, 0, 1), ("s", 7, 1, 0, 1), ("s", 7, 1, 1, 2)], "session string, unit long, x int, y int, field int")
    spent = spark.createDataFrame([("s", x, y, 0.5) for x in range(3) for y in range(2)], "session string, x int, y int, seconds double")
    stores.save_files(mat_sink.map_files(maps, fields, spent), str(tmp_path))
    tree = sf.parse_mat((tmp_path / "s" / "s.ratemap.firingRateMap.mat").read_bytes())["firingRateMap"]
    assert tree["UID"].tolist() == [[4.0, 7.0]] and tree["map"][1][1, 0] == 71 and np.isnan(tree["map"][0][2, 1])
    assert tree["n_fields"].tolist() == [[0.0, 2.0]] and tree["size"].tolist() == [[0.0, 2.0]] and tree["peak"][0, 1] == 71 and tree["occupancy"].sum() == 3.0


def test_one_variable_is_written_anew(spark, tmp_path):
    old = {"behavior": {"timestamps": np.arange(3.0)[None], "position": {"x": np.ones((3, 1)), "units": "cm"}, "notes": ["a", {"b": 1.0}]}, "other": np.eye(2)}
    data = sf.build_mat(old)
    new = mat_sink.replace_variable(data, ["behavior", "position", "linearized"], np.array([[1.0], [2.0]]))
    tree = sf.parse_mat(new)
    assert tree["behavior"]["position"]["linearized"].ravel().tolist() == [1.0, 2.0] and tree["behavior"]["position"]["units"] == "cm" and (tree["other"] == np.eye(2)).all()
    assert tree["behavior"]["notes"][1]["b"][0, 0] == 1.0
    assert data[data.rindex(b"other") - 32 :] in new  # untouched bytes
    again = sf.parse_mat(mat_sink.replace_variable(new, ["behavior", "position", "x"], np.zeros((2, 1))))
    assert again["behavior"]["position"]["x"].tolist() == [[0.0], [0.0]] and again["behavior"]["timestamps"].tolist() == [[0.0, 1.0, 2.0]]
    assert sf.parse_mat(mat_sink.replace_variable(data, ["fresh", "a"], 5.0))["fresh"]["a"][0, 0] == 5.0
    with pytest.raises(ValueError, match="no field"):
        mat_sink.replace_variable(data, ["other", "a"], 1.0)
    for s in ("u", "v"):
        (tmp_path / s).mkdir()
        (tmp_path / s / f"{s}.animal.behavior.mat").write_bytes(data)
    values = spark.createDataFrame([("u", i, float(9 - i)) for i in (2, 0, 1)], "session string, i int, value double")
    mat_sink.update_behavior(spark, str(tmp_path), values, {"value": ["behavior", "position", "linearized"]})
    assert sf.parse_mat((tmp_path / "u" / "u.animal.behavior.mat").read_bytes())["behavior"]["position"]["linearized"].ravel().tolist() == [9.0, 8.0, 7.0]
    assert (tmp_path / "v" / "v.animal.behavior.mat").read_bytes() == data


def test_compressed_variables_are_replaced(spark):
    import struct
    import zlib

    inner = sf.build_mat({"s": {"x": 1.0}})[128:]
    body = zlib.compress(inner)
    data = sf.build_mat({})[:128] + struct.pack("<II", 15, len(body)) + body
    assert sf.parse_mat(mat_sink.replace_variable(data, ["s", "y"], 2.0))["s"]["y"][0, 0] == 2.0


def test_elements_of_cells_and_of_arrays_of_structures(spark):
    import struct

    from pulsegrid.sources.session_files import _pack, _pack_matrix

    data = sf.build_mat({"b": {"epochs": [{"a": 1.0}, {"a": 2.0}]}})
    new = sf.parse_mat(mat_sink.replace_variable(data, ["b", "epochs", 1, "circle", "radius"], 3.0))["b"]["epochs"]
    assert new[1]["circle"]["radius"][0, 0] == 3.0 and new[1]["a"][0, 0] == 2.0 and "circle" not in new[0]
    names = b"".join(n.ljust(32, b"\0") for n in (b"a", b"c"))
    array = _pack(6, struct.pack("<II", 2, 0)) + _pack(5, np.array([1, 2], "<i4").tobytes()) + _pack(1, b"e") + struct.pack("<HHi", 5, 4, 32) + _pack(1, names)
    array += b"".join(_pack(14, _pack_matrix("", v)) for v in (1.0, "x", 2.0, "y"))
    data = sf.build_mat({"first": 7.0}) + _pack(14, array)
    assert [e["c"] for e in sf.parse_mat(data)["e"]] == ["x", "y"]
    got = sf.parse_mat(mat_sink.replace_variable(mat_sink.replace_variable(data, ["e", 1, "a"], 9.0), ["e", 0, "r"], 5.0))
    assert got["e"][1]["a"][0, 0] == 9.0 and got["e"][0]["r"][0, 0] == 5.0 and got["e"][1]["r"].size == 0 and [e["c"] for e in got["e"]] == ["x", "y"] and got["first"][0, 0] == 7.0
    with pytest.raises(ValueError, match="elements"):
        mat_sink.replace_variable(data, ["e", 2, "a"], 1.0)
    with pytest.raises(ValueError, match="no field"):
        mat_sink.replace_variable(data, ["e", "a"], 1.0)
