import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import batch, binary_signal as bs, metadata, session_files as sf


def test_binary_source_prunes_channels_and_time(spark, tmp_path):
    x = np.arange(400, dtype=np.int16).reshape(100, 4)
    a, b = tmp_path / "a.dat", tmp_path / "b.dat"
    x[:60].tofile(a)
    x[60:].tofile(b)
    df = bs.read(spark, [str(a), str(b)], 4, 10.0, select=[1, 3])
    assert df.count() == 200 and {r.channel for r in df.select("channel").distinct().collect()} == {1, 3}
    got = {(r.channel, r.sample_idx): r.value for r in df.collect()}
    assert got[(3, 99)] == 399 and got[(1, 60)] == 241
    cut = bs.read(spark, [str(a), str(b)], 4, 10.0, select=[0], start=5.5, stop=6.5)
    assert sorted(r.sample_idx for r in cut.collect()) == list(range(55, 66))
    with pytest.raises(Exception, match="whole samples"):
        bs.read(spark, str(a), 7, 10.0).count()


def raw(spark):
    x = np.arange(100).reshape(25, 4)
    return spark.createDataFrame([(c, i, int(x[i, c])) for i in range(25) for c in range(4)], "channel int, sample_idx long, value short")


def iv(spark, *pairs):
    return spark.createDataFrame([tuple(map(int, p)) for p in pairs], "start long, stop long")


def test_raw_operations(spark):
    cut = bs.cut_artifacts(raw(spark), iv(spark, (5, 10), (15, 20)))
    one = cut.where("channel = 0").orderBy("sample_idx").collect()
    assert [r.sample_idx for r in one] == list(range(15))
    assert [r.value // 4 for r in one] == [*range(5), *range(10, 15), *range(20, 25)]
    flat = bs.remove_artifacts(raw(spark), iv(spark, (5, 10), (20, 99)), "zeros", [1]).where("value = 0 and channel = 1").count()
    assert flat == 5
    line = bs.remove_artifacts(raw(spark), iv(spark, (5, 10))).where("channel = 0 and sample_idx between 5 and 9").orderBy("sample_idx").collect()
    assert [r.value for r in line] == [20, 25, 30, 35, 40]
    with pytest.raises(NotImplementedError):
        bs.remove_artifacts(raw(spark), iv(spark, (5, 10)), "gaussian")
    filled = bs.fill_channels(raw(spark), [1])
    assert filled.where("channel = 1 and value = 0").count() == 25 and filled.where("channel = 4").count() == 25
    assert bs.reorder_channels(raw(spark), [3, 2, 1, 0]).where("channel = 0 and sample_idx = 0").first().value == 3


def test_mat_round_trip_and_events(spark, tmp_path):
    v = {"ripples": {"timestamps": np.array([[1.0, 2.0], [4.0, 5.0]]), "peaks": np.array([1.5, 4.5]), "amplitude": 3.0, "name": "x", "list": ["a", {"b": 1.0}]}}
    back = sf.parse_mat(sf.build_mat(v))
    assert np.allclose(back["ripples"]["timestamps"], v["ripples"]["timestamps"]) and back["ripples"]["name"] == "x"
    assert back["ripples"]["list"][1]["b"][0, 0] == 1.0
    d = tmp_path / "sess1"
    d.mkdir()
    (d / "sess1.ripples.events.mat").write_bytes(sf.build_mat(v))
    e = sf.read_mat_events(spark, str(tmp_path / "*" / "*.ripples.events.mat"), "ripples").orderBy("event_id").collect()
    assert [(r.session, r.start, r.peak, r.amplitude, r.frequency) for r in e] == [("sess1", 1.0, 1.5, 3.0, None), ("sess1", 4.0, 4.5, 3.0, None)]


def test_xml_position_and_text(spark, tmp_path):
    d = tmp_path / "s"
    d.mkdir()
    (d / "s.xml").write_text("<parameters><acquisitionSystem><nChannels>4</nChannels><samplingRate>20000</samplingRate></acquisitionSystem><fieldPotentials><lfpSamplingRate>1250</lfpSamplingRate></fieldPotentials><spikeDetection><channelGroups><group><channels><channel>2</channel><channel>0</channel></channels></group><group><channels><channel>1</channel></channels></group></channelGroups></spikeDetection></parameters>")
    h = sf.read_xml(spark, str(d / "*.xml"))
    r = h.first()
    assert (r.session, r.n_channels, r.fs_lfp, r.fs_dat, r.groups) == ("s", 4, 1250.0, 20000.0, [[2, 0], [1]])
    assert [(x.shank, x.nth, x.channel) for x in sf.probe_layout(h).collect()] == [(0, 0, 2), (0, 1, 0), (1, 0, 1)]
    (d / "s.whl").write_text("a\tb\tc\td\n1\t2\t3\t4\n-1\t-1\t5\t6\n")
    p = sf.read_position(spark, str(d / "s.whl"), 2.0).orderBy("sample_idx").collect()
    assert [x.t for x in p] == [0.0, 0.5] and p[1].x1 is None and p[1].x2 == 5
    e = spark.createDataFrame([(1.0, 2.0)], "start double, stop double")
    sf.write_events(e, str(tmp_path / "evt"), "ripple")
    assert [r.value for r in spark.read.text(str(tmp_path / "evt")).collect()] == ["1000.000000 ripple start 1", "2000.000000 ripple end 1"]
    sf.write_epochs(e, str(tmp_path / "ev"), "task", "me")
    assert sf.read_events(spark, str(tmp_path / "ev"), "task").first().peak == 1.5


def test_log_epochs(spark, tmp_path):
    (tmp_path / "phy.log").write_text("x 10:00:00 a\n10:00:10 b\n10:05:00 c\n")
    got = sf.read_log_epochs(spark, str(tmp_path / "phy.log")).orderBy("start").collect()
    assert [(r.start, r.stop) for r in got] == [(0.0, 10.0), (300.0, 300.0)]


def test_batch_skips_what_is_done(spark, tmp_path):
    path = str(tmp_path / "out")
    s = spark.createDataFrame([("a",), ("b",), ("a",)], "session string")
    calls = str(tmp_path / "calls")

    def f(session, k=1):
        with open(calls, "a") as h:
            h.write(session)
        if session == "b" and k == 1:
            raise ValueError("no")
        return pd.DataFrame({"x": [len(session) * k]})

    got = batch.run(s, f, "x long", path, skip_if_error=True)
    assert {(r.session, r.x) for r in got.collect()} == {("a", 1), ("b", None)}
    batch.run(s, f, "x long", path, k=2)
    assert open(calls).read().count("a") == 1 and open(calls).read().count("b") == 2
    assert "save_file" in batch.load_results(spark, path, file_name=True).columns
    with pytest.raises(ValueError):
        batch.load_results(spark, str(tmp_path / "nothing"))


def test_metadata(spark):
    u = spark.createDataFrame([(1, "Pyramidal", "CA1", False), (2, "Interneuron", "CA1", False), (3, "Pyramidal", "PFC", True)], "unit int, kind string, region string, bad boolean")
    assert [r.unit for r in metadata.select_units(u, {"kind": ["Pyr"], "region": ["CA1", "PFC"]}, "bad").collect()] == [1]
    p = spark.createDataFrame([(0, float(t)) for t in range(0, 100, 5)] + [(1, 1.0)], "unit int, t double")
    assert {r.unit for r in metadata.drop_unstable(p, 25.0, 0.0, 100.0).select("unit").distinct().collect()} == {0}
    t = spark.createDataFrame([({"ripple": [5]},), ({"CA1sp": [3, 4]},)], "tags map<string, array<int>>")
    assert [r[0] for r in t.select(metadata.first_tag(F.col("tags"), ["ripple", "CA1sp"])).collect()] == [4, 2]
