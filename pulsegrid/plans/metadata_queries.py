"""Queries over session structures: the driver's tables are written as MAT files in memory, read back, and compared."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..catalog import query
from ..sources import session_metadata as md
from ..sources.session_files import build_mat
from .fixtures import EV, ev, table


def _mats(rows: DataFrame, key: str, make) -> DataFrame:
    """(path, content): a file for each key, of the variables that ``make`` gives for its rows."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        k = g[key].iloc[0]
        return pd.DataFrame({"path": [f"data/animal{k}/session{k}/session{k}.mat"], "content": [build_mat(make(g))]})

    return rows.groupBy(key).applyInPandas(run, "path string, content binary")



def _nations(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").select("n_regionkey", "n_nationkey", "n_name")


def _session(g: pd.DataFrame) -> dict:
    g = g.sort_values("n_nationkey")
    one = [{"name": n, "startTime": float(k), "stopTime": k + 0.5} | ({"environment": f"box{k % 3}"} if k % 2 else {}) for k, n in zip(g.n_nationkey, g.n_name)]
    k = int(g.n_regionkey.iloc[0])
    epochs = one[0] if k == 3 else one  # one epoch may stand by itself
    return {"session": {"animal": {"name": f"rat{k}"}, "epochs": epochs, "extracellular": {"nChannels": np.array([[k + 2.0]]), "sr": np.array([[20000.0]])}}}


def _sessions(spark, sf) -> DataFrame:
    return md.structs(_mats(_nations(spark, sf), "n_regionkey", _session), "session")


_EPOCHS = """e AS (SELECT n_regionkey AS k, n_nationkey AS i, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS nth FROM nation)"""


@query(f"WITH {_EPOCHS} SELECT 'session' || k AS session, nth::INTEGER AS epoch_id, name, i::DOUBLE AS start, i + 0.5::DOUBLE AS stop, CASE WHEN i % 2 = 1 THEN 'box' || (i % 3) END AS environment FROM e WHERE k <> 3 OR nth = 0")
def session_epochs(spark, sf):
    return md.session_epochs(_sessions(spark, sf)).select("session", "epoch_id", "name", "start", "stop", "environment")


@query("SELECT DISTINCT 'data/animal' || n_regionkey || '/session' || n_regionkey AS basepath, 'rat' || n_regionkey AS animal FROM nation")
def session_animals(spark, sf):
    return md.animals(_sessions(spark, sf)).select("basepath", "animal")


@query("SELECT n_nationkey, CASE WHEN n_regionkey < 5 THEN 'rat' || n_regionkey END AS animal_id FROM nation")
def add_animal_id(spark, sf):
    rows = _nations(spark, sf).withColumn("basepath", F.format_string("data/animal%d/session%d", "n_regionkey", "n_regionkey"))
    return md.with_animal(rows, _sessions(spark, sf)).select("n_nationkey", "animal_id")


@query("SELECT DISTINCT 'session' || n_regionkey AS session, n_regionkey + 2.0::DOUBLE AS channels, 20000.0::DOUBLE AS rate FROM nation")
def extracellular_metadata(spark, sf):
    x = md.extracellular(_sessions(spark, sf))
    of = lambda k: F.from_json(F.col("fields")[k], "array<double>")[0]
    return x.select("session", of("nChannels").alias("channels"), of("sr").alias("rate"))


# trials in both layouts, behaviour


def _behaviour(g: pd.DataFrame) -> dict:
    g = g.sort_values("s_suppkey")
    k = int(g.s_nationkey.iloc[0])
    t = np.arange(len(g), dtype=float)
    ts = np.stack([t, t + 0.75], axis=1)
    trials = {"starts": ts[:, :1], "stops": ts[:, 1:], "stateName": [f"arm{i % 3}" for i in g.s_suppkey]} if k % 2 else ts
    out = {"timestamps": t[:, None] / 2, "position": {"x": g.s_acctbal.to_numpy()[:, None], "y": (2.0 * t)[:, None], "units": "cm"}, "states": t[:, None] % 3, "trials": trials, "timeSeries": {"light": t[:, None] + 1}}
    return {"behavior": out if k % 2 else out | {"trialsID": [f"arm{i % 3}" for i in g.s_suppkey]}}


def _behaviours(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return md.structs(_mats(s, "s_nationkey", _behaviour), "behavior")


_SUP = "s AS (SELECT s_nationkey AS k, s_suppkey AS id, s_acctbal AS x, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INTEGER AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)"


@query(f"WITH {_SUP} SELECT 'session' || k AS session, i AS trial, i::DOUBLE AS start, i + 0.75::DOUBLE AS stop, 'arm' || (id % 3) AS name FROM s")
def load_trials(spark, sf):
    return md.trials(_behaviours(spark, sf))


@query(
    f"""WITH {_SUP}, g AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM s WINDOW w AS (PARTITION BY k ORDER BY i)),
v AS (SELECT *, CASE WHEN n = 1 THEN NULL ELSE sqrt(pow(CASE WHEN a IS NULL THEN (b - x) * 2 WHEN b IS NULL THEN (x - a) * 2 ELSE b - a END, 2) + 16) END AS speed FROM g)
SELECT 'session' || k AS session, i, i / 2.0::DOUBLE AS t, x, 2.0::DOUBLE * i AS y, (i % 3)::DOUBLE AS states, i + 1.0::DOUBLE AS light, round(speed, 4) AS speed, round(CASE WHEN i = 0 THEN 0 ELSE (speed - lag(speed) OVER (PARTITION BY k ORDER BY i)) * 2 END, 4) AS acceleration FROM v"""
)
def load_animal_behavior(spark, sf):
    b = md.behaviour(_behaviours(spark, sf))
    return b.select("session", "i", "t", "x", "y", F.col("fields")["states"].alias("states"), F.col("fields")["timeSeries_light"].alias("light"), F.round("speed", 4).alias("speed"), F.round("acceleration", 4).alias("acceleration"))


@query(
    f"""WITH {_SUP}, m AS (SELECT k, i / 2.0::DOUBLE AS t FROM s), h AS (SELECT m.k, m.t, max(s.i) AS trial FROM m LEFT JOIN s ON s.k = m.k AND m.t BETWEEN s.i AND s.i + 0.75 GROUP BY ALL) SELECT 'session' || k AS session, t, trial FROM h"""
)
def behavior_trials(spark, sf):
    b = _behaviours(spark, sf)
    return md.labelled(md.behaviour(b).select("session", "t"), md.trials(b), ["trial"], 10.0)


# sleep states


def _states(g: pd.DataFrame) -> dict:
    g = g.sort_values("event_id")
    ints = {}
    for kind, x in g.groupby("kind"):
        ints[f"{kind}state"] = np.stack([x.t.to_numpy(), x.t.to_numpy() + x.value.to_numpy()], axis=1)
    names = ["WAKE", np.zeros((0, 0)), "NREM", np.zeros((0, 0)), "REM"]
    k = g.event_id.to_numpy() % 6
    return {"SleepState": {"ints": ints, "idx": {"states": k[:, None].astype(float), "timestamps": g.t.to_numpy()[:, None], "statenames": names}}}


def _sleep(spark, sf) -> DataFrame:
    return md.structs(_mats(ev(spark, sf), "unit", _states), "SleepState")


@query(f"WITH {EV} SELECT 'session' || unit AS session, kind || 'state' AS state, round(t, 6) AS start, round(t + value, 6) AS stop FROM ev WHERE kind IN ('view', 'error')")
def sleep_state_intervals(spark, sf):
    return md.sleep_intervals(_sleep(spark, sf), ["viewstate", "errorstate"]).select("session", "state", F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"))


@query(f"WITH {EV} SELECT 'session' || unit AS session, round(t, 6) AS t, (event_id % 6)::INTEGER AS state_id, CASE event_id % 6 WHEN 1 THEN 'WAKE' WHEN 3 THEN 'NREM' WHEN 5 THEN 'REM' END AS state FROM ev")
def sleep_state_samples(spark, sf):
    return md.sleep_samples(_sleep(spark, sf)).withColumn("t", F.round("t", 6))


# cell metrics


def _cells(g: pd.DataFrame) -> dict:
    g = g.sort_values("s_suppkey")
    k = int(g.s_nationkey.iloc[0])
    uid = np.arange(1, len(g) + 1, dtype=float)
    bad = uid[g.s_suppkey.to_numpy() % 4 == 0]
    times = [np.array([[float(i)], [i + 0.5], [i + 0.75]]) for i in g.s_suppkey]
    return {"cell_metrics": {
        "UID": uid[None, :], "firingRate": g.s_acctbal.to_numpy()[None, :], "brainRegion": [f"CA{i % 3 + 1}" for i in g.s_suppkey], "tags": {"Bad": bad[None, :], "Good": uid[None, :]},
        "general": {"basename": f"session{k}", "cellCount": np.array([[float(len(g))]]), "animal": {"sex": "f"}}, "spikes": {"times": times}, "acg": {"wide": np.zeros((3, 2))},
    }}


def _cell_files(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return md.structs(_mats(s, "s_nationkey", _cells), "cell_metrics")


@query(f"WITH {_SUP} SELECT 'session' || k AS session, i + 1 AS uid, round(x, 6) AS rate, 'CA' || (id % 3 + 1) AS region, id % 4 = 0 AS bad, CASE WHEN id % 4 = 0 THEN 'Bad,Good' ELSE 'Good' END AS tags, 'session' || k AS basename FROM s WHERE n > 1")
def load_cell_metrics(spark, sf):
    u = md.units(_cell_files(spark, sf))
    many = u.select("*", F.count(F.lit(1)).over(md.Window.partitionBy("session")).alias("_n")).where("_n > 1")
    f = F.col("fields")
    return many.select("session", "uid", F.round(f["firingRate"].cast("double"), 6).alias("rate"), f["brainRegion"].alias("region"), "bad", F.array_join("tags", ",").alias("tags"), F.col("general")["basename"].alias("basename"))


@query(f"WITH {_SUP} SELECT 'session' || k AS session, i AS nth, id + d AS t FROM s, (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) v(d)")
def cell_spike_times(spark, sf):
    return md.unit_spikes(_cell_files(spark, sf))


@query("SELECT 'units' AS what, count(*) AS n FROM supplier UNION ALL SELECT 'spikes', 3 * count(*) FROM supplier UNION ALL SELECT 'epochs', sum(CASE WHEN n_regionkey = 3 THEN 0 ELSE 1 END)::BIGINT + 1 FROM nation UNION ALL SELECT 'recordings', count(DISTINCT n_regionkey) FROM nation")
def load_basic_data(spark, sf):
    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    found = md.basic_data(_mats(_nations(spark, sf), "n_regionkey", _session).unionByName(_mats(s, "s_nationkey", _cells)))
    counts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("what"), "n") for k, d in found.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


# unit metrics by epoch, phase locking


def _by_epoch(g: pd.DataFrame) -> dict:
    g = g.sort_values("s_suppkey")
    col = lambda v: np.asarray(v, float)[:, None]
    if len(g) < 2:
        return {"SWRunitMetrics": {"pre": np.zeros((0, 0))}}
    pre = {"particip": col(g.s_acctbal / 2), "gain": col(g.s_suppkey), "window": np.array([[1.0, 2.0, 3.0] * 50])}
    return {"SWRunitMetrics": {"pre": pre, "task": {"particip": col(g.s_acctbal), "gain": col(g.s_suppkey * 2)}, "post": np.zeros((0, 0))}}


@query(f"WITH {_SUP} SELECT 'session' || k AS session, e AS epoch, i AS nth, round(x / CASE e WHEN 'pre' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END, 6) AS particip, (id * CASE e WHEN 'pre' THEN 1 ELSE 2 END)::DOUBLE AS gain FROM s, (VALUES ('pre'), ('task')) v(e) WHERE n > 1")
def swr_unit_metrics(spark, sf):
    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    m = md.metrics_by_epoch(md.structs(_mats(s, "s_nationkey", _by_epoch), "SWRunitMetrics"))
    return m.select("session", "epoch", "nth", F.round(F.col("fields")["particip"].cast("double"), 6).alias("particip"), F.col("fields")["gain"].cast("double").alias("gain"))


def _shifts(g: pd.DataFrame) -> dict:
    g = g.sort_values("s_suppkey")
    row = lambda v: np.asarray(v, float)[None, :]
    x = g.s_acctbal.to_numpy()
    state = lambda f: {"phasestats": {"m": row(x * f), "r": row(x / 1e4), "k": row(x + 1), "p": row(x * 0 + 0.01), "mode": row(-x)}, "phasedistros": np.stack([x * f, x + f])}
    return {"rem_shift_data": {"UID": row(np.arange(1, len(g) + 1)), "circ_dist": row(x), "rem_shift": row(x > 0), "non_rem_shift": row(x <= 0), "PhaseLockingData_rem": state(1.0), "PhaseLockingData_wake": state(2.0)}}


def _shift_files(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return md.structs(_mats(s, "s_nationkey", _shifts), "rem_shift_data")


@query(f"WITH {_SUP} SELECT 'session' || k AS session, i + 1 AS uid, v.s AS state, round(x * f, 4) AS m, round(x + 1, 4) AS k, round(-x, 4) AS mode, (x > 0)::INTEGER::DOUBLE AS rem_shift FROM s, (VALUES ('rem', 1.0::DOUBLE), ('wake', 2.0::DOUBLE)) v(s, f)")
def theta_rem_shift(spark, sf):
    x = md.phase_shifts(_shift_files(spark, sf))
    return x.select("session", "uid", "state", F.round("m", 4).alias("m"), F.round("k", 4).alias("k"), F.round("mode", 4).alias("mode"), "rem_shift")


@query(f"WITH {_SUP} SELECT 'session' || k AS session, v.s AS state, i AS nth, round(x * f, 4) AS first, round(x + f, 4) AS second FROM s, (VALUES ('rem', 1.0::DOUBLE), ('wake', 2.0::DOUBLE)) v(s, f) WHERE n > 1")
def theta_phase_distributions(spark, sf):
    x = md.phase_distributions(_shift_files(spark, sf)).select("*", F.count(F.lit(1)).over(md.Window.partitionBy("session", "state")).alias("_n")).where("_n > 1")
    return x.select("session", "state", "nth", F.round(F.col("distribution")[0], 4).alias("first"), F.round(F.col("distribution")[1], 4).alias("second"))


# muscle signal, manipulations, barrages


def _emg(g: pd.DataFrame) -> dict:
    g = g.sort_values("event_id")
    return {"EMGFromLFP": {"data": g.value.to_numpy()[:, None], "timestamps": np.arange(len(g), dtype=float)[:, None]}}


@query(
    f"""WITH {EV}, n AS (SELECT unit, value, row_number() OVER (PARTITION BY unit ORDER BY event_id) - 1 AS i FROM ev), f AS (SELECT unit, i, 'high' AS state FROM n WHERE value > 40 UNION ALL SELECT unit, i, 'low' FROM n WHERE value < 40),
g AS (SELECT *, i - row_number() OVER (PARTITION BY unit, state ORDER BY i) AS g FROM f) SELECT 'session' || unit AS session, state, min(i)::DOUBLE AS start, max(i)::DOUBLE AS stop FROM g GROUP BY unit, state, g"""
)
def load_emg(spark, sf):
    return md.emg_epochs(md.emg(md.structs(_mats(ev(spark, sf), "unit", _emg), "EMGFromLFP")), 40.0)


def _manipulation(g: pd.DataFrame) -> dict:
    g = g.sort_values("event_id")
    t = g.t.to_numpy()
    col = lambda v: np.asarray(v, float)[:, None]
    # as many labels as there are numbers, in their order
    ids = g.event_id.to_numpy() % 3 * 10
    return {"pulses": {"timestamps": np.stack([t, t + 600], axis=1), "peaks": col(t + 300), "center": col(t + 300), "duration": col(t * 0 + 600), "amplitude": col(g.value), "amplitudeUnits": "V", "eventID": col(ids), "eventIDlabels": [f"kind{i}" for i in np.unique(ids)]}}


def _manipulations(spark, sf) -> DataFrame:
    return md.manipulations(md.structs(_mats(ev(spark, sf), "unit", _manipulation), "pulses"))


@query(f"WITH {EV} SELECT 'session' || unit AS session, (row_number() OVER (PARTITION BY unit ORDER BY event_id) - 1)::INTEGER AS nth, round(t, 6) AS start, round(t + 300, 6) AS peak, value AS amplitude, 'kind' || (event_id % 3 * 10) AS label FROM ev")
def load_manipulation(spark, sf):
    return _manipulations(spark, sf).select("session", "nth", F.round("start", 6).alias("start"), F.round("peak", 6).alias("peak"), "amplitude", "label")


@query(
    f"""WITH {EV}, a AS (SELECT unit, event_id % 3 AS k, t AS start, t + 600 AS stop FROM ev), b AS (SELECT *, max(stop) OVER (PARTITION BY unit, k ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a),
c AS (SELECT *, sum(CASE WHEN reach IS NULL OR start - reach > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY unit, k ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM b)
SELECT 'session' || unit AS session, 'kind' || (k * 10) AS label, round(min(start), 6) AS start, round(max(stop), 6) AS stop FROM c GROUP BY unit, k, g"""
)
def manipulation_epochs(spark, sf):
    return md.manipulation_epochs(_manipulations(spark, sf), 3600.0).select("session", "label", F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"))


@query(
    f"""WITH {EV}, e AS (SELECT unit, event_id, t AS start, t + value * 200 AS stop FROM ev WHERE kind = 'signup'), n AS (SELECT unit, t - 2 AS lo, t + 43200 + 2 AS hi FROM ev WHERE kind = 'purchase')
SELECT unit AS session, event_id FROM e WHERE stop - start > 600 AND EXISTS (SELECT 1 FROM n WHERE n.unit = e.unit AND e.start BETWEEN lo AND hi) AND EXISTS (SELECT 1 FROM ev s WHERE s.unit = e.unit AND s.kind = 'click' AND s.t BETWEEN e.start AND e.stop)"""
)
def load_barrage_events(spark, sf):
    e = ev(spark, sf).withColumnRenamed("unit", "session")
    barrages = e.where("kind = 'signup'").select("session", "event_id", F.col("t").alias("start"), (F.col("t") + F.col("value") * 200).alias("stop"))
    nrem = e.where("kind = 'purchase'").select("session", F.col("t").alias("start"), (F.col("t") + 43200).alias("stop"))
    return md.barrages(barrages, e.where("kind = 'click'").select("session", "t"), nrem, 600.0, width=21600.0).select("session", "event_id")


