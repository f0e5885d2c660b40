"""Metadata structures of sessions as tables.

A session's structures lie in MAT files. :func:`structs` turns each into one
row of JSON text, where missing fields are just absent; the tables are Spark
expressions over that text. Files come as (path, content), as
``spark.read.format("binaryFile")`` gives them, one session a folder.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators import intervals as iv, sequences as sq
from ..operators.joins import range_join

#: Fields of an epoch, in the names of the format (fixed values), and their columns here.
EPOCH_FIELDS = {
    "name": "name", "startTime": "start", "stopTime": "stop", "environment": "environment",
    "manipulation": "manipulation", "behavioralParadigm": "behavioral_paradigm", "stimuli": "stimuli", "notes": "notes",
}


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files that the path, with wildcards, names; any number of sessions."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _plain(v):
    """A variable as what JSON can hold: vectors and single values as flat lists, what is not a number as null."""
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if isinstance(v, str):
        return v
    x = np.asarray(v)
    if x.dtype.kind == "c":
        x = np.abs(x)
    if x.ndim > 1 and 1 in x.shape[:2]:
        x = x.ravel()
    rows = np.where(np.isfinite(x), x, None) if x.dtype.kind == "f" else x
    return rows.tolist()


def structs(mats: DataFrame, variable: str) -> DataFrame:
    """(session, basepath, data): a variable of each file as JSON text; files without it give no row."""
    import pyarrow as pa

    from .session_files import parse_mat

    def read(batches):
        rows, size = [], 0
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                found = parse_mat(c.as_py())
                if variable in found:
                    base = p.as_py().rsplit("/", 1)[0]
                    rows.append((base.rsplit("/", 1)[-1], base, json.dumps(_plain(found[variable]))))
                    size += len(rows[-1][2])
                if size > _TEXT:
                    yield batch(rows)
                    rows, size = [], 0
        yield batch(rows)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["session", "basepath", "data"])

    return mats.mapInArrow(read, "session string, basepath string, data string")


#: Characters of text that a task holds before it passes them on.
_TEXT = 1 << 22


def _get(path: str, of: str = "data") -> Column:
    return F.get_json_object(of, f"$.{path}")


def _list(text: Column) -> Column:
    """JSON text of a list, or of one thing, as that of a list."""
    return F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))


def _numbers(text: Column) -> Column:
    return F.from_json(_list(text), "array<double>")


def _words(text: Column) -> Column:
    """A list of strings, or one string that stands for a list of one."""
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).when(text.isNotNull(), F.array(text))


def _pairs(text: Column) -> Column:
    """Rows of two numbers; a single pair may stand by itself."""
    return F.from_json(F.when(text.startswith("[["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), "array<array<double>>")


def _fields(text: Column) -> Column:
    """The fields of a structure, each as JSON text."""
    return F.from_json(text, "map<string,string>")


def _once(value: Column) -> Column:
    """The value as a column that is made once a row: as a projection it would be merged into what reads it, and parsed for every row of a list."""
    return F.explode(F.array(value))


def _upto(n: Column) -> Column:
    """0 .. n - 1, nothing for null."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _nth(lists: Column, i: Column) -> Column:
    return F.transform_values(lists, lambda k, v: v[i])


def session_epochs(sessions: DataFrame) -> DataFrame:
    """(session, basepath, epoch_id, name, start, stop, environment, ...) of the session structure; fields that are not there are null."""
    kind = "array<struct<" + ",".join(f"{k}:{'array<double>' if k.endswith('Time') else 'string'}" for k in EPOCH_FIELDS) + ">>"
    e = sessions.select("session", "basepath", F.posexplode(F.from_json(_list(_get("epochs")), kind)).alias("epoch_id", "e"))
    return e.select("session", "basepath", "epoch_id", *[(F.col(f"e.{k}")[0] if k.endswith("Time") else F.col(f"e.{k}")).alias(c) for k, c in EPOCH_FIELDS.items()])


def trials(behaviour: DataFrame) -> DataFrame:
    """(session, trial, start, stop, name) of the behaviour structure: fields starts, stops and stateName, or rows of two with trialsID."""
    new = F.arrays_zip(_numbers(_get("trials.starts")).alias("start"), _numbers(_get("trials.stops")).alias("stop"), _words(_get("trials.stateName")).alias("name"))
    rows = _pairs(_get("trials"))
    old = F.arrays_zip(F.transform(rows, lambda r: r[0]).alias("start"), F.transform(rows, lambda r: r[1]).alias("stop"), F.coalesce(_words(_get("trialsID")), F.array()).alias("name"))
    t = F.when(_get("trials").startswith("{"), new).otherwise(old)
    got = behaviour.where(_get("trials").isNotNull() & (_get("trials") != "[]")).select("session", F.posexplode(t).alias("trial", "t"))
    return got.select("session", "trial", "t.start", "t.stop", "t.name").where("start is not null")


def sleep_intervals(states: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(session, state, start, stop) of the intervals of each state."""
    e = states.select("session", F.explode(_fields(_get("ints"))).alias("state", "_t"))
    e = e if names is None else e.where(F.col("state").isin(*names))
    e = e.select("session", "state", F.explode(_pairs(F.col("_t"))).alias("_r"))
    return e.select("session", "state", F.col("_r")[0].alias("start"), F.col("_r")[1].alias("stop")).where("start is not null")


def sleep_samples(states: DataFrame) -> DataFrame:
    """(session, t, state_id, state): the state at each time, with its name; ids count names from 1."""
    z = F.arrays_zip(_numbers(_get("idx.timestamps")).alias("t"), _numbers(_get("idx.states")).alias("k"))
    names = F.from_json(_list(_get("idx.statenames")), "array<string>")
    x = states.select("session", names.alias("_names"), F.explode(z).alias("e"))
    name = F.try_element_at("_names", F.greatest(F.col("e.k").cast("int"), F.lit(1)))
    return x.select("session", F.col("e.t").alias("t"), F.col("e.k").cast("int").alias("state_id"), F.when((F.col("e.k") > 0) & ~name.startswith("["), name).alias("state"))


def units(cells: DataFrame) -> DataFrame:
    """(session, basepath, uid, nth, fields, tags, bad, general): a row a unit.

    ``fields`` holds every field with a value for each unit, ``general`` the
    session's own, both as text; ``tags`` are the names of the unit's tags.
    """
    x = cells.withColumn("_f", _fields(F.col("data"))).withColumn("_uid", _numbers(F.col("_f")["UID"]))
    list_ = lambda t: F.from_json(t, "array<string>")
    own = F.map_filter("_f", lambda k, t: t.startswith("[") & (F.size(list_(t)) == F.size("_uid")))
    named = F.map_entries(F.coalesce(_fields(F.col("_f")["tags"]), F.create_map().cast("map<string,string>")))
    tags = F.transform(named, lambda e: F.struct(e["key"].alias("tag"), F.filter(F.coalesce(_numbers(e["value"]), F.array().cast("array<double>")), lambda u: u.isNotNull()).alias("uids")))
    general = F.map_filter(_fields(F.col("_f")["general"]), lambda k, t: ~t.startswith("[") & ~t.startswith("{"))
    parts = F.struct(F.col("_uid").alias("uid"), F.transform_values(own, lambda k, t: list_(t)).alias("own"), tags.alias("tags"))
    x = x.select("session", "basepath", F.xxhash64("data").alias("_file"), general.alias("general"), _once(parts).alias("_p"))
    # the units, and those that tags name, as rows of one table that meet by number
    none = F.lit(None)
    mine = F.transform("_p.uid", lambda u, i: F.struct(u.alias("uid"), i.alias("nth"), _nth(F.col("_p.own"), i).alias("fields"), none.cast("string").alias("_tag")))
    theirs = F.transform("_p.tags", lambda t: F.transform(t["uids"], lambda u: F.struct(u.alias("uid"), none.cast("int").alias("nth"), none.cast("map<string,string>").alias("fields"), t["tag"].alias("_tag"))))
    x = x.select("session", "basepath", "_file", "general", F.inline(F.concat(mine, F.flatten(theirs))))
    w = Window.partitionBy("session", "basepath", "_file", "uid")
    x = x.withColumn("tags", F.array_sort(F.collect_set("_tag").over(w))).where("nth is not null")
    x = x.select("session", "basepath", F.col("uid").cast("int").alias("uid"), "nth", "fields", "tags", "general")
    return x.withColumn("bad", F.array_contains("tags", "Bad"))


def unit_spikes(cells: DataFrame) -> DataFrame:
    """(session, nth, t) of all units' spike times."""
    text = _get("spikes.times")
    times = F.from_json(F.when(text.startswith("[["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), "array<array<double>>")
    return cells.select("session", F.posexplode(times).alias("nth", "_t")).select("session", "nth", F.explode("_t").alias("t"))


def metrics_by_epoch(metrics: DataFrame, size: str = "particip") -> DataFrame:
    """(session, epoch, nth, fields): unit metrics of each epoch that has them; fields without a value for each unit are left out."""
    e = metrics.select("session", F.explode(_fields(F.col("data"))).alias("epoch", "_e")).where(F.col("_e").startswith("{"))
    e = e.withColumn("_f", _fields(F.col("_e"))).withColumn("_n", F.size(F.from_json(F.col("_f")[size], "array<string>"))).where("_n > 0")
    list_ = lambda t: F.from_json(t, "array<string>")
    own = F.map_filter("_f", lambda k, t: t.startswith("[") & (F.size(list_(t)) == F.col("_n")))
    e = e.select("session", "epoch", "_n", _once(F.transform_values(own, lambda k, t: list_(t))).alias("_own"))
    return e.select("session", "epoch", F.inline(F.transform(_upto(F.col("_n")), lambda i: F.struct(i.alias("nth"), _nth(F.col("_own"), i).alias("fields")))))


def phase_shifts(shifts: DataFrame) -> DataFrame:
    """(session, uid, circ_dist, rem_shift, non_rem_shift, state, m, r, k, p, mode): phase locking of each unit in REM and awake."""
    stats = ("m", "r", "k", "p", "mode")
    one = ("circ_dist", "rem_shift", "non_rem_shift")
    out = None
    for state in ("rem", "wake"):
        cols = [_numbers(_get("UID")).alias("uid"), *[_numbers(_get(c)).alias(c) for c in one], *[_numbers(_get(f"PhaseLockingData_{state}.phasestats.{s}")).alias(s) for s in stats]]
        x = shifts.select("session", F.explode(F.arrays_zip(*cols)).alias("e"))
        x = x.select("session", F.col("e.uid").cast("int").alias("uid"), *[f"e.{c}" for c in one], F.lit(state).alias("state"), *[f"e.{s}" for s in stats])
        out = x if out is None else out.unionByName(x)
    return out


def phase_distributions(shifts: DataFrame) -> DataFrame:
    """(session, state, nth, distribution): each unit's histogram of phases; the file has a column for each unit."""
    out = None
    for state in ("rem", "wake"):
        m = F.from_json(_get(f"PhaseLockingData_{state}.phasedistros"), "array<array<double>>")
        n = shifts.select("session", _once(m).alias("_m"))
        each = F.transform(_upto(F.size(F.col("_m")[0])), lambda i: F.struct(i.alias("nth"), F.transform("_m", lambda r: r[i]).alias("distribution")))
        x = n.select("session", F.lit(state).alias("state"), F.inline(each))
        out = x if out is None else out.unionByName(x)
    return out


def emg(signals: DataFrame) -> DataFrame:
    """(session, t, value) of the muscle signal."""
    z = F.arrays_zip(_numbers(_get("timestamps")).alias("t"), _numbers(_get("data")).alias("value"))
    return signals.select("session", F.explode(z).alias("e")).select("session", "e.t", "e.value")


def emg_epochs(signal: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(session, state, start, stop): runs of samples above (high) and below (low) the threshold; a sample on it is in neither."""
    out = None
    for state, flag in (("high", F.col("value") > threshold), ("low", F.col("value") < threshold)):
        r = iv.runs(signal, flag, "t", ["session"]).select("session", F.lit(state).alias("state"), F.col("first").alias("start"), F.col("last").alias("stop"))
        out = r if out is None else out.unionByName(r)
    return out


def manipulations(mats: DataFrame) -> DataFrame:
    """(session, nth, start, stop, peak, center, duration, amplitude, label): the k-th label names the k-th smallest event number."""
    z = F.arrays_zip(
        _pairs(_get("timestamps")).alias("ts"), *[_numbers(_get(f)).alias(c) for f, c in (("peaks", "peak"), ("center", "center"), ("duration", "duration"), ("amplitude", "amplitude"), ("eventID", "id"))]
    )
    x = mats.select("session", _words(_get("eventIDlabels")).alias("_labels"), F.posexplode(z).alias("nth", "e"))
    k = F.dense_rank().over(Window.partitionBy("session").orderBy("e.id"))
    x = x.withColumn("_k", k).withColumn("label", F.try_element_at("_labels", F.col("_k")))
    return x.select("session", "nth", F.col("e.ts")[0].alias("start"), F.col("e.ts")[1].alias("stop"), "e.peak", "e.center", "e.duration", "e.amplitude", "label")


def manipulation_epochs(events: DataFrame, merge_gap: float | None = None) -> DataFrame:
    """(session, label, start, stop), those of one label merged over gaps on request."""
    cols = ["session", "label"]
    return events.select(*cols, "start", "stop") if merge_gap is None else iv.merge(events, cols, merge_gap)


def barrages(events: DataFrame, spikes: DataFrame, nrem: DataFrame | None = None, shortest: float = 0.0, around: float = 2.0, width: float = 60.0) -> DataFrame:
    """Events longer than ``shortest`` in which one of the given units fires, and that start in (widened) NREM if it is given."""
    e = events.where(F.col("stop") - F.col("start") > shortest)
    if nrem is not None:
        wide = nrem.select("session", (F.col("start") - around).alias("_lo"), (F.col("stop") + around).alias("_hi"))
        e = range_join(e.withColumn("_t", F.col("start")), wide, "_t", "_lo", "_hi", width, ["session"], how="left_semi").drop("_t")
    w = e.select("session", F.col("start").alias("_lo"), F.col("stop").alias("_hi"))
    hit = range_join(spikes.select("session", "t"), w, "t", "_lo", "_hi", width, ["session"]).select(F.col("session").alias("_s"), "_lo", "_hi").distinct()
    return e.join(hit, (F.col("session") == F.col("_s")) & (F.col("start") == F.col("_lo")) & (F.col("stop") == F.col("_hi")), "left_semi")


def animals(sessions: DataFrame) -> DataFrame:
    """(session, basepath, animal)"""
    return sessions.select("session", "basepath", _get("animal.name").alias("animal"))


def with_animal(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows with the ``animal_id`` of their ``basepath``; null where the session names none."""
    a = animals(sessions).select(F.col("basepath").alias("_b"), F.col("animal").alias("animal_id"))
    return rows.join(a, F.col("basepath") == F.col("_b"), "left").drop("_b")


def extracellular(sessions: DataFrame) -> DataFrame:
    """(session, fields) of the recording's own structure, as text; an empty map if there is none."""
    return sessions.select("session", F.coalesce(_fields(_get("extracellular")), F.create_map().cast("map<string,string>")).alias("fields"))


def basic_data(mats: DataFrame) -> dict[str, DataFrame]:
    """The tables that most work starts from: units, spikes, epochs and recordings of the sessions that the files (path, content) hold."""
    cells, sessions = structs(mats, "cell_metrics"), structs(mats, "session")
    return {"units": units(cells), "spikes": unit_spikes(cells), "epochs": session_epochs(sessions), "recordings": extracellular(sessions)}


def behaviour(mats: DataFrame) -> DataFrame:
    """(session, i, t, x, y, z, linearized, fields, speed, acceleration) of the tracking, a row a sample.

    ``fields`` holds whatever else has a value for each sample. Speed and
    acceleration are those of the file if it has them; else speed is the step
    of x and y over that of time, acceleration its backward difference.
    """
    n = F.size(_numbers(_get("timestamps")))
    list_ = lambda t: F.from_json(t, "array<double>")
    fits = lambda m: F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, t: t.startswith("[") & ~t.startswith("[[") & (F.size(list_(t)) == F.col("_n")))
    x = mats.select("session", "data", n.alias("_n"))
    own = F.map_filter(_fields(F.col("data")), lambda k, t: ~k.isin("position", "SpatialSeries", "timeSeries", "trials"))
    series = F.transform_keys(F.coalesce(_fields(_get("timeSeries")), F.create_map().cast("map<string,string>")), lambda k, t: F.concat(F.lit("timeSeries_"), k))
    x = x.withColumn("_f", F.map_concat(fits(_fields(_get("position"))), fits(own), fits(series)))
    x = x.select("session", "_n", _once(F.transform_values("_f", lambda k, t: list_(t))).alias("_f"))
    x = x.select("session", F.inline(F.transform(_upto(F.col("_n")), lambda i: F.struct(i.alias("i"), _nth(F.col("_f"), i).alias("_f")))))
    at = lambda k: F.try_element_at("_f", F.lit(k))
    named = ("timestamps", "x", "y", "z", "linearized", "speed", "acceleration")
    rest = F.map_filter("_f", lambda k, v: ~k.isin(*named))
    x = x.select("session", "i", at("timestamps").alias("t"), *[at(k).alias(k) for k in named[1:5]], rest.alias("fields"), at("speed").alias("_speed"), at("acceleration").alias("_acc"))
    x = sq.speed(x, ["x", "y"], "t", ["session"]).withColumn("speed", F.coalesce("_speed", "speed"))
    w = Window.partitionBy("session").orderBy("i")
    back = F.try_divide(F.col("speed") - F.lag("speed").over(w), F.col("t") - F.lag("t").over(w))
    return x.withColumn("acceleration", F.coalesce("_acc", back, F.when(F.col("i") == 0, F.lit(0.0)))).drop("_speed", "_acc", "v_x", "v_y")


def labelled(samples: DataFrame, spans: DataFrame, columns: Sequence[str], width: float = 600.0) -> DataFrame:
    """Samples (session, t) with columns of the last closed span (session, start, stop) that holds them: of trials, or of epochs."""
    e = spans.select("session", F.col("start").alias("_lo"), F.col("stop").alias("_hi"), F.struct(F.col("start").alias("_o"), *columns).alias("_s"))
    got = range_join(samples.select("session", "t").distinct(), e, "t", "_lo", "_hi", width, ["session"])
    got = got.groupBy(F.col("session").alias("_k"), F.col("t").alias("_t")).agg(F.max("_s").alias("_s"))
    x = samples.join(got, (F.col("session") == F.col("_k")) & (F.col("t") == F.col("_t")), "left")
    return x.select(*samples.columns, *[F.col(f"_s.{c}").alias(c) for c in columns])
