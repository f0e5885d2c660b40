"""Queries over intervals: merging, algebra, splitting, membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import intervals as iv
from .fixtures import DAY, EV, epochs, ev, sql_epochs

HOURS6 = 21600.0
_S = sql_epochs("signup", HOURS6, "a")
_P = sql_epochs("purchase", HOURS6, "b")


def _merged(name: str, src: str, gap: float = 0.0) -> str:
    """DuckDB: merged epochs of ``src`` by unit, as CTE ``name``."""
    return f"""{name}_1 AS (SELECT unit, start, stop, max(stop) OVER (PARTITION BY unit ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
{name}_2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start - reach > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY unit ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM {name}_1),
{name} AS (SELECT unit, min(start) AS start, max(stop) AS stop FROM {name}_2 GROUP BY unit, g)"""


@query(f"WITH {EV}, {_S}, {_merged('m', 'a', 3600.0)} SELECT * FROM m")
def epoch_merge_gap(spark, sf):
    return iv.merge(epochs(spark, sf, "signup", HOURS6, "unit"), ["unit"], 3600.0)


@query(f"WITH {EV}, {_S}, {_P} SELECT a.unit, greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop FROM a JOIN b ON a.unit = b.unit AND a.start < b.stop AND b.start < a.stop")
def epoch_intersection(spark, sf):
    return iv.intersect(epochs(spark, sf, "signup", HOURS6, "unit"), epochs(spark, sf, "purchase", HOURS6, "unit"), HOURS6, ["unit"])


@query(f"WITH {EV}, {_S}, {_P}, c AS (SELECT unit, start, stop FROM a UNION ALL SELECT unit, start, stop FROM b), {_merged('m', 'c')} SELECT * FROM m")
def epoch_union(spark, sf):
    return iv.union(epochs(spark, sf, "signup", HOURS6, "unit"), epochs(spark, sf, "purchase", HOURS6, "unit"), ["unit"])


@query(
    f"""WITH {EV}, {_S}, {_merged('m', 'a')}, c AS (SELECT unit, start, stop, coalesce(lag(stop) OVER (PARTITION BY unit ORDER BY start), 0.0::DOUBLE) AS before, lead(start) OVER (PARTITION BY unit ORDER BY start) IS NULL AS last
FROM (SELECT unit, start, least(stop, {30 * DAY}) AS stop FROM m))
SELECT unit, before AS start, start AS stop FROM c WHERE before < start UNION ALL SELECT unit, stop, {30 * DAY}::DOUBLE FROM c WHERE last AND stop < {30 * DAY}"""
)
def epoch_complement(spark, sf):
    e = epochs(spark, sf, "signup", HOURS6, "unit")
    domain = e.select("unit").distinct().select("unit", F.lit(0.0).alias("start"), F.lit(30 * DAY).alias("stop"))
    return iv.complement(e, domain, ["unit"])


@query(f"WITH {EV}, {_S} SELECT unit, epoch_id, start - 60.0 AS start, stop + 120.0 AS stop FROM a")
def epoch_expand(spark, sf):
    return iv.expand(epochs(spark, sf, "signup", HOURS6, "unit"), 60.0, 120.0)


@query(f"WITH {EV}, {_S} SELECT epoch_id, i::INTEGER AS bin, start + i * 4000.0 AS start, least(stop, start + (i + 1) * 4000.0) AS stop FROM a, range(6) r(i) WHERE i * 4000.0 < stop - start")
def split_by_width(spark, sf):
    return iv.split_by_width(epochs(spark, sf, "signup", HOURS6), 4000.0)


@query(f"WITH {EV}, {_S} SELECT epoch_id, i::INTEGER AS part, start + i * ((stop - start) / 7) AS start, start + (i + 1) * ((stop - start) / 7) AS stop FROM a, range(7) r(i)")
def split_equal_parts(spark, sf):
    return iv.split_equal_parts(epochs(spark, sf, "signup", HOURS6), 7)


@query(f"WITH {EV}, {_S}, {_P} SELECT a.unit, a.epoch_id, a.start, a.stop, arg_min(b.epoch_id, b.start) AS first_other FROM a JOIN b ON a.unit = b.unit AND a.start < b.stop AND b.start < a.stop GROUP BY ALL")
def overlap_semi(spark, sf):
    other = epochs(spark, sf, "purchase", HOURS6, "unit").withColumnRenamed("epoch_id", "other_id")
    return iv.overlapping(epochs(spark, sf, "signup", HOURS6, "unit"), other, HOURS6, ["unit"])


@query(
    f"""WITH {EV}, {_S}, b AS (SELECT unit, event_id AS other_id, t AS start, t + 90000.0 AS stop FROM ev WHERE kind = 'view'),
h AS (SELECT a.epoch_id, arg_min(struct_pack(o := greatest(0.0, least(a.stop, b.stop) - greatest(a.start, b.start)), w := b.start <= a.start AND a.stop <= b.stop), b.start) AS f FROM a JOIN b ON a.unit = b.unit AND a.start <= b.stop AND b.start <= a.stop GROUP BY a.epoch_id)
SELECT a.unit, a.epoch_id, a.start, a.stop, coalesce(f.o, 0.0)::DOUBLE AS overlap, coalesce(f.w, false) AS inside FROM a LEFT JOIN h USING (epoch_id)"""
)
def overlap_strict(spark, sf):
    other = epochs(spark, sf, "view", 90000.0, "unit").withColumnRenamed("epoch_id", "other_id")
    return iv.overlap_length(epochs(spark, sf, "signup", HOURS6, "unit"), other, 90000.0, ["unit"])


@query(f"WITH {EV}, {_S} SELECT e.event_id, e.unit, e.t, max(a.epoch_id) AS interval FROM ev e LEFT JOIN a ON a.unit = e.unit AND e.t BETWEEN a.start AND a.stop GROUP BY e.event_id, e.unit, e.t")
def in_intervals(spark, sf):
    return iv.membership(ev(spark, sf).select("event_id", "unit", "t"), epochs(spark, sf, "signup", HOURS6, "unit"), "t", HOURS6, ["unit"])


@query(f"WITH {EV}, {_S} SELECT event_id, unit, kind, t FROM ev e WHERE EXISTS (SELECT 1 FROM a WHERE a.unit = e.unit AND e.t > a.start AND e.t < a.stop)")
def restrict_to_epochs(spark, sf):
    return iv.restrict(ev(spark, sf).select("event_id", "unit", "kind", "t"), epochs(spark, sf, "signup", HOURS6, "unit"), "t", HOURS6, ["unit"], "open")


@query(
    f"""WITH {EV}, {_S}, {_merged('m', 'a')}, o AS (SELECT *, coalesce(sum(stop - start) OVER (PARTITION BY unit ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before FROM m)
SELECT e.event_id, e.unit, e.t, round(e.t - o.start + o.before, 6) AS shifted FROM ev e JOIN o ON o.unit = e.unit AND e.t >= o.start AND e.t < o.stop"""
)
def in_intervals_shift(spark, sf):
    m = iv.merge(epochs(spark, sf, "signup", HOURS6, "unit"), ["unit"])
    return iv.shifted(ev(spark, sf).select("event_id", "unit", "t"), m, "t", HOURS6, ["unit"]).withColumn("shifted", F.round("shifted", 6))


@query(
    f"""WITH {EV}, {_S}, {_merged('m', 'a')}, o AS (SELECT *, coalesce(sum(stop - start) OVER (PARTITION BY unit ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before FROM m)
SELECT unit, start, least(stop, start + (50000.0 - before)) AS stop FROM o WHERE before < 50000.0"""
)
def truncate_epoch(spark, sf):
    return iv.truncate(iv.merge(epochs(spark, sf, "signup", HOURS6, "unit"), ["unit"]), 50000.0, ["unit"])


@query(
    f"""WITH {EV}, {_S}, {_P}, {_merged('m', 'a')}, o AS (SELECT *, coalesce(sum(stop - start) OVER (PARTITION BY unit ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before FROM m)
SELECT b.unit, round(greatest(b.start, o.start) - o.start + before, 6) AS start, round(least(b.stop, o.stop) - o.start + before, 6) AS stop FROM b JOIN o ON b.unit = o.unit AND b.start < o.stop AND o.start < b.stop"""
)
def shift_epoch(spark, sf):
    m = iv.merge(epochs(spark, sf, "signup", HOURS6, "unit"), ["unit"])
    got = iv.shift_epochs(epochs(spark, sf, "purchase", HOURS6, "unit"), m, HOURS6, ["unit"])
    return got.select("unit", F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"))


@query(
    f"""WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY t) AS i FROM ev), o AS (SELECT *, i - row_number() OVER (PARTITION BY unit ORDER BY t) AS g FROM n WHERE value > 40)
SELECT unit, min(t) AS first, max(t) AS last, count(*) AS n FROM o GROUP BY unit, g"""
)
def find_interval(spark, sf):
    return iv.runs(ev(spark, sf), F.col("value") > 40, "t", ["unit"])


@query(
    f"""WITH {EV} SELECT event_id, unit, coalesce(last_value(CASE WHEN value > 80 THEN true WHEN value < 20 THEN false END IGNORE NULLS) OVER (PARTITION BY unit ORDER BY t ROWS UNBOUNDED PRECEDING), false) AS state FROM ev"""
)
def hysteresis_state(spark, sf):
    return iv.hysteresis(ev(spark, sf), "value", 80.0, 20.0, "t", ["unit"]).select("event_id", "unit", "state")


@query(
    f"""WITH {EV}, {_S}, h AS (SELECT e.event_id, e.unit, e.t, a.epoch_id, a.start, a.stop FROM ev e LEFT JOIN a ON a.unit = e.unit AND e.t BETWEEN a.start AND a.stop),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY (CASE WHEN start < t THEN 1 ELSE 0 END) DESC, start DESC) AS rn FROM h)
SELECT event_id, unit, t, epoch_id AS interval, round((t - start) / (stop - start), 9) AS rel FROM k WHERE rn = 1"""
)
def relative_times(spark, sf):
    got = iv.relative_times(ev(spark, sf).select("event_id", "unit", "t"), epochs(spark, sf, "signup", HOURS6, "unit"), "t", HOURS6, ["unit"])
    return got.withColumn("rel", F.round("rel", 9))
