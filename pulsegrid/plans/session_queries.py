"""Queries over sequences of epochs, motion, and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import sequences as sq, tuning as tu
from .fixtures import EV, POS, ev, position, table


def _orders(spark, sf):
    o = table(spark, sf, "orders")
    day = F.expr("datediff(to_date(o_orderdate), DATE'1970-01-01')").cast("double")
    return o.select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("epoch_id"), F.col("o_orderstatus").alias("env"), F.col("o_orderpriority").alias("paradigm"), day.alias("start"), (day + 1).alias("stop"))


O = "o AS (SELECT o_custkey AS session, o_orderkey AS epoch_id, o_orderstatus AS env, o_orderpriority AS paradigm, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS start, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE + 1 AS stop FROM orders)"


@query(
    f"""WITH {O}, n AS (SELECT *, CASE WHEN env = lag(env) OVER w THEN 0 ELSE 1 END AS n FROM o WINDOW w AS (PARTITION BY session ORDER BY epoch_id)), g AS (SELECT *, sum(n) OVER (PARTITION BY session ORDER BY epoch_id ROWS UNBOUNDED PRECEDING) AS g FROM n)
SELECT session, min(epoch_id) AS epoch_id, any_value(env) AS env, min(start) AS start, max(stop) AS stop, count(*) AS n, arg_min(paradigm, epoch_id) AS paradigm FROM g GROUP BY session, g"""
)
def compress_epochs(spark, sf):
    return sq.compress(_orders(spark, sf), "env", first=["paradigm"])


@query(
    f"""WITH {O}, l AS (SELECT session, epoch_id, env, lead(env) OVER w AS a, lead(env, 2) OVER w AS b, lead(epoch_id) OVER w AS t, lead(epoch_id, 2) OVER w AS p FROM o WINDOW w AS (PARTITION BY session ORDER BY epoch_id)), h AS (SELECT * FROM l WHERE env = 'O' AND a <> 'O' AND b = 'O')
SELECT session, min(epoch_id) AS pre, arg_min(t, epoch_id) AS task, arg_min(p, epoch_id) AS post FROM h GROUP BY session"""
)
def pre_task_post(spark, sf):
    return sq.pre_task_post(_orders(spark, sf), F.col("env") == "O")


@query(
    f"""WITH {O}, l AS (SELECT session, epoch_id, env, last_value(CASE WHEN env = 'O' THEN epoch_id END IGNORE NULLS) OVER (PARTITION BY session ORDER BY epoch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pre,
first_value(CASE WHEN env = 'O' THEN epoch_id END IGNORE NULLS) OVER (PARTITION BY session ORDER BY epoch_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS post, row_number() OVER (PARTITION BY session ORDER BY epoch_id) AS i FROM o)
SELECT session, pre, epoch_id AS task, post FROM l WHERE env <> 'O' AND i > 1 AND pre IS NOT NULL AND post IS NOT NULL"""
)
def multitask_pre_post(spark, sf):
    return sq.multitask_pre_post(_orders(spark, sf), F.col("env") == "O", F.col("env") != "O")


@query(
    f"""WITH {O}, l AS (SELECT session, epoch_id, env, lead(env) OVER w AS a, lead(env, 2) OVER w AS b FROM o WINDOW w AS (PARTITION BY session ORDER BY epoch_id)) SELECT session, min(epoch_id) AS first FROM l WHERE env = 'O' AND a = 'F' AND b = 'P' GROUP BY session"""
)
def find_epoch_pattern(spark, sf):
    return sq.pattern(_orders(spark, sf), "env", ["O", "F", "P"])


@query(
    f"""WITH {O}, m AS (SELECT *, CASE WHEN env = 'O' OR regexp_matches(paradigm, 'URGENT|HIGH') THEN 1 ELSE 0 END AS m FROM o), t AS (SELECT *, sum(m) OVER (PARTITION BY session ORDER BY epoch_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM m), h AS (SELECT *, max(s) OVER (PARTITION BY session ORDER BY epoch_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS h FROM t)
SELECT session, epoch_id, env, paradigm FROM h WHERE h = 3"""
)
def find_env_paradigm(spark, sf):
    got = sq.rolling_triples(_orders(spark, sf), (F.col("env") == "O") | F.col("paradigm").rlike("URGENT|HIGH"))
    return got.select("session", "epoch_id", "env", "paradigm")


@query(
    f"""WITH {O}, l AS (SELECT session, epoch_id, env, paradigm, lag(env) OVER w AS a, lead(env) OVER w AS b, lag(epoch_id) OVER w AS pre, lead(epoch_id) OVER w AS post FROM o WINDOW w AS (PARTITION BY session ORDER BY epoch_id)),
h AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY CASE WHEN paradigm LIKE '1%' THEN 0 ELSE 1 END, epoch_id) AS rn FROM l WHERE a = 'O' AND env <> 'O' AND b = 'O') SELECT session, pre, epoch_id AS task, post FROM h WHERE rn = 1"""
)
def pre_task_post_novel(spark, sf):
    return sq.triple_around_novel(_orders(spark, sf), F.col("env") == "O", F.col("paradigm").startswith("1"))


@query("SELECT DISTINCT o_orderpriority AS paradigm, TRY_CAST(nullif(regexp_extract(o_orderpriority, '([0-9]+)', 1), '') AS INTEGER) AS level FROM orders")
def experience_level(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("paradigm"), sq.experience_level(F.col("o_orderpriority")).alias("level")).distinct()


def _grad(v: str) -> str:
    return f"CASE WHEN lag({v}) OVER w IS NULL THEN (lead({v}) OVER w - {v}) / (lead(t) OVER w - t) WHEN lead({v}) OVER w IS NULL THEN ({v} - lag({v}) OVER w) / (t - lag(t) OVER w) ELSE (pow(t - lag(t) OVER w, 2) * lead({v}) OVER w + (pow(lead(t) OVER w - t, 2) - pow(t - lag(t) OVER w, 2)) * {v} - pow(lead(t) OVER w - t, 2) * lag({v}) OVER w) / ((t - lag(t) OVER w) * (lead(t) OVER w - t) * (lead(t) OVER w - lag(t) OVER w)) END"


@query(f"WITH {POS}, p AS (SELECT session, i::DOUBLE AS t, x, y FROM pos), v AS (SELECT session, t, {_grad('x')} AS vx, {_grad('y')} AS vy FROM p WINDOW w AS (PARTITION BY session ORDER BY t)) SELECT session, t, round(sqrt(vx * vx + vy * vy), 8) AS speed FROM v")
def velocity_speed(spark, sf):
    p = position(spark, sf).withColumn("t", F.col("i").cast("double"))
    return sq.speed(p, ["x", "y"]).select("session", "t", F.round("speed", 8).alias("speed"))


@query(
    f"""WITH {POS}, p AS (SELECT session, i::DOUBLE AS t, x, y FROM pos), v AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) / (t - lag(t) OVER w) AS v FROM p WINDOW w AS (PARTITION BY session ORDER BY t)), b AS (SELECT *, coalesce(v > 20 AND NOT coalesce(lag(v) OVER (PARTITION BY session ORDER BY t) > 20, false), false) AS bad FROM v)
SELECT session, t, CASE WHEN NOT bad THEN x END AS x, CASE WHEN NOT bad THEN y END AS y FROM b"""
)
def tracker_jumps(spark, sf):
    p = position(spark, sf).withColumn("t", F.col("i").cast("double"))
    return sq.drop_jumps(p, 20.0).select("session", "t", "x", "y")


@query(
    f"""WITH {POS}, m AS (SELECT session, avg(x) AS mx, avg(y) AS my, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS a FROM pos GROUP BY session), l AS (SELECT session, i, (x - mx) * cos(a) + (y - my) * sin(a) AS l FROM pos JOIN m USING (session))
SELECT session, i, round(l - min(l) OVER (PARTITION BY session), 6) AS lin FROM l"""
)
def linearize_position(spark, sf):
    return sq.linearize_pca(position(spark, sf)).select("session", "i", F.round("lin", 6).alias("lin"))


@query(
    f"""WITH {POS}, m AS (SELECT session, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy FROM pos GROUP BY session), t AS (SELECT session, i, atan2(y - cy, x - cx) AS a, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS d FROM pos JOIN m USING (session)), r AS (SELECT session, avg(d) AS r FROM t GROUP BY session)
SELECT session, i, round(CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END * r, 6) AS lin FROM t JOIN r USING (session)"""
)
def linearize_circle(spark, sf):
    return sq.linearize_circle(position(spark, sf)).select("session", "i", F.round("lin", 6).alias("lin"))


_IN = f"{POS}, n AS (SELECT session, i, (sqrt(pow(x - 25, 2) + pow(y - 5, 2)) < 8)::INTEGER AS f FROM pos), st AS (SELECT session, i, f - coalesce(lag(f) OVER (PARTITION BY session ORDER BY i), f) AS step FROM n)"


@query(f"WITH {_IN} SELECT session, i, step FROM st")
def enter_exit_target(spark, sf):
    return sq.enter_exit(position(spark, sf), F.hypot(F.col("x") - 25, F.col("y") - 5) < 8, "i").select("session", "i", "step")


@query(f"WITH {_IN}, nx AS (SELECT *, coalesce(lead(step) OVER (PARTITION BY session ORDER BY i), 0) AS nx FROM st) SELECT session, i, CASE WHEN nx = 1 THEN 1 WHEN step = 1 THEN 0 ELSE step END::INTEGER AS step FROM nx")
def shift_well_enters(spark, sf):
    x = sq.enter_exit(position(spark, sf), F.hypot(F.col("x") - 25, F.col("y") - 5) < 8, "i")
    return sq.shift_enters(x, "i").select("session", "i", "step")


WELLS = [(1, 10.0, 5.0), (2, 25.0, 2.0), (3, 40.0, 8.0)]
_SEG = f"""{POS}, w AS (SELECT session, i, x, y, CASE WHEN sqrt(pow(x - 10, 2) + pow(y - 5, 2)) < 5 THEN 1 WHEN sqrt(pow(x - 25, 2) + pow(y - 2, 2)) < 5 THEN 2 WHEN sqrt(pow(x - 40, 2) + pow(y - 8, 2)) < 5 THEN 3 END AS well FROM pos),
f AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER k, 2) + pow(y - lag(y) OVER k, 2)), 0) AS d, last_value(well IGNORE NULLS) OVER (PARTITION BY session ORDER BY i ROWS UNBOUNDED PRECEDING) AS fw, first_value(well IGNORE NULLS) OVER (PARTITION BY session ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tw, row_number() OVER k AS rn FROM w WINDOW k AS (PARTITION BY session ORDER BY i)),
g AS (SELECT *, rn - row_number() OVER (PARTITION BY session ORDER BY i) AS g FROM f WHERE well IS NULL), seg AS (SELECT session, min(i) AS start, max(i) AS stop, round(sum(d), 6) AS distance, any_value(fw) AS from_well, any_value(tw) AS to_well, max(i) - min(i) AS duration FROM g GROUP BY session, g)"""


@query(f"WITH {_SEG} SELECT * FROM seg")
def segment_path(spark, sf):
    return sq.segment_path(position(spark, sf), WELLS, 5.0, "i").withColumn("distance", F.round("distance", 6))


@query(
    f"""WITH {_SEG}, s AS (SELECT * FROM seg WHERE distance > 20 AND from_well IS NOT NULL AND to_well IS NOT NULL), l AS (SELECT *, last_value(CASE WHEN to_well <> 2 THEN to_well END IGNORE NULLS) OVER (PARTITION BY session ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_outer FROM s)
SELECT session, start, from_well, to_well, CASE WHEN from_well = 2 THEN 'Outbound' ELSE 'Inbound' END AS task, CASE WHEN from_well <> 2 THEN to_well = 2 ELSE to_well <> 2 AND coalesce(to_well <> last_outer, true) END AS is_correct FROM l"""
)
def score_inbound_outbound(spark, sf):
    s = sq.segment_path(position(spark, sf), WELLS, 5.0, "i").withColumn("distance", F.round("distance", 6))
    return sq.score_alternation(s, 2, 20.0).select("session", "start", "from_well", "to_well", "task", "is_correct")


@query(f"WITH {POS}, f AS (SELECT session, i, (z > 40000)::INTEGER AS f FROM pos), c AS (SELECT session, i, f - coalesce(lag(f) OVER (PARTITION BY session ORDER BY i), 0) AS crossing FROM f) SELECT session, i, crossing FROM c WHERE crossing <> 0")
def compute_crossings(spark, sf):
    x = position(spark, sf).withColumn("f", (F.col("z") > 40000).cast("int"))
    return tu.crossings(x, "f", "i", ["session"]).select("session", "i", "crossing")


@query(f"WITH {EV}, n AS (SELECT event_id, unit, t, CASE WHEN t - lag(t) OVER w > 43200 THEN 1 ELSE 0 END AS n FROM ev WINDOW w AS (PARTITION BY unit ORDER BY t)) SELECT event_id, unit, sum(n) OVER (PARTITION BY unit ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS piece FROM n")
def consecutive_pieces(spark, sf):
    return tu.consecutive(ev(spark, sf).select("event_id", "unit", "t"), "t", 43200.0, ["unit"]).select("event_id", "unit", "piece")


_TRACK = [(0, 0.0, 0.0, 20.0, 0.0, 0.0), (1, 20.0, 0.0, 50.0, 10.0, 20.0), (2, 20.0, 0.0, 0.0, 10.0, 51.622776601683793)]


@query(
    f"""WITH {POS}, s AS (SELECT * FROM (VALUES {', '.join(f'({a}, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, {e}::DOUBLE, {f}::DOUBLE)' for a, b, c, d, e, f in _TRACK)}) v(segment, x0, y0, x1, y1, before)),
p AS (SELECT session, i, segment, before, x, y, x0, y0, x1, y1, greatest(0.0, least(1.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)))) AS s FROM pos, s),
d AS (SELECT *, sqrt(pow(x - x0 - s * (x1 - x0), 2) + pow(y - y0 - s * (y1 - y0), 2)) AS d FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY session, i ORDER BY d, segment) AS rn FROM d)
SELECT session, i, round(before + s * sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)), 6) AS lin FROM r WHERE rn = 1""",
)
def project_to_track(spark, sf):
    seg = spark.createDataFrame(_TRACK, "segment int, x0 double, y0 double, x1 double, y1 double, before double")
    return sq.project_to_track(position(spark, sf), seg).select("session", "i", F.round("lin", 6).alias("lin"))


@query(
    """WITH u AS (SELECT s_suppkey AS unit, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE regexp_matches(n_name, 'A') AND (regexp_matches(r_name, 'ASIA') OR regexp_matches(r_name, 'EUROPE')))
SELECT unit, n_name, r_name, count(*) AS n FROM lineitem JOIN u ON l_suppkey = unit GROUP BY ALL"""
)
def load_spikes_filters(spark, sf):
    from ..sources.metadata import select_units

    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    units = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    units = select_units(units.select(F.col("s_suppkey").alias("unit"), "n_name", "r_name"), {"n_name": ["A"], "r_name": ["ASIA", "EUROPE"]})
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("unit")).join(units, "unit").groupBy("unit", "n_name", "r_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {EV}, e AS (SELECT event_id, t AS start, t + value AS stop, t + value / 2 AS peak FROM ev WHERE kind = 'signup'), d AS (SELECT avg(stop - start) AS d FROM e), a AS (SELECT t FROM ev WHERE kind = 'error')
SELECT round(start, 3) AS start, round(stop, 3) AS stop, round(peak, 3) AS peak FROM e UNION ALL SELECT round(t - d / 2, 3), round(t + d / 2, 3), round(t, 3) FROM a, d""",
)
def manual_events(spark, sf):
    from ..sources.metadata import add_manual_events

    e = ev(spark, sf)
    events = e.where("kind = 'signup'").select(F.col("t").alias("start"), (F.col("t") + F.col("value")).alias("stop"), (F.col("t") + F.col("value") / 2).alias("peak"))
    got = add_manual_events(events, e.where("kind = 'error'").select(F.col("t").alias("peak")))
    return got.select(*[F.round(c, 3).alias(c) for c in ("start", "stop", "peak")])


@query("SELECT url, replace(replace(url, '/', '___'), ':', '---') AS encoded FROM pages")
def encode_file_path(spark, sf):
    from ..sources.batch import decode_path, encode_path

    p = table(spark, sf, "pages").select("url", encode_path(F.col("url")).alias("encoded"))
    return p.where(decode_path(F.col("encoded")) == F.col("url"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_metadata(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
