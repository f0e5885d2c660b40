"""Range, overlap and as-of joins as equi-joins on time buckets.

A plain range condition plans a nested-loop join. Here the side of the
intervals is replicated to every bucket it touches, the points lie in one
bucket each, and the exact condition filters what meets, so each match comes
out once and the join shuffles (or broadcasts) like any equi-join. As-of
look-ups run inside buckets too; what crosses a bucket's border is one row for
each bucket, so no window ever spans the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: comparison of the lower and the upper end, by the kind of interval
ENDS = {
    "closed": (lambda t, a: t >= a, lambda t, b: t <= b),
    "open": (lambda t, a: t > a, lambda t, b: t < b),
    "left": (lambda t, a: t >= a, lambda t, b: t < b),
    "right": (lambda t, a: t > a, lambda t, b: t <= b),
}


def bucket(c: Column | str, width: float) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / F.lit(float(width))).cast("long")


def within(t: Column, lo: Column, hi: Column, ends: str = "closed") -> Column:
    """Membership of t in [lo, hi], with the ends as named in ENDS."""
    a, b = ENDS[ends]
    return a(t, lo) & b(t, hi)


def range_join(points: DataFrame, windows: DataFrame, t: str, lo: str, hi: str, width: float, keys: Sequence[str] = (), ends: str = "closed", how: str = "inner", in_order: bool = False) -> DataFrame:
    """Points matched with the windows that hold them; ``how`` may also be left, left_semi or left_anti (of points).

    ``keys`` are columns of both sides that must agree. Apart from them the
    sides' column names must differ. ``width`` is the bucket: about the usual
    length of a window. ``in_order``: a bucket's matches come out by the times
    of the points, then of the windows, so that columns written from them are
    runs of equal values; for results of many rows a point.
    """
    p = points.withColumn("_bucket", bucket(t, width))
    names = {k: f"_w_{k}" for k in keys}
    w = windows.withColumnsRenamed(names).withColumn("_wb", F.explode(F.sequence(bucket(lo, width), bucket(hi, width))))
    if in_order:  # a sort below a join is planned away, the one that a number needs is not
        nth = lambda by, c: F.row_number().over(Window.partitionBy(*by).orderBy(c))
        p = p.withColumn("_n", nth([*keys, "_bucket"], t)).where("_n > 0").drop("_n")
        w = w.withColumn("_n", nth([*names.values(), "_wb"], lo)).where("_n > 0").drop("_n")
    cond = (F.col("_bucket") == F.col("_wb")) & within(F.col(t), F.col(lo), F.col(hi), ends)
    for k in keys:
        cond &= F.col(k) == F.col(names[k])
    return p.join(w.where(F.col(lo) <= F.col(hi)), cond, how).drop("_bucket", "_wb", *names.values())


def overlap_join(a: DataFrame, b: DataFrame, width: float, keys: Sequence[str] = (), touching: bool = False, how: str = "inner") -> DataFrame:
    """Pairs of intervals (start, stop) x (start2, stop2) that overlap; each pair once.

    A pair is taken in the bucket where the later of the two starts lies.
    """
    names = {k: f"_b_{k}" for k in keys}
    x = a.withColumn("_xb", F.explode(F.sequence(bucket("start", width), bucket("stop", width))))
    y = b.withColumnsRenamed(names).withColumn("_yb", F.explode(F.sequence(bucket("start2", width), bucket("stop2", width))))
    s, e, s2, e2 = (F.col(c) for c in ("start", "stop", "start2", "stop2"))
    meet = (s <= e2) & (s2 <= e) if touching else (s < e2) & (s2 < e)
    cond = (F.col("_xb") == F.col("_yb")) & (F.col("_xb") == bucket(F.greatest(s, s2), width)) & meet
    for k in keys:
        cond &= F.col(k) == F.col(names[k])
    if how != "left_semi":
        return x.join(y, cond, how).drop("_xb", "_yb", *names.values())
    # the intervals that meet any, each once; equal rows of the table all stay
    hit = x.join(y, cond, how).select(*[F.col(c).alias(f"_h_{c}") for c in (*keys, "start", "stop")]).distinct()
    same = F.lit(True)
    for c in (*keys, "start", "stop"):
        same &= F.col(c) == F.col(f"_h_{c}")
    return a.join(hit, same, "left_semi")


def asof_join(left: DataFrame, right: DataFrame, t: str, values: Sequence[str], keys: Sequence[str] = (), width: float = 3600.0, direction: str = "backward", strict: bool = False, prefix: str = "") -> DataFrame:
    """Left rows with ``t`` and ``values`` of the right row in force: the latest at or before, or the first at or after.

    Adds ``{prefix}{t}_asof`` and ``{prefix}{value}``; null where there is
    none. ``strict`` leaves out rows of equal time. Ties among right rows go to
    the greatest values.
    """
    back = direction == "backward"
    value = F.struct(*[F.col(v) for v in values])
    r = right.where(F.col(t).isNotNull()).select(*keys, F.col(t).alias("_t"), value.alias("_v"))
    # one row a bucket, and by a window over those the one that reaches each bucket from outside
    l_b = left.select(*keys, bucket(t, width).alias("_b")).distinct().withColumn("_e", F.lit(None).cast(r.select(F.struct("_t", "_v").alias("e")).schema["e"].dataType))
    r_b = r.groupBy(*keys, bucket("_t", width).alias("_b")).agg((F.max if back else F.min)(F.struct("_t", "_v")).alias("_e"))
    both = l_b.withColumn("_is", F.lit(1)).unionByName(r_b.withColumn("_is", F.lit(0)))
    both = both.groupBy(*keys, "_b").agg(F.first("_e", ignorenulls=True).alias("_e"), F.max("_is").alias("_is"))
    order = F.col("_b").asc() if back else F.col("_b").desc()
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = both.withColumn("_carry", F.last("_e", ignorenulls=True).over(w)).where("_is = 1").select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_b").alias("_cb"), "_carry")
    # inside a bucket: union and window
    kinds = left.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in left.columns])).select(*keys, F.col(t).alias("_at"), "_row", F.lit(None).cast(r_b.schema["_e"].dataType).alias("_e"), F.lit(1 if not strict else 0).alias("_o"))
    facts = r.select(*keys, F.col("_t").alias("_at"), F.lit(None).cast(kinds.schema["_row"].dataType).alias("_row"), F.struct("_t", "_v").alias("_e"), F.lit(0 if not strict else 1).alias("_o"))
    u = kinds.unionByName(facts).withColumn("_b", bucket("_at", width))
    if back:
        w2 = Window.partitionBy(*keys, "_b").orderBy(F.col("_at").asc(), F.col("_o").asc(), F.col("_e").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    else:
        w2 = Window.partitionBy(*keys, "_b").orderBy(F.col("_at").desc(), F.col("_o").asc(), F.col("_e").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_near", F.last("_e", ignorenulls=True).over(w2)).where(F.col("_row").isNotNull())
    cond = F.col("_b") == F.col("_cb")
    for k in keys:
        cond &= F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    got = u.join(carried, cond, "left").withColumn("_hit", F.coalesce("_near", "_carry"))
    return got.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in left.columns],
        F.col("_hit._t").alias(f"{prefix}{t}_asof"),
        *[F.col("_hit._v").getField(v).alias(f"{prefix}{v}") for v in values],
    )


def neighbours(left: DataFrame, right: DataFrame, t: str, values: Sequence[str], keys: Sequence[str] = (), width: float = 3600.0) -> DataFrame:
    """Left rows with ``_before`` and ``_after``: the right rows next to them on either side, as structs ``_t`` and ``_v``.

    Both sides come from one union in one partitioning; a row of equal time is
    on either side. Ties among right rows go to the greatest values.
    """
    fact = F.struct("_t", "_v")
    r = right.where(F.col(t).isNotNull()).select(*keys, F.col(t).alias("_t"), F.struct(*[F.col(v) for v in values]).alias("_v"))
    kind = r.select(fact.alias("e")).schema["e"].dataType
    none = F.lit(None).cast(kind)
    # what reaches a bucket from those before and behind it: a row a bucket
    ends = r.groupBy(*keys, bucket("_t", width).alias("_b")).agg(F.max(fact).alias("_last"), F.max_by(fact, F.struct(-F.col("_t"), "_v")).alias("_first"), F.lit(0).alias("_is"))
    mine = left.select(*keys, bucket(t, width).alias("_b")).distinct().select(*keys, "_b", none.alias("_last"), none.alias("_first"), F.lit(1).alias("_is"))
    both = ends.unionByName(mine).groupBy(*keys, "_b").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("_last", "_first")], F.max("_is").alias("_is"))
    w = Window.partitionBy(*keys).orderBy("_b")
    both = both.withColumn("_from", F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    back = Window.partitionBy(*keys).orderBy(F.desc("_b"))  # a frame that only grows, from the end
    both = both.withColumn("_to", F.last("_first", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    carried = both.where("_is = 1").select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_b").alias("_cb"), "_from", "_to")
    rows = left.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in left.columns])).select(*keys, F.col(t).alias("_at"), "_row", none.alias("_e"), F.lit(1).alias("_o"))
    facts = r.select(*keys, F.col("_t").alias("_at"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), fact.alias("_e"), F.lit(0).alias("_o"))
    u = rows.unionByName(facts).withColumn("_b", bucket("_at", width))
    w = Window.partitionBy(*keys, "_b")
    near = lambda at: F.last("_e", ignorenulls=True).over(w.orderBy(at, F.col("_o").asc(), F.col("_e").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    u = u.withColumn("_back", near(F.col("_at").asc())).withColumn("_on", near(F.col("_at").desc())).where(F.col("_row").isNotNull())
    cond = F.col("_b") == F.col("_cb")
    for k in keys:
        cond &= F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    got = u.join(carried, cond, "left")
    return got.select(*[F.col(f"_row.`{c}`").alias(c) for c in left.columns], F.coalesce("_back", "_from").alias("_before"), F.coalesce("_on", "_to").alias("_after"))


def nearest_join(left: DataFrame, right: DataFrame, t: str, values: Sequence[str] = (), keys: Sequence[str] = (), width: float = 3600.0) -> DataFrame:
    """Left rows with the nearest right row as ``nearest`` and its ``values``; of two at one distance the later."""
    got = neighbours(left, right, t, list(values) or [t], keys, width)
    before, after = F.col("_before._t"), F.col("_after._t")
    later = before.isNull() | (after.isNotNull() & ((after - F.col(t)) <= (F.col(t) - before)))
    got = got.withColumn("_near", F.when(later, F.col("_after")).otherwise(F.col("_before")))
    return got.select(*left.columns, F.col("_near._t").alias("nearest"), *[F.col("_near._v").getField(v).alias(f"nearest_{v}") for v in values])


def interpolate_at(left: DataFrame, signal: DataFrame, t: str, value: str, keys: Sequence[str] = (), width: float = 3600.0, max_gap: float | None = None, circular: bool = False) -> DataFrame:
    """Left rows with ``value`` of the signal, linear between the samples around; null outside and in gaps over ``max_gap``.

    ``circular``: through sine and cosine, wrapped to [0, 2 pi).
    """
    got = neighbours(left, signal, t, [value], keys, width)
    t0, t1 = F.col("_before._t"), F.col("_after._t")
    v0, v1 = F.col("_before._v").getField(value), F.col("_after._v").getField(value)
    share = F.when(t1 > t0, (F.col(t) - t0) / (t1 - t0)).otherwise(F.lit(0.0))
    if circular:
        mixed = lambda f: f(v0) + share * (f(v1) - f(v0))
        at = F.pmod(F.atan2(mixed(F.sin), mixed(F.cos)), F.lit(2 * 3.141592653589793))
    else:
        at = v0 + share * (v1 - v0)
    ok = t0.isNotNull() & t1.isNotNull()
    if max_gap is not None:
        ok &= (t1 - t0 <= max_gap) | (t0 == F.col(t)) | (t1 == F.col(t))
    return got.withColumn(value, F.when(ok, at)).drop("_before", "_after")
