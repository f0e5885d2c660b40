"""Significance against shuffles, intervals of confidence, residuals, and circular statistics as aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

TWO_PI = 2 * math.pi


def significant(scores: DataFrame, shuffled: DataFrame, keys: Sequence[str], q: float = 95.0, tail: str = "both") -> DataFrame:
    """(keys, score, p, z, significant) of scores against shuffled scores of the same keys.

    p = (r + 1) / (n + 1) with r the shuffles at least as extreme; a null score
    has p 1. Significant: strictly beyond the percentile.
    """
    side = {"both": (F.abs("score"), F.abs("shuffled")), "right": (F.col("score"), F.col("shuffled")), "left": (-F.col("score"), -F.col("shuffled"))}[tail]
    x = scores.select(*keys, "score").join(shuffled.select(*keys, F.col("score").alias("shuffled")), list(keys), "left")
    got = x.withColumn("_a", side[0]).withColumn("_b", side[1]).groupBy(*keys, "score", "_a").agg(
        F.sum((F.col("_b") >= F.col("_a")).cast("int")).alias("_r"), F.count("_b").alias("_n"), F.percentile("_b", F.lit(q / 100)).alias("_q"), F.avg("shuffled").alias("_m"), F.stddev_pop("shuffled").alias("_s"),
    )
    p = F.when(F.col("score").isNull(), 1.0).otherwise((F.coalesce("_r", F.lit(0)) + 1) / (F.col("_n") + 1))
    return got.select(*keys, "score", p.alias("p"), F.try_divide(F.col("score") - F.col("_m"), F.col("_s")).alias("z"), F.coalesce(F.col("_a") > F.col("_q"), F.lit(False)).alias("significant"))


def ordered_mean(rows: DataFrame, value: str, order: str, keys: Sequence[str], out: str = "mean") -> DataFrame:
    """(keys, out): the mean of values added up in one order, so that the last digit of it, and what ties with it, does not hang on how rows are dealt to tasks."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = rows.where(F.col(value).isNotNull()).select(*keys, order, F.sum(value).over(w).alias("_s"), F.count(F.lit(1)).over(w).alias("_n"))
    return x.groupBy(*keys).agg(F.max(F.struct("_n", "_s")).alias("_l")).select(*keys, (F.col("_l._s") / F.col("_l._n")).alias(out))


def student_quantile(p: float, n: float) -> float:
    """Quantile of Student's distribution, by bisection on the incomplete beta function."""
    from ..functions.special import student_cdf

    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if student_cdf(mid, n) < p else (lo, mid)
    return (lo + hi) / 2


def confidence_interval(rows: DataFrame, value: str, keys: Sequence[str] = (), conf: float = 0.95) -> DataFrame:
    """(keys, mean, lower, upper, n) by Student's distribution."""
    g = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"), F.count(value).alias("n"))
    se = F.col("_s") / F.sqrt("n")
    t = student_t(F.col("n") - 1, conf)
    return g.select(*keys, "mean", (F.col("mean") - t * se).alias("lower"), (F.col("mean") + t * se).alias("upper"), "n")


def student_t(df: Column, conf: float) -> Column:
    """Two-sided quantile: exact for up to 200 degrees of freedom from a table made by rule, a series beyond."""
    p = 0.5 + conf / 2
    table = F.array(*[F.lit(student_quantile(p, k)) for k in range(1, 201)])
    z = student_quantile(p, 1e7)
    tail = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df * df)
    return F.when(df < 1, None).when(df <= 200, F.element_at(table, F.least(F.greatest(df, F.lit(1)), F.lit(200)).cast("int"))).otherwise(tail)


def bootstrap(rows: DataFrame, value: str, keys: Sequence[str], estimator: Column, n_boot: int, conf: float = 0.95, seed: int = 0) -> DataFrame:
    """(keys, lower, upper) of an aggregate over Poisson resamples; ``estimator`` aggregates ``_v``, weights become copies."""
    s = F.broadcast(rows.sparkSession.range(n_boot).select(F.col("id").alias("_boot")))
    u = F.pmod(F.xxhash64(*rows.columns, "_boot", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    x = rows.join(s, F.lit(True)).withColumn("_u", u)
    cdf, k, total = [], 0, 0.0
    while total < 1 - 1e-9:
        total += math.exp(-1) / math.factorial(k)
        cdf.append(total)
        k += 1
    copies = sum(((F.col("_u") > c).cast("int") for c in cdf[1:-1]), (F.col("_u") > cdf[0]).cast("int"))
    x = x.withColumn("_c", copies).where("_c > 0").select(*keys, "_boot", F.explode(F.array_repeat(F.col(value), F.col("_c"))).alias("_v"))
    e = x.groupBy(*keys, "_boot").agg(estimator.alias("_e"))
    a = (1 - conf) / 2
    return e.groupBy(*keys).agg(F.percentile("_e", F.lit(a)).alias("lower"), F.percentile("_e", F.lit(1 - a)).alias("upper"))


def repeat_rows(rows: DataFrame, weight: str) -> DataFrame:
    """Each row as often as its weight says."""
    return rows.where(F.col(weight) > 0).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col(weight).cast("int")))).drop("_k")


def regress_out(rows: DataFrame, a: str, b: str, keys: Sequence[str] = (), out: str = "residual") -> DataFrame:
    """``a`` without what depends linearly on ``b``, with the mean of ``a`` put back; null where either is."""
    ok = F.col(a).isNotNull() & F.col(b).isNotNull()
    m = rows.where(ok).groupBy(*keys).agg(F.covar_pop(a, b).alias("_c"), F.var_pop(b).alias("_v"), F.avg(b).alias("_mb"))
    x = rows.join(m, list(keys), "left") if keys else rows.join(F.broadcast(m), F.lit(True))  # one row
    slope = F.coalesce(F.try_divide("_c", "_v"), F.lit(0.0))
    return x.withColumn(out, F.when(ok, F.col(a) - slope * (F.col(b) - F.col("_mb")))).drop("_c", "_v", "_mb")


def benjamini_hochberg(rows: DataFrame, p: str, keys: Sequence[str], by: Sequence[str], out: str = "adjusted") -> DataFrame:
    """Adjusted p within each key."""
    own = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(own)
    x = rows.withColumn("_r", F.row_number().over(own.orderBy(p, *by))).withColumn("_q", F.col(p) * n / F.col("_r"))
    low = F.min("_q").over(own.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn(out, F.least(low, F.lit(1.0))).drop("_r", "_q")


# circular


def mod2pi(x: Column) -> Column:
    return F.pmod(x, F.lit(TWO_PI))


def resultant(alpha: Column, weight: Column | None = None, spacing: float | None = None, axial: int = 1) -> Column:
    """Aggregate: length of the mean resultant vector, corrected for bins of a spacing."""
    w = F.lit(1.0) if weight is None else weight
    c, s = F.try_divide(F.sum(w * F.cos(axial * alpha)), F.sum(w)), F.try_divide(F.sum(w * F.sin(axial * alpha)), F.sum(w))
    r = F.sqrt(c * c + s * s)
    return r * (spacing / 2 / math.sin(spacing / 2)) if spacing else r


def circular_mean(alpha: Column, weight: Column | None = None, axial: int = 1) -> Column:
    """Aggregate: mean direction in [0, 2 pi)."""
    w = F.lit(1.0) if weight is None else weight
    return mod2pi(F.atan2(F.sum(w * F.sin(axial * alpha)), F.sum(w * F.cos(axial * alpha))) / axial)


def rayleigh(rows: DataFrame, alpha: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(keys, n, r, z, p) of Rayleigh's test of uniformity."""
    w = F.col(weight) if weight else None
    g = rows.groupBy(*keys).agg(resultant(F.col(alpha), w).alias("r"), (F.sum(w) if weight else F.count(alpha)).cast("double").alias("n"))
    big = F.col("n") * F.col("r")
    p = F.exp(F.sqrt(1 + 4 * F.col("n") + 4 * (F.col("n") * F.col("n") - big * big)) - (1 + 2 * F.col("n")))
    return g.select(*keys, "n", "r", (big * big / F.col("n")).alias("z"), p.alias("p"))


def mean_ci(rows: DataFrame, alpha: str, keys: Sequence[str] = (), chi2: float = 3.841458820694124) -> DataFrame:
    """(keys, mean, half_width) of the mean direction; ``chi2`` is the quantile of one degree (default 95 %)."""
    g = rows.groupBy(*keys).agg(resultant(F.col(alpha)).alias("r"), circular_mean(F.col(alpha)).alias("mean"), F.count(alpha).cast("double").alias("n"))
    n, r = F.col("n"), F.col("r")
    big = n * r
    low = F.sqrt(2 * n * (2 * big * big - n * chi2) / (4 * n - chi2))
    high = F.sqrt(n * n - (n * n - big * big) * F.exp(F.lit(chi2) / n))
    t = F.when((r < 0.9) & (r > F.sqrt(F.lit(chi2) / 2 / n)), low).when(r >= 0.9, high)
    return g.select(*keys, "mean", F.acos(t / big).alias("half_width"))


def centred(rows: DataFrame, alpha: str, keys: Sequence[str] = (), out: str = "centred") -> DataFrame:
    """Angles about their mean direction, in [0, 2 pi)."""
    m = rows.groupBy(*keys).agg(circular_mean(F.col(alpha)).alias("_m"))
    x = rows.join(m, list(keys)) if keys else rows.join(F.broadcast(m), F.lit(True))  # one row
    return x.withColumn(out, mod2pi(F.col(alpha) - F.col("_m"))).drop("_m")


def circular_percentile(alpha: Column, q: float, q0: float) -> Column:
    """Aggregate: percentile counted from q0 around the circle."""
    return mod2pi(F.percentile(mod2pi(alpha - q0), F.lit(q / 100)) + q0)


def circular_correlation(rows: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, rho, n) of two angles."""
    m = rows.groupBy(*keys).agg(circular_mean(F.col(a)).alias("_ma"), circular_mean(F.col(b)).alias("_mb"))
    x = rows.join(m, list(keys)) if keys else rows.join(F.broadcast(m), F.lit(True))  # one row
    sa, sb = F.sin(F.col(a) - F.col("_ma")), F.sin(F.col(b) - F.col("_mb"))
    g = x.groupBy(*keys).agg(F.sum(sa * sb).alias("_ab"), F.sum(sa * sa).alias("_aa"), F.sum(sb * sb).alias("_bb"), F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.try_divide("_ab", F.sqrt(F.col("_aa") * F.col("_bb"))).alias("rho"), "n")


def circular_correlation_uniform(rows: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, rho, n) for angles without a mean direction: resultants of the difference and the sum."""
    d, s = F.col(a) - F.col(b), F.col(a) + F.col(b)
    g = rows.groupBy(*keys).agg(resultant(d).alias("_d"), resultant(s).alias("_s"), F.count(F.lit(1)).alias("n"))
    return g.select(*keys, (F.col("_d") - F.col("_s")).alias("rho"), "n")
