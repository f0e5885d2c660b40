"""Ranks, percentiles and modes of values whose keys may be of any size.

Values are sorted once by ranges over the whole cluster, so that a key goes on
from one partition to the next and no task holds more than a partition. What
joins the pieces of a key is a row for each partition it touches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.batch import staged


def ranked(rows: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Adds ``rank`` (from 0) of each row in the order of ``value`` within its key, and ``n``, the key's rows.

    Nulls come first. Equal values have ranks of their own and may stand in
    different partitions, so that a frequent value is no task's burden.
    """
    spark = rows.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = rows.withColumn("_tie", F.monotonically_increasing_id())
    lined = x.repartitionByRange(n_parts, *keys, value, "_tie").sortWithinPartitions(*keys, value, "_tie").drop("_tie")
    own = [lined.schema.names.index(k) for k in keys]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for b in batches:
            n = b.num_rows
            new = np.zeros(n, bool)
            for k in own:
                codes = b.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            now = tuple(b.column(k)[0].as_py() for k in own) if n else None
            if n and now != last:
                new[0], count = True, 0
            at = np.arange(n)
            begin = np.maximum.accumulate(np.where(new, at, -count))
            if n:
                last, count = tuple(b.column(k)[n - 1].as_py() for k in own), int(at[-1] - begin[-1] + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(at - begin)], [*b.schema.names, "_part", "_nth"])

    ddl = ", ".join([f"`{c}` {t}" for c, t in lined.dtypes] + ["_part int", "_nth long"])
    lined = staged(lined.mapInArrow(number, ddl), "ranked")
    pieces = lined.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"))  # keys and partitions together
    w = Window.partitionBy(*keys)
    pieces = pieces.withColumns({"_before": F.coalesce(F.sum("_rows").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("_rows").over(w)})
    other = {k: f"_k{i}" for i, k in enumerate([*keys, "_part"])}
    on = F.lit(True)
    for k, o in other.items():
        on &= F.col(k).eqNullSafe(F.col(o))
    got = lined.join(pieces.withColumnsRenamed(other), on)
    return got.select(*rows.columns, (F.col("_nth") + F.col("_before")).alias("rank"), "n")


def quantiles(rows: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """(keys, prob, value): exact percentiles with linear interpolation, as ``percentile`` gives; nulls do not count.

    ``percentile`` keeps all values of a key in one task's memory; here two
    ranks of the sorted values are picked for each percentile.
    """
    r = ranked(rows.select(*keys, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull()), value, keys)
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    at = F.col("prob") * (F.col("n") - 1)
    # at most two rows of a key meet a percentile; the others are filtered where they stand
    near = F.exists(F.array(*[F.lit(float(p)) for p in probs]), lambda p: (F.col("rank") == F.floor(p * (F.col("n") - 1))) | (F.col("rank") == F.ceil(p * (F.col("n") - 1))))
    x = r.where(near).select("*", wanted)
    low, high = F.when(F.col("rank") == F.floor(at), F.col(value)), F.when(F.col("rank") == F.ceil(at), F.col(value))
    got = x.groupBy(*keys, "prob", "n").agg(F.max(low).alias("_low"), F.max(high).alias("_high"))
    share = at - F.floor(at)
    return got.select(*keys, "prob", (F.col("_low") * (1 - share) + F.col("_high") * share).alias(value))


# how far values are from having one mode


def modes_tried(n: int) -> np.ndarray:
    """Ranks that are tried as the mode: all of up to a thousand values, a hundred of more."""
    return np.arange(1, n - 1) if n <= 1000 else np.linspace(1, n - 2, min(100, n - 2), dtype=int)


def _corners(x: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Positions of the points that are on the convex hull of a rising curve: the only ones that can be furthest from a line."""
    keep: list[int] = []
    for sign in (1.0, -1.0):
        hull: list[int] = []
        for i in range(len(x)):
            while len(hull) > 1:
                a, b = hull[-2], hull[-1]
                if sign * ((x[b] - x[a]) * (f[i] - f[a]) - (f[b] - f[a]) * (x[i] - x[a])) <= 0:
                    hull.pop()
                else:
                    break
            hull.append(i)
        keep += hull
    return np.unique(keep)


def furthest(x: np.ndarray, f: np.ndarray, rank: np.ndarray, n: int) -> float:
    """Least, over modes, of the largest distance of the values' distribution from two straight lines that meet at the mode.

    ``x`` and ``f`` may be thinned to the hull corners of stretches that no
    mode cuts, with both ends and the modes themselves kept.
    """
    if n < 3:
        return 0.0
    at = np.searchsorted(rank, modes_tried(n))
    best = np.inf
    for m in at:
        mass, left, right = rank[m] / n, max(x[m] - x[0], 1e-12), max(x[-1] - x[m], 1e-12)
        u = np.where(x <= x[m], (x - x[0]) / left * mass, mass + (x - x[m]) / right * (1 - mass))
        best = min(best, float(np.abs(f - np.clip(u, 0.0, 1.0)).max()))
    return best


@lru_cache(maxsize=64)
def _null(n: int, n_boot: int, seed: int) -> np.ndarray:
    """The same distance of samples of the normal distribution."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n_boot):
        x = np.sort(rng.standard_normal(n))
        out.append(furthest(x, np.arange(1, n + 1) / n, np.arange(n), n))
    return np.array(out)


def dip_test(rows: DataFrame, value: str, keys: Sequence[str], n_boot: int = 100, seed: int = 0, most: int = 2000) -> DataFrame:
    """(keys, n, dip, p): distance of each key's values from one mode, and the share of normal samples that are as far.

    The distance is from two straight lines that meet at a mode, the best of
    all values or of a hundred; normal samples have up to ``most`` values (they
    are themselves about 0.2 away, whatever their number, so this finds gaps
    between modes rather than small bumps).
    Nulls and NaN do not count; fewer than three values give 0 and 1. Sorted
    stretches between the modes are reduced to the corners of their hulls,
    where they are furthest from any line, so a key is never held whole.
    """
    kinds = dict(rows.dtypes)
    x = rows.select(*keys, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    r = ranked(x, "_x", keys)
    ddl = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["_x double", "rank long", "n long"])

    def thin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in frames:
            for _, own in g.groupby(list(keys), dropna=False, sort=False):
                own = own.sort_values("rank")
                rank, n = own["rank"].to_numpy(), int(own["n"].iloc[0])
                if n <= 1000:
                    yield own
                    continue
                modes = modes_tried(n)
                stretch = np.searchsorted(modes, rank, side="left")
                cut = np.r_[0, np.flatnonzero(np.diff(stretch)) + 1, len(rank)]
                v, keep = own["_x"].to_numpy(), []
                for a, b in zip(cut[:-1], cut[1:]):
                    keep.append(a + _corners(v[a:b], (rank[a:b] + 1) / n))
                ends = np.flatnonzero(np.isin(rank, modes) | (rank == 0) | (rank == n - 1))
                yield own.iloc[np.unique(np.concatenate([*keep, ends]))]

    def judge(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank")
        n = int(g["n"].iloc[0])
        d = furthest(g["_x"].to_numpy(), (g["rank"].to_numpy() + 1) / n, g["rank"].to_numpy(), n)
        p = float((_null(min(n, most), n_boot, seed) >= d).mean()) if n >= 3 else 1.0
        return pd.DataFrame({**{k: [g[k].iloc[0]] for k in keys}, "n": [n], "dip": [d], "p": [p]})

    thinned = r.mapInPandas(thin, ddl)
    return thinned.groupBy(*keys).applyInPandas(judge, ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["n long", "dip double", "p double"]))
