"""Null models of assemblies and correlations: all shuffles as one job.

A shuffle moves bins by a rule that gives each bin its new place by itself (a
shift, or a keyed permutation of 0 to n - 1), so no order is sorted for and no
window is needed. Series travel as packed chunks with the shuffle as a key;
stretches of the new bins become matrices, one product each, and the products
of a shuffle are added up where its eigenvalues are taken. A group holds a
stretch, whose length grows with the root of the number of bins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Bins in a packed chunk of a series.
CHUNK = 4096
#: Bins in a stretch at least.
STRETCH = 2048
_ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def dealt(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """Places of ``i`` in a permutation of 0 to n - 1 that hangs on the key: a Feistel network over the next power of four, walked until inside."""
    if n < 2:
        return np.zeros(len(i), np.int64)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    salt = (key & (2**64 - 1)) * 0x9E3779B97F4A7C15 & (2**64 - 1)
    mask, keys = np.uint64((1 << half) - 1), _mix(np.arange(1, _ROUNDS + 1, dtype=np.uint64) + np.uint64(salt))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right * np.uint64(0xD1342543DE82EF95) + k) & mask)
        return left << np.uint64(half) | right

    with np.errstate(over="ignore"):
        x = once(np.asarray(i).astype(np.uint64))
        while (out := np.flatnonzero(x >= np.uint64(n))).size:
            x[out] = once(x[out])
    return x.astype(np.int64)


def _moved(z: DataFrame, n_shuffles: int, n_bins: int, length: int, place: Callable[[np.ndarray, int, int], np.ndarray], by: Column, unit: str, index: str, value: str) -> DataFrame:
    """(_s, _part, unit, _at, _v): values of each shuffle at their new places, packed by stretches of ``length`` bins."""
    packed = z.where(F.col(value).isNotNull()).groupBy(F.col(unit), F.floor(F.col(index) / CHUNK).alias("_c")).agg(F.collect_list(F.struct(F.col(index).cast("long").alias("b"), F.col(value).cast("double").alias("v"))).alias("_p"))
    rows = packed.select(unit, F.col("_p.b").alias("_b"), F.col("_p.v").alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(n_shuffles - 1))).alias("_s")).withColumn("_by", by)

    def move(batches):
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out: dict[str, list] = {n: [] for n in ("_s", "_part", "row", "_at", "_v")}
            for row in range(batch.num_rows):
                b, v = (np.asarray(columns[c][row].values.to_numpy(zero_copy_only=False)) for c in ("_b", "_v"))
                to = place(b, columns["_s"][row].as_py(), columns["_by"][row].as_py())
                order = np.argsort(to // length, kind="stable")
                to, v = to[order], v[order]
                cut = np.r_[0, np.flatnonzero(np.diff(to // length)) + 1, len(to)]
                for lo, hi in zip(cut[:-1], cut[1:]):
                    out["_s"].append(columns["_s"][row].as_py())
                    out["_part"].append(int(to[lo] // length))
                    out["row"].append(row)
                    out["_at"].append((to[lo:hi] % length).astype(np.int32).tobytes())
                    out["_v"].append(v[lo:hi].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["_s"], pa.int32()), pa.array(out["_part"], pa.int64()), columns[unit].take(pa.array(out["row"], pa.int64())), pa.array(out["_at"], pa.binary()), pa.array(out["_v"], pa.binary())],
                ["_s", "_part", unit, "_at", "_v"],
            )

    return rows.mapInArrow(move, f"_s int, _part long, {unit} {dict(z.dtypes)[unit]}, _at binary, _v binary")


def shuffled_values(z: DataFrame, n_shuffles: int, n_bins: int, place: Callable[[np.ndarray, int, int], np.ndarray], by: Column, values: Callable[[np.ndarray], np.ndarray], units: Sequence, rows: Sequence[int] | None = None, columns: Sequence[int] | None = None, unit: str = "unit", index: str = "bin", value: str = "z") -> DataFrame:
    """(shuffle, values): ``values`` of the mean product of units (positions ``rows`` by ``columns`` of ``units``) in each shuffle.

    ``place(bins, shuffle, by)`` gives the new bins; ``by`` is a column of a
    unit and a shuffle (``_s``). A bin without a value counts as zero.
    """
    at = {u: k for k, u in enumerate(units)}
    rows, columns = (list(range(len(units))) if x is None else list(x) for x in (rows, columns))
    length = max(STRETCH, 2 * len(units), int(np.sqrt(512 * n_bins)))
    shape = (len(rows), len(columns))

    def product(t: pa.Table) -> pa.Table:
        m = np.zeros((len(units), length))
        for u, a, v in zip(t.column(unit).to_pylist(), t.column("_at").to_pylist(), t.column("_v").to_pylist(), strict=True):
            m[at[u], np.frombuffer(a, np.int32)] = np.frombuffer(v)
        return pa.table({"_s": t.column("_s").slice(0, 1), "m": pa.array([(m[rows] @ m[columns].T).tobytes()], pa.binary())})

    def total(t: pa.Table) -> pa.Table:
        m = np.zeros(shape)
        for raw in t.column("m").to_pylist():
            m += np.frombuffer(raw).reshape(shape)
        return pa.table({"shuffle": t.column("_s").slice(0, 1), "values": pa.array([np.atleast_1d(values(m / n_bins)).tolist()], pa.list_(pa.float64()))})

    moved = _moved(z, n_shuffles, n_bins, length, place, by, unit, index, value)
    products = moved.groupBy("_s", "_part").applyInArrow(product, "_s int, m binary")
    return products.groupBy("_s").applyInArrow(total, "shuffle int, values array<double>")


def units_of(z: DataFrame, unit: str = "unit") -> list:
    """The units in order: the side of the matrices."""
    return sorted(r[0] for r in z.select(unit).distinct().collect())


def largest_eigenvalues(z: DataFrame, n_shuffles: int, n_bins: int, kind: str = "circular", seed: int = 0, unit: str = "unit", index: str = "bin", value: str = "z", shift: Column | None = None, groups: dict | None = None) -> DataFrame:
    """(shuffle, values): the largest eigenvalue of each shuffle of dense series with bins 0 to n_bins - 1.

    ``circular`` rolls each unit by bins of its own (``shift`` of the unit and
    the shuffle ``_s``, by default hashed); ``bins`` puts each unit's bins in an
    order of its own. ``groups`` (unit to group) keeps only products between
    groups.
    """
    units = units_of(z, unit)
    own = F.xxhash64(unit, F.col("_s"), F.lit(seed))
    by = own if kind == "bins" else F.pmod(own, F.lit(n_bins)) if shift is None else shift
    place = (lambda b, s, k: dealt(b, n_bins, k)) if kind == "bins" else (lambda b, s, k: (b + k) % n_bins)
    across = None if groups is None else np.array([[groups[u] != groups[w] for w in units] for u in units])
    top = lambda m: np.linalg.eigvalsh(m if across is None else np.where(across, m, 0.0))[-1:]
    return shuffled_values(z, n_shuffles, n_bins, place, by.cast("long"), top, units, unit=unit, index=index, value=value)


def cross_singular_values(z: DataFrame, groups: dict, n_shuffles: int, n_bins: int, seed: int = 0, unit: str = "unit", index: str = "bin", value: str = "z") -> DataFrame:
    """(shuffle, values): singular values between two groups of units with each group's bins in one order of its own.

    Units of a group stay together, so only what ties the groups is undone.
    """
    units = units_of(z, unit)
    names = sorted({groups[u] for u in units})
    if len(names) != 2:
        raise ValueError("there must be exactly two groups")
    a, b = ([i for i, u in enumerate(units) if groups[u] == g] for g in names)
    by = F.xxhash64(F.when(F.col(unit).isin([units[i] for i in b]), 1).otherwise(0), F.col("_s"), F.lit(seed))
    return shuffled_values(z, n_shuffles, n_bins, lambda x, s, k: dealt(x, n_bins, k), by, lambda m: np.linalg.svd(m, compute_uv=False), units, a, b, unit, index, value)


def dealt_pairs(pairs: DataFrame, n_shuffles: int, keep: Sequence[str], deal: str, seed: int = 0) -> DataFrame:
    """(_s, keep, deal): rows of each shuffle with the values of one column dealt to other rows, every value once.

    Rows are numbered by their partitions' sizes, and a keyed permutation says
    whose value each gets: an equi-join on that number, no order of all rows.
    """
    from ..sources.batch import staged

    x = staged(pairs.select(*keep, deal, F.monotonically_increasing_id().alias("_id")), "pairs")
    part = F.shiftright("_id", 33)
    sizes = {r["_p"]: r["n"] for r in x.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each partition
    starts = np.cumsum([0] + [sizes.get(p, 0) for p in range(max(sizes, default=0) + 1)])
    n = int(starts[-1])
    nth = F.element_at(F.lit(starts.tolist()).cast("array<long>"), part.cast("int") + 1) + F.col("_id").bitwiseAND((1 << 33) - 1)
    x = x.withColumn("_i", nth)

    def give(frames):
        for f in frames:
            for s in range(n_shuffles):
                yield pd.DataFrame({"_s": np.int32(s), "_i": dealt(f["_i"].to_numpy(), n, seed * 1_000_003 + s), deal: f[deal].to_numpy()})

    given = x.select("_i", deal).mapInPandas(give, f"_s int, _i long, {deal} {dict(pairs.dtypes)[deal]}")
    return x.select("_i", *keep).join(given, "_i").select("_s", *keep, deal)
