"""Population vectors, assemblies, explained variance and landscapes.

Large tables are reduced by aggregates to Gram or correlation matrices over
units; only those (units x units) are solved with NumPy on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

K = Sequence[str]


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similarity_pairs(vectors: DataFrame, vector: str, key: str, group: str | None = None, blocks: int | None = None) -> DataFrame:
    """(key, key2, cosine) of all pairs key < key2, of vectors in different groups only if ``group`` is named; null for a vector of zeros.

    Vectors are equally long; they meet by blocks, a matrix product each.
    """
    import pyarrow as pa

    from .correlate import _block_product, _rows_of

    kind = dict(vectors.dtypes)[key]
    extra = [F.col(group).alias("_g")] if group else []
    rows = vectors.select(key, *extra, F.col(vector).alias("_z"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        u, w = a[key].to_numpy(), b[key].to_numpy()
        x, y = (_rows_of(t["_z"]).astype(float) for t in (a, b))
        with np.errstate(divide="ignore", invalid="ignore"):
            c = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
        keep = u[:, None] < w[None, :] if a["_i"][0] == b["_j"][0] else np.ones(c.shape, bool)
        if group:
            keep &= a["_g"].to_numpy()[:, None] != b["_g"].to_numpy()[None, :]
        i, j = np.nonzero(keep)
        up, of, c = u[i] < w[j], a.schema.field(key).type, c[i, j]
        return pa.table({key: pa.array(np.where(up, u[i], w[j]), of), "key2": pa.array(np.where(up, w[j], u[i]), of), "cosine": pa.array(c, mask=~np.isfinite(c))})

    return _block_product(rows, [], key, blocks, run, f"{key} {kind}, key2 {kind}, cosine double")


def similarity_index(vectors: DataFrame, vector: str, key: str, n_shuffles: int, seed: int = 0, blocks: int | None = None) -> DataFrame:
    """(key, key2, similarity, p): |cosine| of patterns key < key2 against the second one's entries in hashed orders.

    Pairs meet by blocks of patterns, a matrix product for each shuffle; a
    pattern has one order of its entries in a shuffle, whatever it meets.
    """
    import pyarrow as pa

    from .correlate import _block_product, _rows_of

    kind = dict(vectors.dtypes)[key]
    rows = vectors.select(key, F.xxhash64(key, F.lit(seed)).alias("_h"), F.col(vector).alias("_z"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        u, w = a[key].to_numpy(), b[key].to_numpy()
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (_rows_of(t["_z"]).astype(float) for t in (a, b)))
        seen = np.abs(x @ y.T)
        later, earlier = np.zeros(seen.shape, np.int64), np.zeros(seen.shape, np.int64)
        same = a["_i"][0] == b["_j"][0]
        for s in range(n_shuffles):
            later += np.abs(x @ _mixed(y, b["_h"].to_numpy(), s).T) >= seen
            if not same:
                earlier += np.abs(_mixed(x, a["_h"].to_numpy(), s) @ y.T) >= seen
        i, j = np.nonzero(u[:, None] < w[None, :]) if same else (v.ravel() for v in np.indices(seen.shape))
        up = u[i] < w[j]
        first, second = np.where(up, u[i], w[j]), np.where(up, w[j], u[i])
        p = (np.where(up, later[i, j], earlier[i, j]) + 1) / (n_shuffles + 1)
        of = a.schema.field(key).type
        return pa.table({key: pa.array(first, of), "key2": pa.array(second, of), "similarity": seen[i, j], "p": p})

    return _block_product(rows, [], key, blocks, run, f"{key} {kind}, key2 {kind}, similarity double, p double")


def _mixed(rows: np.ndarray, of: np.ndarray, shuffle: int) -> np.ndarray:
    """Entries of each row in an order that hangs on the row's number and the shuffle's."""
    h = (of.astype(np.uint64)[:, None] ^ np.uint64(shuffle + 1) * np.uint64(0x9E3779B97F4A7C15)) + np.arange(1, rows.shape[1] + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.take_along_axis(rows, np.argsort(h ^ (h >> np.uint64(31)), axis=1), axis=1)


def proximity(a: DataFrame, b: DataFrame, vector: str, key: str, block: int = 2000) -> DataFrame:
    """(key, proximity): one minus the distance of the two vectors of a key over the mean distance to all vectors of the other table.

    The mean over the second table is a full comparison by definition: blocks
    of the two tables meet, a matrix product each, and leave a sum a vector.
    """
    import pyarrow as pa

    from ..sources.batch import staged
    from .correlate import _rows_of

    d = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, e: s + e))
    double = F.transform(vector, lambda e: e.cast("double"))
    x, y = staged(a.select(key, double.alias("_x")), "near"), staged(b.select(key, double.alias("_x")), "far")
    kind = dict(a.dtypes)[key]
    parts = [max(1, -(-t.count() // block)) for t in (x, y)]
    at = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    whole = F.col("_x").isNotNull() & F.forall("_x", lambda e: e.isNotNull())
    left = x.where(whole).withColumn("_i", at(parts[0])).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(parts[1] - 1))))
    right = y.where(whole).withColumn("_j", at(parts[1])).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(parts[0] - 1))))
    ddl = f"{key} {kind}, _s double, _n long"

    def run(p: pa.Table, q: pa.Table) -> pa.Table:
        if not len(p) or not len(q):
            return pa.table({key: pa.array([], p.schema.field(key).type), "_s": pa.array([], pa.float64()), "_n": pa.array([], pa.int64())})
        u, w = _rows_of(p["_x"]), _rows_of(q["_x"])
        square = (u * u).sum(axis=1)[:, None] + (w * w).sum(axis=1)[None, :] - 2 * (u @ w.T)
        return pa.table({key: p[key].combine_chunks(), "_s": np.sqrt(np.maximum(square, 0.0)).sum(axis=1), "_n": np.full(len(u), len(w), np.int64)})

    met = left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(run, ddl)
    mean = met.groupBy(key).agg((F.sum("_s") / F.sum("_n")).alias("_m"))
    own = x.join(y.select(F.col(key), F.col("_x").alias("_y")), key).groupBy(key).agg(F.max(d(F.col("_x"), F.col("_y"))).alias("_own"))
    return x.select(key).distinct().join(mean, key, "left").join(own, key, "left").select(key, (1 - F.try_divide("_own", "_m")).alias("proximity"))


# assemblies


def marchenko_pastur(n_units: int, n_bins: int, tracy_widom: bool = False) -> float:
    """Upper bound of the eigenvalues of uncorrelated data."""
    q = n_bins / n_units
    bound = (1 + math.sqrt(1 / q)) ** 2
    return bound + n_units ** (-2 / 3) if tracy_widom else bound


def correlation_matrix(z: DataFrame, unit: str = "unit", index: str = "bin", value: str = "z") -> tuple[list, np.ndarray, int]:
    """Units, the mean products of each two over the bins that both have, and the number of bins.

    Bins are packed to rows, and each of a few tasks adds up one matrix of
    units x units; those reach the driver, which solves a matrix of that size.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    units = sorted(r[0] for r in z.select(unit).distinct().collect())  # the side of the matrix
    k, names = len(units), pa.array(units)
    bins = z.groupBy(index).agg(F.collect_list(F.col(unit)).alias("u"), F.collect_list(F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))).alias("x"))

    def run(batches):
        total, both, n = np.zeros((k, k)), np.zeros((k, k)), 0
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                u, x = b.column(0).slice(lo, 256), b.column(1).slice(lo, 256)
                m = np.full((len(u), k), np.nan)
                row = np.repeat(np.arange(len(u)), pc.list_value_length(u).to_numpy())
                m[row, pc.index_in(u.flatten(), names.cast(u.type.value_type)).to_numpy()] = x.flatten().to_numpy()
                there = (~np.isnan(m)).astype(float)
                m = np.nan_to_num(m)
                total += m.T @ m
                both += there.T @ there
                n += len(u)
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (total, both)] + [pa.array([n], pa.int64())], names=["m", "n", "bins"])

    total, both, n = np.zeros((k, k)), np.zeros((k, k)), 0
    for r in bins.select("u", "x").coalesce(8).mapInArrow(run, "m binary, n binary, bins long").toLocalIterator():
        total += np.frombuffer(r["m"]).reshape(k, k)
        both += np.frombuffer(r["n"]).reshape(k, k)
        n += r["bins"]
    return units, total / np.maximum(both, 1), n


def assemblies(z: DataFrame, unit: str = "unit", index: str = "bin", value: str = "z", method: str = "pca", bound: float | None = None, seed: int = 0, cross: dict | None = None) -> DataFrame:
    """(assembly, unit, weight): unit-norm patterns above the eigenvalue bound, the largest weight positive.

    ``pca`` patterns are eigenvectors; ``ica`` turns them by FastICA on the
    projected activity. ``cross`` maps units to groups: only correlations
    between groups count.
    """
    spark = z.sparkSession
    if cross is None and (got := _assemblies_of_bins(z, unit, index, value, method, bound, seed)) is not None:
        return got
    units, m, n_bins = correlation_matrix(z, unit, index, value)
    if cross is not None:
        g = np.array([cross[u] for u in units])
        m = np.where(g[:, None] != g[None, :], m, 0.0)
    values, vectors = np.linalg.eigh(m)
    limit = marchenko_pastur(len(units), n_bins) if bound is None else bound
    keep = np.argsort(-values)[: int((values > limit).sum())]
    w = vectors[:, keep]
    if method == "ica" and len(keep):
        w = w @ _rotation(Projected(z, units, w / np.sqrt(values[keep]), n_bins, unit, index, value), seed)
        w /= np.linalg.norm(w, axis=0)
    rows = []
    for k in range(w.shape[1]):
        v = w[:, k] * (1 if w[np.argmax(np.abs(w[:, k])), k] >= 0 else -1)
        rows += [(k, u, float(x)) for u, x in zip(units, v, strict=True)]
    kind = dict(z.dtypes)[unit]
    return spark.createDataFrame(rows, f"assembly int, {unit} {kind}, weight double")


def _assemblies_of_bins(z: DataFrame, unit: str, index: str, value: str, method: str, bound: float | None, seed: int) -> DataFrame | None:
    """:func:`assemblies` from the matrix of bins x bins, which has the same eigenvalues above zero, where bins are fewer than units and no value is missing; else None.

    The driver holds bins x bins and bins x patterns numbers, a task one matrix
    of bins x bins; weights are made unit by unit.
    """
    from ..sources.batch import staged

    size = z.agg(F.countDistinct(unit).alias("u"), F.countDistinct(index).alias("b"), F.count(F.lit(1)).alias("n"), F.count(F.nanvl(F.col(value).cast("double"), F.lit(None))).alias("v")).first()
    n = size["b"]
    if not n or size["u"] <= n or not size["u"] * n == size["n"] == size["v"]:
        return None
    packed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).cast("double").alias("x")))), lambda e: e["x"])
    rows = staged(z.groupBy(unit).agg(packed.alias("_z")), "units")
    if rows.where(F.size("_z") != n).limit(1).count():
        return None
    matrix = lambda b: b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)

    def squares(batches):
        total = np.zeros((n, n))
        for b in batches:
            total += matrix(b).T @ matrix(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    import pyarrow as pa

    gram = np.zeros((n, n))
    for r in rows.select(unit, "_z").coalesce(8).mapInArrow(squares, "m binary").toLocalIterator():
        gram += np.frombuffer(r["m"]).reshape(n, n)
    values, vectors = np.linalg.eigh(gram / n)
    limit = marchenko_pastur(size["u"], n) if bound is None else bound
    if limit < 1e-9 * max(values[-1], 1e-300):  # patterns of no activity, which bins do not show
        return None
    keep = np.argsort(-values)[: int((values > limit).sum())]
    kind = dict(z.dtypes)[unit]
    ddl = f"assembly int, {unit} {kind}, weight double"
    if not len(keep):
        return z.sparkSession.createDataFrame([], ddl)
    to = vectors[:, keep] / np.sqrt(n * values[keep])  # weights of a unit: its row times this
    if method == "ica":
        to = to @ _rotation(Projected.of(np.sqrt(n) * vectors[:, keep].T), seed)
    to = to / np.sqrt(np.einsum("ik,ij,jk->k", to, gram, to))

    def weights(to: np.ndarray):
        def run(batches):
            for b in batches:
                w = matrix(b) @ to
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(to.shape[1], dtype=np.int32), len(w))), b.column(0).take(pa.array(np.repeat(np.arange(len(w)), to.shape[1]))), pa.array(w.ravel())], names=["assembly", unit, "weight"])

        return rows.select(unit, "_z").mapInArrow(run, ddl)

    sign = {r["assembly"]: 1 if r["w"] >= 0 else -1 for r in weights(to).groupBy("assembly").agg(F.max_by("weight", F.struct(F.abs("weight"), "weight")).alias("w")).collect()}  # a row a pattern
    return weights(to * np.array([sign[k] for k in range(to.shape[1])]))


class Projected:
    """Activity of all bins along some patterns, and its means; what one machine holds (MOST numbers) is held there, more stays distributed."""

    MOST = 10_000_000

    def __init__(self, z: DataFrame, units: list, w: np.ndarray, n_bins: int, unit: str, index: str, value: str):
        kind = dict(z.dtypes)[unit]
        self.k, self.n = w.shape[1], n_bins
        p = z.sparkSession.createDataFrame([(u, [float(x) for x in w[i]]) for i, u in enumerate(units)], f"{unit} {kind}, w array<double>")
        got = z.join(p, unit).groupBy(index).agg(*[F.sum(F.col(value) * F.col("w")[k]).alias(f"p{k}") for k in range(self.k)]).drop(index)
        self.here = n_bins * self.k <= self.MOST
        self.x = np.ascontiguousarray(got.toPandas().to_numpy().T) if self.here else got.checkpoint()

    @classmethod
    def of(cls, x: np.ndarray) -> Projected:
        """Projections (patterns x bins) that are at hand."""
        made = cls.__new__(cls)
        made.k, made.n, made.here, made.x = *x.shape, True, x
        return made

    def mean(self, f) -> np.ndarray:
        """Mean over bins of ``f(x) / bins``, an array made of the projections of some bins (patterns x bins)."""
        if self.here:
            return f(self.x) / self.n
        import pyarrow as pa

        def run(batches):
            total = None
            for b in batches:
                v = f(np.stack([c.to_numpy() for c in b.columns]))
                total = v if total is None else total + v
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

        parts = [np.frombuffer(r["m"]) for r in self.x.mapInArrow(run, "m binary").toLocalIterator()]  # patterns x patterns numbers a task
        return sum(parts).reshape(-1, self.k) / self.n


def _rotation(data: Projected, seed: int, rounds: int = 500, tol: float = 1e-6) -> np.ndarray:
    """Symmetric FastICA of whitened rows with tanh, over all bins; each round is one pass of means."""
    k = data.k
    u, s, _ = np.linalg.svd(data.mean(lambda x: x @ x.T))
    white = u @ np.diag(1 / np.sqrt(np.maximum(s, 1e-12))) @ u.T
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((k, k)))[0]
    for _ in range(rounds):

        def moments(x: np.ndarray, w=w) -> np.ndarray:
            y = white @ x
            g = np.tanh(w @ y)
            return np.vstack([g @ y.T, np.diag((1 - g * g).sum(axis=1))])

        m = data.mean(moments)
        new = m[:k] - m[k:] @ w
        a, _, b = np.linalg.svd(new)
        new = a @ b
        done = np.max(np.abs(np.abs(np.diag(new @ w.T)) - 1)) < tol
        w = new
        if done:
            break
    return (w @ white).T


def assembly_activity(patterns: DataFrame, z: DataFrame, unit: str = "unit", index: str = "bin", value: str = "z", zero_diagonal: bool = True) -> DataFrame:
    """(assembly, bin, activity) = (sum w z)^2 less the units' own share: one pass of sums."""
    wz = F.col("weight") * F.col(value)
    g = z.join(patterns, unit).groupBy("assembly", index).agg(F.sum(wz).alias("_s"), F.sum(wz * wz).alias("_d"))
    return g.select("assembly", index, (F.col("_s") * F.col("_s") - (F.col("_d") if zero_diagonal else F.lit(0.0))).alias("activity"))


def cross_area_activity(patterns: DataFrame, z: DataFrame, groups: DataFrame, unit: str = "unit", index: str = "bin", value: str = "z") -> DataFrame:
    """(assembly, bin, activity): product of the standardised projections of the two groups of units (unit, grp)."""
    x = z.join(patterns, unit).join(groups, unit).groupBy("assembly", "grp", index).agg(F.sum(F.col("weight") * F.col(value)).alias("_p"))
    m = x.groupBy("assembly", "grp").agg(F.avg("_p").alias("_m"), F.stddev_pop("_p").alias("_s"))
    x = x.join(m, ["assembly", "grp"]).withColumn("_z", F.coalesce(F.try_divide(F.col("_p") - F.col("_m"), F.col("_s")), F.lit(0.0)))
    return x.groupBy("assembly", index).agg(F.product("_z").alias("activity"))


def members(patterns: DataFrame) -> DataFrame:
    """Patterns with ``member``: |weight| above Otsu's threshold, which parts them with the largest variance between."""
    own = Window.partitionBy("assembly")
    o = own.orderBy("_a", "unit")
    x = patterns.withColumn("_a", F.abs("weight")).withColumn("_i", F.row_number().over(o)).withColumn("_n", F.count(F.lit(1)).over(own))
    x = x.withColumn("_s", F.sum("_a").over(o.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.sum("_a").over(own))
    lo, hi = F.col("_s") / F.col("_i"), F.try_divide(F.col("_t") - F.col("_s"), F.col("_n") - F.col("_i"))
    between = F.col("_i") * (F.col("_n") - F.col("_i")) * (lo - hi) * (lo - hi)
    cut = x.withColumn("_b", between).groupBy("assembly").agg(F.max_by("_a", F.struct("_b", -F.col("_i"))).alias("_cut"))
    return x.join(cut, "assembly").withColumn("member", F.col("_a") > F.col("_cut")).select(*patterns.columns, "member")


def cross_structural_covariance(z: DataFrame, groups: DataFrame, unit: str = "unit", index: str = "bin", value: str = "z", blocks: int | None = None) -> DataFrame:
    """(unit, unit2, cov) of units of different groups that share a bin, with a row a unit and bin.

    Pairs meet by blocks of units, a matrix product each, so that no row a pair
    and bin is made.
    """
    import pyarrow as pa

    from .correlate import _aligned, _block_pairs, _packed

    rows = _packed(z, index, value, unit).join(groups.select(unit, F.col("grp").alias("_g")), unit)
    kind = dict(z.dtypes)[unit]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        u, w = a[unit].to_numpy(), b[unit].to_numpy()
        (x, on_x, in_x), (y, on_y, in_y) = _aligned(a["_v"], b["_v"])
        met, n = in_x @ in_y.T, on_x @ on_y.T
        g, h = (pa.concat_tables([t.select(["_g"]) for t in (a, b)])["_g"].combine_chunks().dictionary_encode().indices.to_numpy()[s] for s in (slice(0, len(u)), slice(len(u), None)))
        keep = (met > 0) & (g[:, None] != h[None, :])
        if a["_i"][0] == b["_j"][0]:
            keep &= u[:, None] < w[None, :]
        i, j = np.nonzero(keep)
        up, of = u[i] < w[j], a.schema.field(unit).type
        some = n[i, j] > 0
        cov = (x @ y.T)[i, j] / np.where(some, n[i, j], 1.0)
        return pa.table({unit: pa.array(np.where(up, u[i], w[j]), of), "unit2": pa.array(np.where(up, w[j], u[i]), of), "cov": pa.array(cov, mask=~some)})

    return _block_pairs(rows, [], unit, blocks, run, f"{unit} {kind}, unit2 {kind}, cov double")


def null_eigenvalues(z: DataFrame, n_shuffles: int, n_bins: int, kind: str = "circular", seed: int = 0, unit: str = "unit", index: str = "bin", value: str = "z") -> list[float]:
    """Largest eigenvalues with each unit's bins rolled or in an order of its own, all shuffles in one job (:mod:`.nulls`)."""
    from .nulls import largest_eigenvalues

    got = largest_eigenvalues(z, n_shuffles, n_bins, kind, seed, unit, index, value).collect()  # a number for each shuffle
    return [r["values"][0] for r in sorted(got, key=lambda r: r["shuffle"])]


def scaled_by_group(z: DataFrame, groups: DataFrame, unit: str = "unit", value: str = "z") -> DataFrame:
    """Values over the root of the number of units in their group (unit, grp), so that groups weigh alike."""
    n = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    return z.join(groups.join(n, "grp").select(unit, "_n"), unit).withColumn(value, F.col(value) / F.sqrt("_n")).drop("_n")


def cross_group_patterns(patterns: DataFrame, groups: DataFrame, threshold: float = 1e-12, mode: str = "absolute", percentile: float = 95.0, unit: str = "unit") -> DataFrame:
    """Patterns with weights above a threshold in at least two groups of units: an ``absolute`` one, a share of the largest (``relative``), or a ``percentile``."""
    own = patterns.withColumn("_a", F.abs("weight"))
    cut = {"absolute": F.lit(threshold), "relative": F.max("_a") * threshold, "percentile": F.percentile("_a", F.lit(percentile / 100))}[mode]
    cut = own.groupBy("assembly").agg(cut.alias("_cut")) if mode != "absolute" else own.select("assembly").distinct().withColumn("_cut", cut)
    on = own.join(cut, "assembly").where(F.col("_a") > F.col("_cut")).join(groups, unit)
    keep = on.groupBy("assembly").agg(F.countDistinct("grp").alias("_g")).where("_g >= 2").select("assembly")
    return patterns.join(keep, "assembly", "left_semi")


def cross_svd_significance(z: DataFrame, groups: DataFrame, n_shuffles: int, percentile: float = 95.0, mode: str = "per_rank", seed: int = 0, unit: str = "unit", index: str = "bin", value: str = "z") -> DataFrame:
    """(component, singular, threshold, significant) of :func:`cross_svd` against bins in one order for all units of a group, all shuffles in one job.

    ``max_stat`` compares all components with the largest of each shuffle.
    Bins are numbered from 0 on.
    """
    from .nulls import cross_singular_values

    seen = [r["singular"] for r in cross_svd(z, groups, None, unit, index, value).select("component", "singular").distinct().orderBy("component").collect()]  # as many as units at most
    of = {r[unit]: r["grp"] for r in groups.select(unit, "grp").distinct().collect()}  # a row a unit, as the matrix has
    n_bins = int(z.agg(F.max(index)).first()[0]) + 1
    null = np.array([r["values"] for r in cross_singular_values(z, of, n_shuffles, n_bins, seed, unit, index, value).collect()])  # shuffles x components
    cut = np.full(len(seen), np.percentile(null.max(axis=1), percentile)) if mode == "max_stat" else np.percentile(null, percentile, axis=0)
    rows = [(k, float(s), float(c), bool(s > c)) for k, (s, c) in enumerate(zip(seen, cut, strict=True))]
    return z.sparkSession.createDataFrame(rows, "component int, singular double, threshold double, significant boolean")


# explained variance


def explained_variance_windows(template: DataFrame, control: DataFrame, matching: DataFrame, unit: str = "unit") -> DataFrame:
    """(window, ev, rev, ev_std, rev_std): of each matching window, over all control windows, from pair correlations (window, unit, unit2, r) and a template (unit, unit2, r).

    Squared partial correlations of each control and matching window; their
    mean and deviation over control windows.
    """
    t = template.select(unit, "unit2", F.col("r").alias("task"))
    c = control.select(F.col("window").alias("_c"), unit, "unit2", F.col("r").alias("pre"))
    m = matching.select("window", unit, "unit2", F.col("r").alias("post"))
    each = explained_variance(m.join(c, [unit, "unit2"]).join(t, [unit, "unit2"]), keys=["window", "_c"])
    return each.groupBy("window").agg(F.avg("ev").alias("ev"), F.avg("rev").alias("rev"), F.stddev_pop("ev").alias("ev_std"), F.stddev_pop("rev").alias("rev_std"))


def explained_variance_windows_of(series: DataFrame, index: str, value: str, window: str, task, controls: Sequence, matching: Sequence, unit: str = "unit", blocks: int | None = None) -> DataFrame:
    """Like :func:`explained_variance_windows` for dense series (window, unit, index), with the windows named: pairs of units meet by blocks and leave sums only, so no row a pair is made."""
    import pyarrow as pa

    from .correlate import _block_product, _rows_of, _scores

    names = [task, *controls, *matching]
    z = _scores(series.where(F.col(window).isin(names)), index, value, [window, unit])
    of = lambda p: F.first(F.when(F.col(window) == p, F.col("_z")), ignorenulls=True)
    rows = z.groupBy(unit).agg(*[of(p).alias(f"z{k}") for k, p in enumerate(names)]).dropna()
    sums = ["n", "a", "b", "c", "aa", "bb", "cc", "ab", "bc", "ac"]
    c_at, m_at = range(1, 1 + len(controls)), range(1 + len(controls), len(names))

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        u, w = x[unit].to_numpy(), y[unit].to_numpy()
        keep = u[:, None] < w[None, :] if x["_i"][0] == y["_j"][0] else np.ones((len(u), len(w)), bool)
        r = []
        for k in range(len(names)):
            p, q = _rows_of(x[f"z{k}"]), _rows_of(y[f"z{k}"])
            r.append((p @ q.T / max(p.shape[1], 1))[keep])
        on = [np.isfinite(v) for v in r]
        out = []
        for m in m_at:
            for c in c_at:
                ok = on[0] & on[c] & on[m]
                pre, t, post = r[c][ok], r[0][ok], r[m][ok]
                out.append([m, c, len(t), pre.sum(), t.sum(), post.sum(), pre @ pre, t @ t, post @ post, pre @ t, t @ post, pre @ post])
        cols = list(zip(*out, strict=True))
        return pa.table({"_m": pa.array(cols[0], pa.int32()), "_c": pa.array(cols[1], pa.int32())} | {k: pa.array([float(v) for v in col]) for k, col in zip(sums, cols[2:], strict=True)})

    total = _block_product(rows, [], unit, blocks, run, "_m int, _c int, " + ", ".join(f"{k} double" for k in sums), 1000)
    total = total.groupBy("_m", "_c").agg(*[F.sum(k).alias(k) for k in sums]).where("n > 0")
    mean = lambda k: F.try_divide(F.col(k), F.col("n"))
    r = lambda x, y, xy: F.try_divide(mean(xy) - mean(x) * mean(y), F.sqrt((mean(x + x) - mean(x) * mean(x)) * (mean(y + y) - mean(y) * mean(y))))
    tp, tr, pr = r("b", "c", "bc"), r("a", "b", "ab"), r("a", "c", "ac")
    part = lambda x, y, z: (x - y * z) / (F.sqrt((1 - y * y) * (1 - z * z)) + 1e-10)
    each = total.select("_m", F.pow(part(tp, tr, pr), F.lit(2)).alias("ev"), F.pow(part(tr, tp, pr), F.lit(2)).alias("rev"))
    got = each.groupBy("_m").agg(F.avg("ev").alias("ev"), F.avg("rev").alias("rev"), F.stddev_pop("ev").alias("ev_std"), F.stddev_pop("rev").alias("rev_std"))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("_m") + 1).cast(series.schema[window].dataType)
    return got.select(name.alias("window"), "ev", "rev", "ev_std", "rev_std")


def explained_variance_p(pairs: DataFrame, n_shuffles: int, pre: str = "pre", task: str = "task", post: str = "post", seed: int = 0, unit: str = "unit") -> DataFrame:
    """(ev, p): explained variance against the template's correlations dealt to other pairs, all shuffles in one job."""
    from .nulls import dealt_pairs

    x = pairs.select(pre, task, post).dropna()
    seen = explained_variance(x, pre, task, post).select("ev")
    null = explained_variance(dealt_pairs(x, n_shuffles, [pre, post], task, seed), pre, task, post, ["_s"]).select(F.col("ev").alias("_n"))
    got = null.join(F.broadcast(seen), F.lit(True)).groupBy("ev")  # one row
    return got.agg(((F.sum((F.col("_n") > F.col("ev")).cast("int")) + 1) / (F.count("_n") + 1)).alias("p"))


def explained_variance(pairs: DataFrame, pre: str = "pre", task: str = "task", post: str = "post", keys: K = ()) -> DataFrame:
    """(keys, ev, rev) from pair correlations of three periods: squared partial correlations, and with pre and post exchanged."""
    x = pairs.where(" and ".join(f"{c} is not null" for c in (pre, task, post)))
    c = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    g = x.groupBy(*keys).agg(c(task, post).alias("_tp"), c(task, pre).alias("_tr"), c(post, pre).alias("_pr"))
    tp, tr, pr = F.col("_tp"), F.col("_tr"), F.col("_pr")
    eps = 1e-10
    part = lambda a, b, m: (a - b * m) / (F.sqrt((1 - b * b) * (1 - m * m)) + eps)
    return g.select(*keys, F.pow(part(tp, tr, pr), F.lit(2)).alias("ev"), F.pow(part(tr, tp, pr), F.lit(2)).alias("rev"))


#: Units of a block whose correlations with another block a task holds at once.
_SLICE = 128


def explained_variance_of(series: DataFrame, index: str, value: str, period: str, pre, task, post, unit: str = "unit", blocks: int | None = None) -> DataFrame:
    """(ev, rev) of dense series (period, unit, index): pairs of units meet by blocks and leave sums only, so no row a pair is made."""
    import pyarrow as pa

    from .correlate import _block_product, _rows_of, _scores

    z = _scores(series, index, value, [period, unit])
    of = lambda p: F.first(F.when(F.col(period) == p, F.col("_z")), ignorenulls=True)
    rows = z.groupBy(unit).agg(*[of(p).alias(n) for n, p in (("a", pre), ("b", task), ("c", post))]).dropna()
    names = ["n", "a", "b", "c", "aa", "bb", "cc", "ab", "bc", "ac"]

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        u, w = x[unit].to_numpy(), y[unit].to_numpy()
        both = [(_rows_of(x[c]), _rows_of(y[c])) for c in "abc"]
        sums = np.zeros(len(names))
        for at in range(0, len(u), _SLICE):  # a few units against the other block, so that no correlation is held for all pairs of a block
            r = [p[at : at + _SLICE] @ q.T / max(p.shape[1], 1) for p, q in both]
            keep = np.isfinite(r[0]) & np.isfinite(r[1]) & np.isfinite(r[2])
            if x["_i"][0] == y["_j"][0]:
                keep &= u[at : at + _SLICE, None] < w[None, :]
            a, b, c = (m[keep] for m in r)
            sums += [len(a), a.sum(), b.sum(), c.sum(), a @ a, b @ b, c @ c, a @ b, b @ c, a @ c]
        return pa.table({k: [float(v)] for k, v in zip(names, sums, strict=True)})

    total = _block_product(rows, [], unit, blocks, run, ", ".join(f"{k} double" for k in names)).agg(*[F.sum(k).alias(k) for k in names])
    m = lambda k: F.try_divide(F.col(k), F.col("n"))
    r = lambda x, y, xy: F.try_divide(m(xy) - m(x) * m(y), F.sqrt((m(x + x) - m(x) * m(x)) * (m(y + y) - m(y) * m(y))))
    tp, tr, pr = r("b", "c", "bc"), r("a", "b", "ab"), r("a", "c", "ac")
    part = lambda x, y, z: (x - y * z) / (F.sqrt((1 - y * y) * (1 - z * z)) + 1e-10)
    return total.select(F.pow(part(tp, tr, pr), F.lit(2)).alias("ev"), F.pow(part(tr, tp, pr), F.lit(2)).alias("rev"))


# landscapes and history


def potential_landscape(rows: DataFrame, state: Column, domain: Column, t: str, keys: K, zero: int) -> DataFrame:
    """(domain, state, potential): minus the running sum over states of the mean displacement, zero at the state ``zero``."""
    w = Window.partitionBy(*keys).orderBy(t)
    x = rows.withColumn("_s", state).withColumn("_d", domain).withColumn("_x", F.lead("value").over(w) - F.col("value"))
    m = x.where("_x is not null and _s is not null").groupBy("_d", "_s").agg(F.avg("_x").alias("_m"))
    own = Window.partitionBy("_d").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    p = m.withColumn("_p", -F.sum("_m").over(own))
    at = F.max(F.when(F.col("_s") == zero, F.col("_p"))).over(Window.partitionBy("_d"))
    return p.select(F.col("_d").alias("domain"), F.col("_s").alias("state"), (F.col("_p") - F.coalesce(at, F.lit(0.0))).alias("potential"))


def potential_landscape_nd(rows: DataFrame, axes: Sequence[str], states: Sequence[Column], domain: Column, t: str, keys: K) -> DataFrame:
    """(axis, s0, s1, ..., domain, n, gradient, potential) of each axis in the space of all axes.

    ``states`` bin the axes; the gradient is the mean step to the next row, the
    potential minus its running sum along the axis, over bins that hold rows.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    x = rows.withColumn("_d", domain)
    for i, (a, s) in enumerate(zip(axes, states, strict=True)):
        x = x.withColumn(f"s{i}", s).withColumn(f"_x{i}", F.lead(a).over(w) - F.col(a))
    names = [f"s{i}" for i in range(len(axes))]
    x = x.where(" and ".join([f"{n} is not null" for n in names] + ["_x0 is not null"]))
    m = x.groupBy("_d", *names).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"_x{i}").alias(f"_m{i}") for i in range(len(axes))])
    out = None
    for i in range(len(axes)):
        own = Window.partitionBy("_d", *[n for n in names if n != f"s{i}"]).orderBy(f"s{i}").rowsBetween(Window.unboundedPreceding, 0)
        y = m.select(F.lit(i).alias("axis"), *names, F.col("_d").alias("domain"), "n", F.col(f"_m{i}").alias("gradient"), (-F.sum(f"_m{i}").over(own)).alias("potential"))
        out = y if out is None else out.unionByName(y)
    return out


def trial_covariates(rows: DataFrame, features: Sequence[str], labels: Sequence[str], trial: str, order: str, before: int, after: int = 0, current: int = 1) -> DataFrame:
    """(trial, order, labels, history): features of the bins from ``before`` back to ``after`` ahead, flat, never across trials; bins without all of them are left out.

    ``current`` 0 leaves the bin itself out.
    """
    w = Window.partitionBy(trial).orderBy(order)
    steps = [k for k in range(-before, after + 1) if k or current]
    bins = [F.lead(F.array(*[F.col(f).cast("double") for f in features]), k).over(w) if k > 0 else F.lag(F.array(*[F.col(f).cast("double") for f in features]), -k).over(w) if k else F.array(*[F.col(f).cast("double") for f in features]) for k in steps]
    x = rows.select(trial, order, *labels, F.array(*bins).alias("_h"))
    return x.where(F.forall("_h", lambda b: b.isNotNull())).select(trial, order, *labels, F.flatten("_h").alias("history"))


def mini_batches(rows: DataFrame, size: int, key: Sequence[str], seed: int | None = None, drop_last: bool = False) -> DataFrame:
    """Adds ``batch``: rows in a hashed order, or that of the key, in batches of about ``size``.

    Rows are dealt to shards by a hash and numbered inside their shard, so no
    window spans the table; batches of a hashed order never mix shards.
    """
    n = rows.count()
    shards = 1 if seed is None else max(1, n // max(size * 64, 1))
    h = F.xxhash64(*key, F.lit(seed or 0))
    shard = F.pmod(h, F.lit(shards))
    w = Window.partitionBy("_sh").orderBy(*([h] if seed is not None else []), *key)
    x = rows.withColumn("_sh", shard).withColumn("_k", F.floor((F.row_number().over(w) - 1) / size))
    x = x.withColumn("batch", F.struct("_sh", "_k"))
    if drop_last:
        x = x.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_sh", "_k"))).where(F.col("_n") == size).drop("_n")
    return x.withColumn("batch", F.col("_sh") * F.lit(n // size + 1) + F.col("_k")).drop("_sh", "_k")


def shuffled_within(rows: DataFrame, values: Sequence[str], trial: str, order: str, seed: int = 0) -> DataFrame:
    """Rows whose values, together, have moved to another place of the same trial, by a hashed order."""
    own = Window.partitionBy(trial)
    x = rows.withColumn("_i", F.row_number().over(own.orderBy(order))).withColumn("_j", F.row_number().over(own.orderBy(F.xxhash64(trial, order, F.lit(seed)), order)))
    moved = x.select(trial, F.col("_j").alias("_i"), F.struct(*values).alias("_v"))
    return x.drop(*values, "_j").join(moved, [trial, "_i"]).select(*[F.col(f"_v.{c}").alias(c) if c in values else F.col(c) for c in rows.columns])


def history_features(rows: DataFrame, value: str, order: str, before: int, after: int, keys: K = ("unit",)) -> DataFrame:
    """Adds ``history``: the values from ``before`` rows back to ``after`` rows ahead; null where any is missing."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, after)
    x = rows.withColumn("_h", F.collect_list(value).over(w))
    return x.withColumn("history", F.when(F.size("_h") == before + after + 1, F.col("_h"))).drop("_h")


def k_folds(rows: DataFrame, k: int, label: str, key: str, seed: int = 0) -> DataFrame:
    """Adds ``fold`` 0 .. k-1, balanced within each label, in a hashed order."""
    w = Window.partitionBy(label).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return rows.withColumn("fold", F.pmod(F.row_number().over(w) - 1, F.lit(k)))


def split_of_fold(fold: Column, test: int, k: int) -> Column:
    """Train, validation or test for a rotation of the folds."""
    return F.when(fold == test, "test").when(fold == (test + 1) % k, "validation").otherwise("train")


def standardise(rows: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """Columns on the training rows' mean and deviation; constant ones become 0."""
    m = rows.where(train).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    x = rows.join(F.broadcast(m), F.lit(True))  # one row
    for c in columns:
        x = x.withColumn(c, F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0))
    return x.drop(*[f"_{p}_{c}" for c in columns for p in "ms"])


def regression_scores(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(r2, rmse) in one pass."""
    e = F.col(truth) - F.col(predicted)
    return rows.agg((1 - F.try_divide(F.avg(e * e), F.var_pop(truth))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"))


def cross_svd(z: DataFrame, groups: DataFrame, n_components: int | None = None, unit: str = "unit", index: str = "bin", value: str = "z") -> DataFrame:
    """(component, unit, grp, weight, singular): singular vectors of the covariance between two groups of units (unit, grp)."""
    units, m, _ = correlation_matrix(z, unit, index, value)
    of = {r[unit]: r["grp"] for r in groups.select(unit, "grp").distinct().collect()}  # a row a unit, as the matrix has
    names = sorted({of[u] for u in units})
    if len(names) != 2:
        raise ValueError("there must be exactly two groups")
    a, b = ([i for i, u in enumerate(units) if of[u] == g] for g in names)
    u, s, v = np.linalg.svd(m[np.ix_(a, b)], full_matrices=False)
    k = len(s) if n_components is None else min(n_components, len(s))
    rows = [(c, units[i], str(names[0]), float(u[j, c]), float(s[c])) for c in range(k) for j, i in enumerate(a)]
    rows += [(c, units[i], str(names[1]), float(v[c, j]), float(s[c])) for c in range(k) for j, i in enumerate(b)]
    return z.sparkSession.createDataFrame(rows, f"component int, {unit} {dict(z.dtypes)[unit]}, grp string, weight double, singular double")


def best_pairs(similarity: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs of rows and columns of a small matrix with the largest total (shortest augmenting paths)."""
    flip = similarity.shape[0] > similarity.shape[1]
    cost = -(similarity.T if flip else similarity)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            cur = cost[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = cur < low[free]
            low[free[better]], way[free[better]] = cur[better], j0
            j1 = free[np.argmin(low[free])]
            d = low[j1]
            u[match[used]] += d
            v[used] -= d
            low[~used] -= d
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def planted_assemblies(spark, members: Sequence[Sequence[int]], n_units: int = 10, n_bins: int = 1000, rate: float = 1.0, strength: float = 5.0, share: float = 0.05, seed: int = 42) -> DataFrame:
    """(unit, bin, n): Poisson counts with groups of units that fire together in a share of the bins; made by the executors."""
    u = spark.range(n_units).select(F.col("id").cast("int").alias("unit"))
    x = spark.range(n_bins).select(F.col("id").cast("int").alias("bin")).withColumn("_k", F.lit(0)).join(F.broadcast(u.withColumn("_k", F.lit(0))), "_k").drop("_k")  # n_units rows
    mean = F.lit(rate)
    for k, group in enumerate(members):
        on = F.pmod(F.xxhash64("bin", F.lit(k), F.lit(seed)), F.lit(10_000)) < int(share * 10_000)
        mean = mean + F.when(F.col("unit").isin(list(group)) & on, strength * rate).otherwise(0.0)
    spread = F.sqrt(mean) * F.randn(seed)
    return x.select("unit", "bin", F.greatest(F.round(mean + spread), F.lit(0.0)).alias("n"))
