"""Centroid clustering by sort-means, in whole numbers.

Vectors become integers, so distances, sums and centroids are exact and do not
depend on how Spark cuts the table. In each round every centroid lists the
others by their distance from it; a vector starts at the centroid it had and
reads that list only up to those strictly beyond twice its own distance, since
no centroid further away can be nearer (a tie must be strictly within reach).

One round is one pass without a shuffle: tasks rewrite their vectors with the
new assignment and add their sums, a few rows of ``k`` x dimension numbers for
each task, which Spark adds up. The driver holds ``k`` centroids, never a
vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import dropped, staged

#: Whole numbers beyond this have squared distances that a long cannot hold.
REACH = 1 << 27
#: Vectors that are worked on at once.
SLICE = 4096

_DDL = "is_sum boolean, vec_id long, point binary, cluster int, distance long, n long, total array<long>"
_SCHEMA = pa.schema([("is_sum", pa.bool_()), ("vec_id", pa.int64()), ("point", pa.binary()), ("cluster", pa.int32()), ("distance", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])


def points(vectors: DataFrame, dim: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id and ``point``, the array of floor(scale * component).

    Vectors that are null, of another length, or hold a null or non-finite
    component are left out, and so is one with a number beyond ``REACH`` (its
    distances would not fit a long). Repeated rows each stay; a null vec_id
    stays null; other columns are ignored.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.where((F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < float(REACH))))
    return v.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("point"))


def first_centroids(pts: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The points with the smallest sha256 of ``seed:vec_id``; rows of one vec_id come by their components. Fewer points give fewer centroids."""
    lot = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [list(r.point) for r in pts.where("vec_id is not null").select("point", lot.alias("lot")).orderBy("lot", "point").limit(k).collect()]


def orders(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid all centroids by squared distance from it (itself first), and those distances."""
    d = ((centres[:, None, :] - centres[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d, -1)
    order = np.argsort(d, axis=1, kind="stable")
    return order, np.maximum(np.take_along_axis(d, order, 1), 0)


def nearest(x: np.ndarray, before: np.ndarray, centres: np.ndarray, order: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Assignment, squared distance and the number of distances taken; ties go to the smaller number."""
    own = ((x - centres[before]) ** 2).sum(1)
    best, cluster, taken = own.copy(), before.copy(), len(x)
    for c in np.unique(before):
        at = np.flatnonzero(before == c)
        reach = np.searchsorted(far[c], 4 * own[at], side="right")  # lists end strictly beyond twice the distance
        for j in range(1, int(reach.max(initial=0))):
            at, reach = at[reach > j], reach[reach > j]
            other = int(order[c, j])
            d = ((x[at] - centres[other]) ** 2).sum(1)
            taken += len(at)
            wins = (d < best[at]) | ((d == best[at]) & (other < cluster[at]))
            best[at[wins]], cluster[at[wins]] = d[wins], other
    return cluster, best, taken


def _assigned(now: DataFrame, centres: np.ndarray) -> DataFrame:
    """The vectors with their new clusters, and each task's sums by cluster as rows of their own."""
    order, far = orders(centres)
    k, dim = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                ids, raw, before = (b.column(i).slice(at, SLICE) for i in range(3))
                x = np.frombuffer(b"".join(raw.to_pylist()), np.int32).reshape(-1, dim).astype(np.int64)
                cluster, distance, _ = nearest(x, before.to_numpy(zero_copy_only=False).astype(np.int64), centres, order, far)
                for c in np.unique(cluster):
                    n[c] += (cluster == c).sum()
                    total[c] += x[cluster == c].sum(0)
                none = pa.nulls(len(x), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), bool)), ids, raw, pa.array(cluster.astype(np.int32)), pa.array(distance), none, pa.nulls(len(x), pa.list_(pa.int64()))], schema=_SCHEMA)
        used = np.flatnonzero(n)
        none = pa.nulls(len(used), pa.int64())
        sums = pa.array(total[used].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(used), bool)), none, pa.nulls(len(used), pa.binary()), pa.array(used.astype(np.int32)), none, pa.array(n[used]), sums], schema=_SCHEMA)

    return now.select("vec_id", "point", "cluster").mapInArrow(run, _DDL)


def _moved(done: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Exact floor of the mean of each non-empty cluster; k x dimension numbers come to the driver."""
    parts = done.where("is_sum").select("cluster", "n", F.posexplode("total").alias("i", "s"))
    sums = parts.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(28,0)")).alias("s"), F.sum("n").alias("n"))
    out = centres.copy()
    for r in sums.collect():
        out[r.cluster, r.i] = int(r.s) // r.n
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", dim: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every kept vector.

    ``points`` says which vectors are kept; repeated rows each give a row, ties
    go to the smaller centroid, empty centroids stay where they are, and a
    table without a kept vector gives an empty result. Each round's table is
    written to the shared folder, so a lost executor costs its tasks only.
    """
    pts = points(vectors, dim, scale)
    to_bytes = lambda batches: (
        pa.RecordBatch.from_arrays([b.column(0), pa.array([np.asarray(p, np.int32).tobytes() for p in b.column(1).to_pylist()], pa.binary()), pa.array(np.zeros(b.num_rows, np.int32))], ["vec_id", "point", "cluster"]) for b in batches
    )
    centres = np.array(first_centroids(pts, k, seed), np.int64).reshape(-1, dim)
    now = staged(pts.mapInArrow(to_bytes, "vec_id long, point binary, cluster int"), "points")
    if not len(centres):
        return now.limit(0).select("vec_id", "cluster", *(F.lit(None).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    for r in range(rounds + 1):
        done = staged(_assigned(now, centres), "assigned")
        dropped(now)
        now = done.where("not is_sum")
        if r < rounds:
            centres = _moved(done, centres)
    sums = {r.cluster: int(r.s) for r in now.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s")).collect()}
    per = now.sparkSession.createDataFrame(
        [(c, sums.get(c, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for c, row in enumerate(centres)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return now.select("vec_id", "cluster", "distance").join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 8, rounds: int = 10, seed: str = "3", dim: int = 64, scale: int = 1024) -> str:
    """The same rounds as chained SQL, each vector against every centroid."""
    first = f"""p AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x) AND abs(CAST(x AS DOUBLE)) * {scale} < {REACH}]) = {dim}),
e AS MATERIALIZED (SELECT r, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM p),
s AS (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), v) - 1 AS c FROM p WHERE vec_id IS NOT NULL),
c0 AS MATERIALIZED (SELECT c, i, x FROM s JOIN e USING (r) WHERE c < {k})"""
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""d{t} AS (SELECT e.r, c{t}.c, sum((e.x - c{t}.x) * (e.x - c{t}.x)) AS d FROM e JOIN c{t} USING (i) GROUP BY e.r, c{t}.c),
a{t} AS MATERIALIZED (SELECT r, c, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS k FROM d{t}) WHERE k = 1)""")
        if t < rounds:
            steps.append(f"""m{t} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{t} JOIN e USING (r) GROUP BY c, i),
c{t + 1} AS MATERIALIZED (SELECT c{t}.c, c{t}.i, CASE WHEN n IS NULL THEN x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x FROM c{t} LEFT JOIN m{t} USING (c, i))""")
    last = f"""h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)
SELECT p.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.h AS centroid_sha256 FROM a{rounds} AS a JOIN p USING (r) JOIN h USING (c)"""
    return "WITH " + ",\n".join([first, *steps, last])
