import hashlib

import duckdb
import numpy as np
import pytest

from pulsegrid.llm import sort_means

SCHEMA = "label int, vec_id long, embedding array<float>, cluster string"


def brute(rows, k, rounds, dim):
    kept = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1].tolist()))[:k]
    centres = [r[1].tolist() for r in start]
    for t in range(rounds + 1):
        got = [min((sum((int(a) - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres)) for _, x in kept]
        if t < rounds:
            for j in range(len(centres)):
                own = [x for (_, x), g in zip(kept, got) if g[1] == j]
                if own:
                    centres[j] = [sum(int(x[i]) for x in own) // len(own) for i in range(dim)]
    inertia = [sum(d for d, c in got if c == j) for j in range(len(centres))]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((-1 if i is None else i), c, d, inertia[c], sum(inertia), name[c]) for (i, _), (d, c) in zip(kept, got))


def table(rng, n, dim=64):
    rows = [(i, (rng.normal(size=dim) / 8 + (i % 5 == 0)).tolist()) for i in range(n)]
    rows += [(0, rows[0][1]), (None, rows[1][1]), (n, [0.5] * dim), (n + 1, [0.5] * dim)]
    rows += [(n + 2, None), (n + 3, [1.0] * (dim - 1)), (n + 4, []), (n + 5, [None] + [0.0] * (dim - 1)), (n + 6, [float("nan")] * dim), (n + 7, [float("inf")] * dim)]
    return rows


def as_rows(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("n", [120, 3])
def test_equals_plain_rounds(spark, n):
    rows = table(np.random.default_rng(n), n)
    df = spark.createDataFrame([(1, i, v, "x") for i, v in rows], SCHEMA).repartition(5)
    assert as_rows(sort_means.cluster(df, rounds=4)) == brute(rows, 8, 4, 64)


def test_lists_are_cut_but_answers_stay():
    rng = np.random.default_rng(1)
    centres = rng.integers(-900, 900, (40, 6))
    x = centres[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 6))
    order, far = sort_means.orders(centres)
    before = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    shifted = centres + rng.integers(-20, 20, centres.shape)
    order, far = sort_means.orders(shifted)
    cluster, best, taken = sort_means.nearest(x, before, shifted, order, far)
    d = ((x[:, None] - shifted[None]) ** 2).sum(2)
    assert (cluster == d.argmin(1)).all() and (best == d.min(1)).all()
    assert taken < 0.3 * d.size


def test_ties_go_to_the_smaller_number_at_exactly_twice_the_distance():
    centres = np.array([[4, 0], [0, 0], [4, 0]])
    cluster, best, _ = sort_means.nearest(np.array([[2, 0], [4, 0]]), np.array([1, 2]), centres, *sort_means.orders(centres))
    assert cluster.tolist() == [0, 0] and best.tolist() == [4, 0]


def test_nothing_kept(spark):
    df = spark.createDataFrame([(1, 1, [1.0], "x")], SCHEMA)
    got = sort_means.cluster(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0
    assert sort_means.cluster(df.limit(0)).count() == 0


def test_sql_says_the_same(spark):
    rows = table(np.random.default_rng(7), 60)
    df = spark.createDataFrame([(1, i, v, "x") for i, v in rows], SCHEMA)
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in con.sql(sort_means.sql(rounds=3)).fetchall())
    assert got == as_rows(sort_means.cluster(df, rounds=3))
