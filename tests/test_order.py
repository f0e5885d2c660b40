import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import order


def values(spark, groups):
    return spark.createDataFrame([(k, None if x is None else float(x)) for k, v in groups.items() for x in v], "k string, x double").repartition(6)


def one_group(x, modes=None):
    """The scan over all values at once."""
    x = np.sort(x)
    n = len(x)
    f = np.arange(1, n + 1) / n
    best = np.inf
    for m in order.modes_tried(n):
        left, right = max(x[m] - x[0], 1e-12), max(x[-1] - x[m], 1e-12)
        u = np.where(x <= x[m], (x - x[0]) / left * (m / n), m / n + (x - x[m]) / right * (1 - m / n))
        best = min(best, np.abs(f - np.clip(u, 0, 1)).max())
    return best


def test_ranks_go_on_from_partition_to_partition(spark):
    rng = np.random.default_rng(1)
    groups = {"big": rng.normal(size=5000), "equal": np.zeros(3000), "one": [4.0], None: rng.integers(0, 5, 700)}
    got = order.ranked(values(spark, groups), "x", ["k"]).toPandas()
    for k, v in groups.items():
        own = got[got["k"].isna() if k is None else got["k"] == k].sort_values("rank")
        assert own["rank"].tolist() == list(range(len(v))) and set(own["n"]) == {len(v)}
        assert own["x"].tolist() == sorted(v)


def test_frequent_values_are_spread(spark):
    df = values(spark, {"a": [1.0] * 20_000})
    x = order.ranked(df, "x", ["k"])
    assert x.count() == 20_000
    sizes = x.groupBy(F.floor(F.col("rank") / 5000)).count().collect()
    assert [r["count"] for r in sizes] == [5000] * 4


def test_quantiles_equal_percentile(spark):
    rng = np.random.default_rng(2)
    df = values(spark, {"a": rng.normal(size=999), "b": [3.0, 1.0], "c": [7.0], "d": rng.integers(0, 3, 100), "e": [None], "f": [None, 2.0]})
    probs = [0.0, 0.05, 0.5, 0.777, 1.0]
    got = {(r.k, r.prob): r.x for r in order.quantiles(df, "x", probs, ["k"]).collect()}
    want = df.groupBy("k").agg(*[F.percentile("x", F.lit(p)).alias(str(p)) for p in probs]).collect()
    assert got == pytest.approx({(r.k, p): r[str(p)] for r in want for p in probs if r[str(p)] is not None})


def test_dip_of_split_keys_equals_one_group(spark):
    rng = np.random.default_rng(3)
    groups = {
        "one": rng.standard_normal(500), "two": np.concatenate([rng.normal(-6, 0.3, 300), rng.normal(6, 0.3, 300)]), "large": np.concatenate([rng.normal(0, 1, 4000), rng.normal(7, 1, 3000)]),
        "ties": rng.integers(0, 6, 2500), "flat": np.ones(40), "few": [1.0, 2.0], "three": [1.0, 2.0, 9.0], "holes": [*rng.standard_normal(50), None, float("nan")],
    }
    got = {r.k: r for r in order.dip_test(values(spark, groups), "x", ["k"], n_boot=50).collect()}
    for k, v in groups.items():
        v = np.array([x for x in v if x is not None and not np.isnan(x)])
        assert got[k].n == len(v)
        assert got[k].dip == pytest.approx(one_group(v) if len(v) >= 3 else 0.0, abs=1e-12), k
    assert got["one"].p > 0.05 and got["two"].dip > 0.05 and got["two"].p < 0.05 and got["few"].p == 1.0


def test_hulls_hold_the_furthest_points():
    rng = np.random.default_rng(4)
    x, f = np.sort(rng.normal(size=400)), np.arange(1, 401) / 400
    c = order._corners(x, f)
    assert len(c) < 60
    for _ in range(50):
        a, b = rng.normal(size=2)
        assert np.abs(f - a * x - b).max() == pytest.approx(np.abs(f[c] - a * x[c] - b).max())


def test_nothing(spark):
    df = values(spark, {"a": [None]})
    assert order.quantiles(df, "x", [0.5], ["k"]).count() == 0
    assert order.dip_test(df, "x", ["k"]).count() == 0


def test_two_modes_are_further_than_normal_samples():
    """Known case: two groups of 300 around -3 and 3, spread 0.5."""
    rng = np.random.default_rng(7)
    x = np.sort(np.concatenate([rng.normal(-3, 0.5, 300), rng.normal(3, 0.5, 300)]))
    d = order.furthest(x, np.arange(1, 601) / 600, np.arange(600), 600)
    assert d > 0.05 and (order._null(600, 50, 321) >= d).mean() < 0.05
