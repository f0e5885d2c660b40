import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import ensemble as en, nulls


def dense(rng, units, n):
    x = rng.normal(size=(units, n))
    return (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)


def frame(spark, x):
    return spark.createDataFrame([(u, b, float(v)) for u, row in enumerate(x) for b, v in enumerate(row)], "unit int, bin int, z double").repartition(5)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 100, 1000, 4097])
def test_dealt_is_a_permutation(n):
    seen = set()
    for key in (0, 1, -5, 2**62):
        p = nulls.dealt(np.arange(n), n, key)
        assert sorted(p.tolist()) == list(range(n))
        seen.add(tuple(p))
    assert n < 5 or len(seen) == 4
    if n == 1000:
        assert abs(np.corrcoef(p, np.arange(n))[0, 1]) < 0.15


def test_rolled_units_equal_a_roll_in_memory(spark, monkeypatch):
    monkeypatch.setattr(nulls, "CHUNK", 64)
    monkeypatch.setattr(nulls, "STRETCH", 100)
    rng = np.random.default_rng(1)
    x = dense(rng, 6, 500)
    got = nulls.largest_eigenvalues(frame(spark, x), 4, 500, shift=F.col("unit") * 31 + F.col("_s") * 77).collect()
    assert len(got) == 4
    for r in got:
        y = np.array([np.roll(row, u * 31 + r.shuffle * 77) for u, row in enumerate(x)])
        assert r["values"] == pytest.approx([np.linalg.eigvalsh(y @ y.T / 500)[-1]])
    assert nulls.largest_eigenvalues(frame(spark, x), 1, 500, shift=F.lit(0)).first()["values"] == pytest.approx([np.linalg.eigvalsh(x @ x.T / 500)[-1]])


def test_orders_of_their_own_undo_what_ties_units(spark):
    rng = np.random.default_rng(2)
    x = dense(rng, 5, 600)
    x[1] = x[0]
    z = frame(spark, x)
    null = en.null_eigenvalues(z, 10, 600, "bins")
    assert len(set(null)) == 10 and max(null) < 1.5 < np.linalg.eigvalsh(x @ x.T / 600)[-1]
    groups = {0: "a", 1: "b", 2: "a", 3: "b", 4: "b"}
    m = x @ x.T / 600
    across = np.array([[groups[i] != groups[j] for j in range(5)] for i in range(5)])
    got = nulls.largest_eigenvalues(z, 1, 600, shift=F.lit(0), groups=groups).first()["values"]
    assert got == pytest.approx([np.linalg.eigvalsh(np.where(across, m, 0))[-1]])


def test_groups_stay_together(spark):
    rng = np.random.default_rng(3)
    a = dense(rng, 2, 400)
    x = np.concatenate([a, a])  # the second group repeats the first
    of = {0: "a", 1: "a", 2: "b", 3: "b"}
    got = nulls.cross_singular_values(frame(spark, x), of, 6, 400).collect()
    assert len(got) == 6 and all(len(r["values"]) == 2 and max(r["values"]) < 0.5 for r in got)
    groups = spark.createDataFrame(list(of.items()), "unit int, grp string")
    told = en.cross_svd_significance(frame(spark, x), groups, 12).orderBy("component").collect()
    assert [r.significant for r in told] == [True, True] and told[0].singular > 0.9


def test_values_are_dealt_once(spark):
    df = spark.createDataFrame([(float(i), float(-i), float(i * i)) for i in range(200)], "pre double, post double, task double").repartition(7)
    got = nulls.dealt_pairs(df, 5, ["pre", "post"], "task").toPandas()
    assert len(got) == 1000
    for _, g in got.groupby("_s"):
        assert sorted(g["task"]) == sorted(float(i * i) for i in range(200)) and len(set(g["pre"])) == 200
        assert (g["task"] == g["pre"] ** 2).mean() < 0.1
    orders = {tuple(g.sort_values("pre")["task"]) for _, g in got.groupby("_s")}
    assert len(orders) == 5
