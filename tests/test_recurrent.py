import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import recurrent as rc


@pytest.mark.parametrize(("many", "layers", "classes"), [(False, 1, False), (True, 2, False), (False, 2, True), (True, 1, True)])
def test_gradients_are_those_of_the_loss(many, layers, classes):
    rng = np.random.default_rng(1)
    net = rc.Network(3, 2, hidden=4, layers=layers, many=many, classes=classes)
    x = rng.normal(size=(5, 6, 3))
    y = rng.normal(size=(5, 6, 2) if many else (5, 2))
    if classes:
        y = np.eye(2)[rng.integers(0, 2, y.shape[:-1])]
    _, g = net.gradient(x, y)
    w = net.flat()
    for i in rng.choice(len(w), 40, replace=False):
        e = np.zeros(len(w))
        e[i] = 1e-6
        up, down = (net.moved(w + s * e).gradient(x, y)[0] for s in (1, -1))
        assert g[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


def data(rng, n=240, length=5):
    x = rng.normal(size=(n, length, 2))
    y = np.c_[x[:, -1, 0] + 0.5 * x[:, -2, 1], x.sum((1, 2)) / 5]
    return x, y


def test_training_equals_one_process_with_the_same_batches(spark):
    x, y = data(np.random.default_rng(2))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "id int, x array<array<double>>, y array<double>").repartition(6)
    net = rc.Network(2, 2, hidden=6)
    got, losses = rc.fit(df, net, epochs=3, batches=3, rate=0.03, by=F.col("id"))
    w, adam, want = net.flat(), rc.Adam(net.flat().size, 9, 0.03), []
    for _ in range(3):
        for b in range(3):
            loss, g = net.moved(w).gradient(x[b::3], y[b::3])
            want.append(loss / 80)
            w = adam.step(w, g / 80)
    assert losses == pytest.approx(want, rel=1e-9) and got.flat() == pytest.approx(w, rel=1e-6, abs=1e-9)
    assert losses[-1] < losses[0]
    told = rc.predict(df, got).orderBy("id").collect()
    assert np.array([r.told for r in told]) == pytest.approx(got.predict(x), rel=1e-9)


def test_many_to_many_learns_a_running_sum(spark):
    rng = np.random.default_rng(3)
    rows = [(s, i, float(v)) for s in range(12) for i, v in enumerate(rng.normal(size=43))]
    df = spark.createDataFrame(rows, "session int, t int, v double").withColumn("y", F.lag("v", 1, 0.0).over(rc.Window.partitionBy("session").orderBy("t")))
    w = rc.windows(df, ["v"], ["y"], 10, "t", many=True)
    assert w.count() == 48 and w.where("session = 0").count() == 4
    first = w.where("session = 3").orderBy("t").first()
    assert [a[0] for a in first.x] == [r[2] for r in rows if r[0] == 3][:10] and len(first.y) == 10
    _, losses = rc.fit(w, rc.Network(1, 1, hidden=8, many=True), epochs=6, batches=2, rate=0.1)
    assert np.mean(losses[-2:]) < 0.7 * losses[0]


def test_windows_and_folds(spark):
    df = spark.createDataFrame([("a", i, float(i), float(i % 2)) for i in range(30)], "session string, t int, v double, c double")
    w = rc.windows(df, ["v"], ["c"], 4, "t")
    assert w.count() == 27
    assert [a[0] for a in w.orderBy("t").first().x] == [0.0, 1.0, 2.0, 3.0]
    got = rc.folds(w.withColumn("x", F.transform("x", lambda a: F.transform(a, lambda v: v / 30))), rc.Network(1, 1, hidden=3), F.col("t") % 2, 2, epochs=1, batches=2).collect()
    assert [(r.fold, r.n) for r in got] == [(0, 13), (1, 14)] and all(np.isfinite(r.loss) for r in got)


def test_classes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 4, 2))
    c = (x[:, -1, 0] > 0).astype(int)
    df = spark.createDataFrame([(a.tolist(), np.eye(2)[k].tolist()) for a, k in zip(x, c)], "x array<array<double>>, y array<double>")
    net, losses = rc.fit(df, rc.Network(2, 2, hidden=6, classes=True), epochs=6, batches=2, rate=0.1)
    assert (net.predict(x).argmax(1) == c).mean() > 0.8 and losses[-1] < losses[0]
