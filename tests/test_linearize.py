import numpy as np
import pytest

from pulsegrid.operators import linearize as li

PLUS = [(0, 0.0, 0.0, 40.0, 0.0), (1, 40.0, 0.0, 80.0, 0.0), (2, 40.0, 0.0, 40.0, 40.0)]


def walk(rng, n, noise=3.0):
    """Runs along the arms of a T, with errors of tracking."""
    s = np.abs(np.cumsum(rng.normal(0, 2, n))) % 160
    arm = (np.arange(n) // 400) % 2
    x = np.where(s % 80 < 40, s % 80, np.where(arm == 1, 40, s % 80))
    y = np.where((s % 80 >= 40) & (arm == 1), s % 80 - 40, 0)
    return np.c_[x, y] + rng.normal(0, noise, (n, 2))


def one_pass(m, xy):
    """The whole session with a dense matrix, as the textbook has it."""
    n_states = len(m.lin)
    dense = np.full((n_states, n_states), -(1 << 50), np.int64)
    for j in range(n_states):
        ok = m.cost[j] > -(1 << 50)
        dense[m.before[j][ok], j] = m.cost[j][ok]
    e = li.scores(m, xy)
    v, back = e[0] - e[0].max(), []
    for i in range(1, len(xy)):
        c = v[:, None] + dense
        back.append(c.argmax(0))
        v = c.max(0) + e[i]
        v = np.maximum(v - v.max(), li.FLOOR)
    out = [int(v.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return np.array(out[::-1])


@pytest.mark.parametrize(("block", "margin", "sparse"), [(20.0, 0.5, True), (7.0, 4.0, True), (15.0, 1.0, False)])
def test_blocks_give_the_path_of_one_pass(spark, block, margin, sparse):
    rng = np.random.default_rng(int(block))
    rows, want = [], {}
    for session, n in (("a", 1500), ("b", 700), ("c", 1)):
        xy = walk(rng, n)
        t = np.arange(n) / 20 + (200.0 if session == "b" else 0.0) + np.where(np.arange(n) > 500, 90.0, 0.0)  # a pause of several blocks
        gone = rng.random(n) < 0.05 if n > 1 else np.zeros(n, bool)
        rows += [(session, float(a), None if g else float(x), None if g else float(y), i) for i, (a, (x, y), g) in enumerate(zip(t, xy, gone))]
        m = li.model(tuple(PLUS), 15, 4.0, 2.0, sparse)
        states = one_pass(m, xy[~gone])
        want |= {(session, i): (int(m.segment[s]), float(m.lin[s])) for i, s in zip(np.flatnonzero(~gone).tolist(), states)}
        want |= {(session, i): (None, None) for i in np.flatnonzero(gone).tolist()}
    df = spark.createDataFrame(rows, "session string, t double, x double, y double, i long").repartition(7)
    got = li.track_path(df, PLUS, per_segment=15, spread=4.0, stay=2.0, sparse=sparse, block=block, margin=margin).collect()
    assert {(r.session, r.i): (r.segment, r.lin) for r in got} == want and len(got) == len(want)


def test_steps_are_shares():
    m = li.model(tuple(PLUS), 20, 5.0, 1.2, True)
    steps = li.log_steps(PLUS, np.repeat(np.arange(3), 20), m.place, 1.2, True)
    assert np.allclose(np.exp(steps).sum(1), 1)
    assert np.isfinite(steps[19, 20:25]).all() and not np.isfinite(steps[19, 25:35]).any() and not np.isfinite(steps[0, 4])
    assert li.joined(PLUS).all()
    assert not li.joined([(0, 0, 0, 1, 0), (1, 5, 5, 6, 5)])[0, 1]


def test_tuning_recovers_what_was_planted(spark):
    rng = np.random.default_rng(2)
    rows = []
    for session, noise in (("still", 0.5), ("loose", 6.0)):
        on = rng.uniform(0, 80, 4000)
        rows += [(session, float(x), float(y)) for x, y in np.c_[on, np.zeros(4000)] + np.c_[np.zeros(4000), rng.normal(0, noise, 4000)]]
    rows += [("still", float("nan"), 1.0), ("still", None, 1.0)]
    got = {r.session: r for r in li.tune(spark.createDataFrame(rows, "session string, x double, y double"), PLUS[:2]).collect()}
    assert abs(got["still"].off_track - 0.5) < 0.03 and abs(got["loose"].off_track - 6.0) < 0.3
    assert got["still"].n == 4000 and got["still"].per_segment == 40 and got["still"].stay == 1.5 and got["still"].spread == 12.0
    tight = spark.createDataFrame([("s", 0.1 * i, 0.0) for i in range(50)], "session string, x double, y double")
    (r,) = li.tune(tight, [(0, 0.0, 0.0, 9.0, 0.0)]).collect()
    assert (r.per_segment, r.spread, r.stay) == (20, 3.0, 0.5)


def test_tuned_paths_use_each_keys_own(spark):
    rng = np.random.default_rng(3)
    rows = [(s, i / 20, float(x), float(y)) for s in ("a", "b") for i, (x, y) in enumerate(walk(rng, 300, 1.0))]
    df = spark.createDataFrame(rows, "session string, t double, x double, y double")
    tuned = spark.createDataFrame([("a", 20, 4.0, 1.5), ("b", 12, 6.0, 2.0)], "session string, per_segment int, spread double, stay double")
    got = li.track_path(df, PLUS, tuned=tuned, block=5.0, margin=1.0).orderBy("session", "t").collect()
    for session, n, spread, stay in (("a", 20, 4.0, 1.5), ("b", 12, 6.0, 2.0)):
        m = li.model(tuple(PLUS), n, spread, stay, True)
        own = [r for r in got if r.session == session]
        want = one_pass(m, np.array([(r.x, r.y) for r in own]))
        assert [r.lin for r in own] == m.lin[want].tolist()


def test_nearest_states_vote(spark):
    rng = np.random.default_rng(4)
    xy = walk(rng, 400)
    df = spark.createDataFrame([("s", i / 20, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [("s", 30.0, None, 1.0)], "session string, t double, x double, y double")
    got = li.nearest_states(df, PLUS, per_segment=21).orderBy("t").collect()
    m = li.model(tuple(PLUS), 21, 1.0, 1.0, True)
    near = ((xy[:, None] - m.place[None]) ** 2).sum(2).round(9).argmin(1)
    want = []
    for i in range(len(near)):
        values, counts = np.unique(near[max(0, i - 2) : i + 3], return_counts=True)
        want.append(values[counts.argmax()])
    assert [r.lin for r in got[:-1]] == pytest.approx(m.lin[want].tolist()) and got[-1].lin is None
    assert [r.segment for r in got[:-1]] == m.segment[want].tolist()


def test_nothing(spark):
    df = spark.createDataFrame([("s", 0.0, None, 1.0)], "session string, t double, x double, y double")
    got = li.track_path(df, PLUS).collect()
    assert len(got) == 1 and got[0].segment is None
    assert li.track_path(df.limit(0), PLUS).count() == 0
