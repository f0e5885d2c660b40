import numpy as np
import pytest

from pulsegrid import catalog
from pulsegrid.operators import correlate as co


def correlogram(refs, points, width, n):
    """Rates of lags around the references, by plain loops."""
    c = np.zeros(n)
    for r in refs:
        for t in points:
            k = int(np.floor((t - (r - n / 2 * width)) / width))
            if 0 <= k < n:
                c[k] += 1
    return c / (len(refs) * width)


def test_peth_is_freed_from_the_units_own_rhythm(spark):
    rng = np.random.default_rng(7)
    refs = np.sort(rng.uniform(0, 100, 25))
    first = np.concatenate([refs + 0.1, rng.uniform(0, 100, 30)])
    units = {1: np.concatenate([first, first + 0.3, first[:20] + 0.6]), 2: rng.uniform(0, 100, 60), 3: np.array([900.0, 901.0])}
    points = spark.createDataFrame([(u, float(t)) for u, ts in units.items() for t in rng.permutation(ts)] + [(1, None), (1, float("nan"))], "unit int, t double")
    got = {}
    for r in co.deconvolved_peth(points, spark.createDataFrame([(float(r),) for r in refs], "r double"), 0.1, 10).collect():
        got.setdefault(r.unit, {})[r.bin] = r.rate
    for u, ts in units.items():
        raw, own = correlogram(refs, ts, 0.1, 21), correlogram(ts, ts, 0.1, 21)
        m = raw.mean()
        system = np.array([[own[10 + i - j] for j in range(11)] for i in range(11)])
        want = np.linalg.solve(system, raw[5:16] - m + m / len(refs)) if raw.any() else np.zeros(11)
        assert [got[u][i] for i in range(11)] == pytest.approx(want.tolist(), abs=1e-9)


def test_query_deconvolves_by_the_units_autocorrelograms(spark, tmp_path):
    import datetime

    at = [0, 100, 190, 280, 5000, 5090, 5190, 9000]
    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s), 7, "error" if i % 4 == 0 else "view", 1.0) for i, s in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.bin: r.rate for r in catalog.queries()["deconvolve_peth"](spark, str(tmp_path)).collect()}
    raw, own = correlogram([0, 5000], at, 90.0, 41), correlogram(at, at, 90.0, 41)
    m = raw.mean()
    want = np.linalg.solve(np.array([[own[20 + i - j] for j in range(21)] for i in range(21)]), raw[10:31] - m + m / 2)
    assert [got[i] for i in range(21)] == pytest.approx(want.tolist(), abs=1e-8)
