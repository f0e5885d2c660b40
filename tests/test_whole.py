"""Queries that SQL cannot express against brute force, on a small fixture."""

import numpy as np
import pandas as pd
import pytest

from pulsegrid import catalog
from pulsegrid.plans import population_queries as pq

QUERIES = catalog.queries()
UNITS, VECTORS = 52, 130


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    d, rng, n = tmp_path_factory.mktemp("whole"), np.random.default_rng(4), 1500
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.choice(30 * 86400, n, replace=False)), unit="s")
    kinds = np.array(["signup", "error", "purchase", "click"])[rng.integers(0, 4, n)]
    unit = np.r_[np.arange(UNITS), rng.integers(0, UNITS, n - UNITS)]
    pd.DataFrame({"event_id": np.arange(n), "ts": ts.astype("datetime64[us]"), "user_id": unit, "event_type": kinds, "value": rng.random(n) * 500}).to_parquet(d / "events.parquet")
    pd.DataFrame({"vec_id": np.arange(VECTORS), "embedding": list(rng.standard_normal((VECTORS, 8)).astype("float32")), "label": rng.integers(0, 3, VECTORS)}).to_parquet(d / "embeddings.parquet")
    # order keys that leave most runs of numbers empty
    order = np.repeat(rng.choice(60_000, 300, replace=False), 2)
    pd.DataFrame({"l_orderkey": order, "l_linenumber": np.tile([1, 2], 300).astype("int32"), "l_quantity": rng.integers(1, 51, 600) * 1.0, "l_extendedprice": rng.random(600) * 100_000, "l_discount": rng.integers(0, 11, 600) / 100}).to_parquet(d / "lineitem.parquet")
    return str(d)


def test_queries_without_sql_take_all_rows(spark, sf):
    pairs = pq.whole_similarity_index(spark, sf).select("vec_id", "key2").collect()
    assert len(pairs) == VECTORS * (VECTORS - 1) // 2
    e = pd.read_parquet(f"{sf}/events.parquet")
    day = (e.ts - pd.Timestamp("2024-01-01")).dt.total_seconds() / 86400

    def bias(some):
        t = {u: day[some & (e.user_id == u)].to_numpy() for u in range(UNITS)}
        return {(u, v): 2 * (t[u][:, None] <= t[v]).mean() - 1 for u in t for v in t if u != v and len(t[u]) and len(t[v])}

    ref = bias(day < 10)
    for r in pq.whole_bias_significance(spark, sf).collect():
        b = bias((day >= 10) & (day // 5 == r.epoch))
        x, y = (np.array([m.get(k, 0.0) for k in sorted(ref.keys() | b.keys())]) for m in (ref, b))
        assert abs(r.cosine - x @ y / np.sqrt((x @ x) * (y @ y))) < 1e-9
    assert {r.unit for r in QUERIES["assembly_patterns_of_events"](spark, sf).collect()} == set(range(UNITS))
    assert pq.whole_replay_scores(spark, sf).count() == 5


def test_shuffled_information_of_all_sessions(spark, sf):
    li = pd.read_parquet(f"{sf}/lineitem.parquet").sort_values(["l_orderkey", "l_linenumber"])
    bx = np.minimum((li.l_quantity.to_numpy() - 0.5) // 5, 9).astype(int)
    flag = li.l_extendedprice.to_numpy() > 50_000

    def information(flag):
        occ, k = np.bincount(bx, minlength=10), np.bincount(bx, flag, 10)
        p, rate = (occ / occ.sum())[occ > 0], (k / np.maximum(occ, 1))[occ > 0]
        m = (p * rate).sum()
        return (p * rate / m * np.log2(np.where(rate > 0, rate, 1) / m) * (rate > 0)).sum()

    got = {r.shuffle: r.information for r in pq.whole_shuffle_spatial_information(spark, sf).collect()}
    assert len(got) == 51 and abs(got[0] - information(flag)) < 1e-9
    rolled = [information(np.roll(flag, s)) for s in range(1, len(flag))]
    assert all(min(abs(v - w) for w in rolled) < 1e-9 for k, v in got.items() if k)
