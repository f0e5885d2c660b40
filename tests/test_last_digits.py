"""Results that hang on a last digit or on a tie, as DuckDB has them."""

import functools
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from pulsegrid.operators import correlate as co, perievent as pe, stats as st
from pulsegrid.plans import extra_queries as xq
from pulsegrid.sources import metadata as meta


def test_raw_values_round_in_single_precision(spark, tmp_path):
    duckdb.sql("COPY (SELECT 0::BIGINT AS vec_id, [-0.2765, 0.1925, -0.1335, 0.25]::FLOAT[] AS embedding, 1 AS label) TO '" + f"{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    want = [r[0] for r in duckdb.sql(f"SELECT round(x * 1000)::INTEGER FROM (SELECT unnest(embedding) AS x FROM '{tmp_path}/embeddings.parquet')").fetchall()]
    assert want == [-277, 193, -134, 250]
    assert [r.value for r in xq._raw(spark, str(tmp_path)).orderBy("channel").collect()] == want


def test_labels_of_epochs_of_ones_own(spark):
    pos = spark.createDataFrame([(1, 5.0), (2, 5.0), (2, 50.0)], "unit int, t double")
    ep = spark.createDataFrame([(10, 1, 0.0, 9.0, "a"), (11, 2, 0.0, 9.0, "b")], "epoch_id int, unit int, start double, stop double, label string")
    got = sorted((r.unit, r.t, r.label) for r in meta.label_behaviour(pos, ep, 4.0, "label", keys=["unit"]).collect())
    assert got == [(1, 5.0, "a"), (2, 5.0, "b"), (2, 50.0, None)]
    assert {r.label for r in meta.label_behaviour(pos.where("t < 9"), ep.drop("unit"), 4.0, "label").collect()} == {"b"}


def test_rates_are_rounded_once(spark):
    size = next(k for k in range(2, 99) if k * 0.001 != k / 1000)
    p = spark.createDataFrame([(1, float(i)) for i in range(size)], "unit int, t double")
    got = {r.rate for r in co.correlogram(p, 0.001, 120).where("n = 0").collect()} | {r.rate for r in co.correlogram(p, 0.001, 120, pairs=True).where("bin = 60").collect()}
    assert got == {0.0}
    pair = spark.createDataFrame([(1, float(i)) for i in range(size)] + [(2, 5.005)], "unit int, t double")
    assert {r.rate for r in co.correlogram(pair, 0.001, 120, same=False).where("n = 1").collect()} == {1 / (size / 1000)}


def test_base_is_added_up_in_order_of_lag(spark):
    rnd = random.Random(2)
    rates = [rnd.choice([1 / 0.037, 2 / 0.037, 0.1, 1e3]) for _ in range(11)]
    rows = spark.createDataFrame([(1, (40 + i) * 0.001, r) for i, r in enumerate(rates)] + [(1, 0.005, 7.0)], "unit int, lag double, rate double").repartition(5, "lag")
    assert pe.burst_index(rows).first().base == functools.reduce(lambda a, b: a + b, rates) / 11


def test_mean_in_order_whatever_the_tasks(spark):
    rnd = random.Random(1)
    rows = [(u, i, round(rnd.uniform(0, 200), 2)) for u in range(40) for i in range(15)]
    want = {u: functools.reduce(lambda a, b: a + b, [v for k, _, v in rows if k == u]) / 15 for u in range(40)}
    for n in (1, 3, 7):
        d = spark.createDataFrame(rows, "unit int, i int, v double").orderBy(F.desc("i")).repartition(n)
        assert {r.unit: r.m for r in st.ordered_mean(d, "v", "i", ["unit"], "m").collect()} == want
    assert any(np.sum([v for k, _, v in rows[::-1] if k == u]) / 15 != want[u] for u in want), "the order matters here"
