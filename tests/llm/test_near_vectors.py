import duckdb
import numpy as np

from pulsegrid.llm import near_vectors

SCHEMA = "label int, vec_id long, embedding array<float>, v string, n string"


def brute(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept) of every row, from all pairs."""
    ok = [lab is not None and e is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e) for lab, _, e in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(rows)
    units = [np.array(e, np.float32).astype(float) / np.linalg.norm(np.array(e, np.float32).astype(float)) if k else None for (_, _, e), k in zip(rows, ok)]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][0] == rows[j][0] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold:
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    out = []
    for i, (_, vec, _) in enumerate(rows):
        ids = [rows[j][1] for j in range(len(rows)) if root(j) == root(i) and rows[j][1] is not None]
        c = min(ids, default=None)
        out.append((vec, links[i], c, vec == c))
    return out


def run(spark, rows, **how):
    df = spark.createDataFrame([(lab, i, e, "x", "y") for lab, i, e in rows], SCHEMA).repartition(6)
    return [(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors.near_duplicates(df, **how).collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def around(rng, centre, n, least):
    """Vectors whose cosine with the centre is about ``least``."""
    noise = rng.normal(size=(n, len(centre)))
    noise -= np.outer(noise @ centre, centre)
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    return least * centre + np.sqrt(1 - least**2) * noise


def planted(rng, n_free, groups, dim=64):
    x = [rng.normal(size=(n_free, dim))]
    for size, least in groups:
        c = rng.normal(size=dim)
        x.append(around(rng, c / np.linalg.norm(c), size, least))
    return np.concatenate(x)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    x = planted(rng, 40, [(8, 0.985), (6, 0.97)])
    rows = [(i % 2, i, e.tolist()) for i, e in enumerate(x)] + [(1, 100 + i, e.tolist()) for i, e in enumerate(x[30:50])]
    rows += [(None, 200, x[45].tolist()), (1, None, x[45].tolist()), (1, None, x[45].tolist()), (1, 45, x[45].tolist()), (1, 201, None), (1, 202, []), (1, 203, [0.0] * 64), (1, 204, [None] + [1.0] * 63)]
    rows += [(1, 205, [float("nan")] * 64), (1, 206, [float("inf")] * 64), (1, 207, x[45, :63].tolist()), (1, 208, (x[45] * 3).tolist()), (1, 209, (-x[45]).tolist()), (7, None, [1.0] * 64)]
    assert order(run(spark, rows)) == order(brute(rows))


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, None)]) == [(1, 0, 1, True)]


def test_windows_go_on_through_large_groups(spark, monkeypatch):
    """Small windows: groups of many windows keep all their links, whatever pass finds them."""
    for name, value in (("WINDOW", 8), ("TILE", 2), ("AT_ONCE", 2)):
        monkeypatch.setattr(near_vectors, name, value)
    rng = np.random.default_rng(5)
    x = planted(rng, 250, [(150, 0.9999), (60, 0.995), (2, 0.99)])
    rows = [(3, i, e.tolist()) for i, e in enumerate(x)]
    got, want = order(run(spark, rows, n_passes=9)), order(brute(rows))
    assert [r[2] for r in got] == [r[2] for r in want]
    share = sum(r[1] for r in got) / sum(r[1] for r in want)
    assert 0.97 <= share <= 1
    assert all(g[1] <= w[1] for g, w in zip(got, want))  # none counted twice


def test_recall_at_the_threshold(spark, monkeypatch):
    """Pairs just above the threshold, among many windows, with the number of passes that the size asks for."""
    monkeypatch.setattr(near_vectors, "WINDOW", 32)
    rng = np.random.default_rng(6)
    one = rng.normal(size=(900, 64))
    one /= np.linalg.norm(one, axis=1)[:, None]
    two = np.concatenate([around(rng, c, 1, 0.935) for c in one])
    rows = [(1, i, e.tolist()) for i, e in enumerate(np.concatenate([one, two]))]
    got = {r[0]: r for r in run(spark, rows)}
    links = sum(r[1] for r in got.values()) / 2
    assert links >= 0.9 * 900 and all(r[1] <= 1 for r in got.values())
    assert near_vectors.passes(1800, 0.93) > 5


def test_sql_says_the_same(spark):
    rng = np.random.default_rng(8)
    rows = [(i % 2, i, e.tolist()) for i, e in enumerate(planted(rng, 30, [(9, 0.975), (12, 0.97)]))]
    df = spark.createDataFrame([(lab, i, e, "x", "y") for lab, i, e in rows], SCHEMA)
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    assert order(con.sql(near_vectors.SQL).fetchall()) == order(run(spark, rows))
