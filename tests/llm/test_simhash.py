import random
import re

import numpy as np
import xxhash

from pulsegrid.llm import simhash
from pulsegrid.llm._components import components


def brute_print(text, k=4):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_every_close_pair_meets_at_an_anchor():
    rnd = random.Random(1)
    for _ in range(300):
        x = rnd.getrandbits(64)
        y = x
        for b in rnd.sample(range(64), rnd.randint(0, 4)):
            y ^= 1 << b
        ax, kx, hx = simhash._keys(np.array([x], np.uint64), 4)
        _, ky, _ = simhash._keys(np.array([y], np.uint64), 4)
        assert set(kx[hx].tolist()) & set(ky.tolist())


def test_fingerprint_is_the_plain_rule():
    rnd = random.Random(2)
    texts = [None, "", " \n", "One", "ONE two", "a b c d", "a b c d e", "É x Y z " * 9, " ".join(rnd.choice("abcdef") for _ in range(3000))]
    for t in texts:
        assert simhash.fingerprint(t) == brute_print(t), t


def test_groups_equal_brute_force(spark):
    rnd = random.Random(4)
    base = [" ".join(rnd.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rnd.randint(0, 50)) for _ in range(300)) for _ in range(25)]
    texts = [None, "", "x", "x"]
    for t in base:
        texts += [t, t] + [t.replace("alpha", "alpha" + "!" * rnd.randint(0, 1), rnd.randint(0, 2)) for _ in range(4)]
    rnd.shuffle(texts)
    docs = spark.createDataFrame([(i, t, 0, "c") for i, t in enumerate(texts)] + [(None, "x", 1, "c"), (0, texts[0], 0, "c")], "doc_id long, text string, fp int, component_id string")
    out = simhash.groups(docs).collect()
    got = {r.doc_id: r for r in out}
    fps = [brute_print(t) for t in texts]
    want = brute_components(fps)
    assert len(out) == len(texts) + 2
    for i, t in enumerate(texts):
        assert got[i].fp % 2**64 == fps[i] and got[i].component_id == want[i]
    kept = [r.doc_id for r in simhash.one_of_each(docs).collect()]
    assert sorted(k for k in kept) == sorted(set(want))
    assert simhash.groups(docs.limit(0)).count() == 0


def test_one_row_stays_of_groups_with_and_without_ids(spark):
    long = " ".join(f"w{i}" for i in range(80))
    other = " ".join(f"v{i * 7}" for i in range(80))
    third = " ".join(f"u{i * 5}" for i in range(80))
    rows = [(7, long, "a"), (3, long + "", "b"), (None, long, "c"), (None, other, "d"), (None, other, "e"), (9, third, "f"), (9, third, "g"), (9, other + " more words of another kind " + third, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    want = brute_components([brute_print(t) for _, t, _ in rows])
    got = sorted((r.doc_id or 0, r.text) for r in simhash.one_of_each(docs).collect())
    assert len(got) == len(set(want))
    assert (3, long) in got and (0, other) in got and (0, long) not in got and (9, third) in got


def test_busy_anchors_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 3)
    rnd = random.Random(9)
    fps = sorted({(0xABCDEF0123456789 ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))) for _ in range(120)})
    want = brute_components(fps)
    nodes = spark.createDataFrame([(i, f - 2**64 if f >> 63 else f) for i, f in enumerate(fps)], "node long, fp long")
    roots = {r.node: r.root for r in components(simhash.links(nodes)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == want


def test_components_of_long_paths(spark):
    n = 300
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    path = list(zip(ids, ids[1:]))
    links = spark.createDataFrame([*path, (5, 5), (1000, 1001), (1001, 1002), (1000, 1002)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(n)) and got[1002] == got[1000] == 1000
    assert components(links.limit(0)).count() == 0
