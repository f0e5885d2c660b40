import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pulsegrid.llm import suffix_tree_lm as lm
from pulsegrid.llm._common import crc_mod


def toks(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]


def brute(rows):
    c = Counter(x for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 7 != 2 for x in toks(t))
    n, v = sum(c.values()), len(c)
    return {d: (len(toks(t)), sum(c[x] > 0 for x in toks(t)), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in toks(t))) for d, t in rows}


def test_base_score_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "A b c É", "a B c é", "the end", "zz " * 5000] + ["the cat sat on the mat", "the dog sat on the log"] * 40)]
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in rows] + [(6, rows[6][1], 2.0)], "doc_id long, text string, score double")
    want = brute([*rows, (6, rows[6][1])][:-1] + [])
    # the repeated row is learned from twice
    want2 = brute([*rows, (6, rows[6][1])]) if zlib.crc32(b"6") % 7 != 2 else want
    out = lm.score(docs, crc_mod(7) == 2).collect()
    assert len(out) == len(rows) + 1
    for r in out:
        n, k, total, base = want2[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, k, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    assert lm.score(docs.limit(0), crc_mod(7) == 2).count() == 0


def test_tree_sums_to_one_and_beats_unigrams(spark):
    import random

    rnd = random.Random(3)
    after = {w: [rnd.choice("abcdefghij") for _ in range(3)] for w in "abcdefghij"}
    def walk():
        w, out = "a", []
        for _ in range(rnd.randint(20, 60)):
            w = rnd.choice(after[w])
            out.append(w)
        return " ".join(out)
    docs = spark.createDataFrame([(i, walk()) for i in range(400)], "doc_id long, text string")
    out = lm.score(docs, crc_mod(7) == 2).toPandas()
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum() + 0.1 * held.n_tokens.sum()
    tree, _ = lm.fit(docs, floors=lm.Floors(10, 10, 10))
    number = lambda *ws: tree.number(lm.tokens(pa.array([" ".join(ws)]))[0][:-1])
    assert len(tree.orders) == lm.DEPTH and all(o.kept.any() for o in tree.orders[:1])
    # in each state the probabilities of all words, and of an unseen one, sum to one
    root = 10 ** tree.root()
    unseen = 1 / (tree.total + tree.vocabulary + 1)
    last = lambda ids: tree.gains(ids, np.array([0, len(ids)]))[-1]
    for history in (number("a"), number("a", "b"), number("c", "d"), number("a", "b", "c", "d", "e")):
        p = [root[i] * 10 ** last(np.r_[history, i]) for i in range(len(root))]
        assert sum(p) + unseen * 10 ** last(np.r_[history, -1]) == pytest.approx(1.0, abs=1e-9)


class Plain:
    """The same tree with dictionaries of words."""

    def __init__(self, texts, depth, floors):
        docs = [toks(t) for t in texts]
        self.c = Counter(x for d in docs for x in d)
        self.n, self.v = sum(self.c.values()), len(self.c)
        word, context, nxt = (lm.floor(self.n, f) for f in (floors.word, floors.context, floors.next))
        numbered = {w for w, k in self.c.items() if k >= word}
        self.nexts = {}
        size = Counter()
        for d in docs:
            for i in range(len(d)):
                for k in range(1, depth + 1):
                    h = tuple(d[max(0, i - k) : i])
                    if len(h) == k and set(h) <= numbered:
                        size[h] += 1
                        if d[i] in numbered:
                            self.nexts.setdefault(h, Counter())[d[i]] += 1
        self.kept = {}
        for h in sorted(self.nexts, key=len):
            if size[h] < context:
                continue
            some = {x: k for x, k in self.nexts[h].items() if k >= nxt}
            p = {x: (k - lm.DISCOUNT) / size[h] for x, k in some.items()}
            left = max(1e-12, 1 - sum(p.values()))
            q = {x: self.p(h[1:], x) for x in p}
            full = {x: p[x] + left * q[x] for x in p}
            if some and sum(full[x] * math.log2(full[x] / q[x]) for x in p) >= lm.DIVERGENCE:
                self.kept[h] = (left, full)

    def p(self, h, x):
        while h and h not in self.kept:
            h = h[1:]
        if not h:
            return (self.c[x] + 1) / (self.n + self.v + 1)
        left, full = self.kept[h]
        return full[x] if x in full else left * self.p(h[1:], x)

    def score(self, t, depth):
        d = toks(t)
        return sum(math.log10(self.p(tuple(d[max(0, i - depth) : i]), x)) for i, x in enumerate(d))


@pytest.mark.parametrize("most", [10**6, 30])
def test_whole_scores_equal_a_plain_tree(spark, monkeypatch, most):
    import random

    monkeypatch.setattr(lm, "MOST_ENTRIES", most)  # several blocks of the tree
    rnd = random.Random(4)
    words = [f"W{i}" for i in range(12)] + ["é", "É"]
    texts = [None, "", " \n", "W1 " * 500]
    for _ in range(300):
        ws = []
        while len(ws) < rnd.randint(0, 50):
            ws += rnd.choice([["W1", "W2", "W3", "W4"], ["W2", "W3", "é"], [rnd.choice(words)], [f"rare{rnd.randrange(400)}"]])
        texts.append(rnd.choice([" ", "\t "]).join(ws))
    rows = [*enumerate(texts), (None, texts[50]), (None, texts[51]), (7, texts[7]), (8, "another W1 W2 W3")]
    docs = spark.createDataFrame([(d, t, 0.5) for d, t in rows], "doc_id long, text string, score double")
    floors = lm.Floors(800, 200, 400)
    out = lm.score(docs, crc_mod(7) == 2, 3, floors).collect()
    plain = Plain([t for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 7 != 2], 3, floors)
    assert max(map(len, plain.kept)) == 3 and lm.floor(plain.n, 200) > 2
    want = sorted((d is None, d or 0, round(plain.score(t, 3), 8)) for d, t in rows)
    assert [(a, b) for a, b, _ in want] == sorted((r.doc_id is None, r.doc_id or 0) for r in out)
    got = sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 8)) for r in out)
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-6)


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    texts = ["aB c", None, "", "x" * 300 + " c ab", "é\u00a0É ab " * 50, "y" * 90 + " " + "x" * 300]
    whole, bounds = lm.tokens(pa.array(texts))
    monkeypatch.setattr(lm, "_LONG", 64)
    monkeypatch.setattr(lm, "_HASHER", [])
    cut, _ = lm.tokens(pa.array(texts))
    want = [x.encode() for t in texts for x in toks(t)]
    assert len(whole) == len(want) == bounds[-1] and [len(toks(t)) for t in texts] == np.diff(bounds).tolist()
    short = [i for i, w in enumerate(want) if len(w) <= 64]
    for h in (whole, cut):
        of = dict(zip(want, h.tolist()))
        assert [of[w] for w in want] == h.tolist() and len(set(of.values())) == len(of)
    assert (whole[short] == cut[short]).all()


def test_likelihood_rises_with_depth(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [lm.score(docs, crc_mod(7) == 2, depth).where("held_out").agg({"score": "sum"}).first()[0] for depth in (1, 2, 4)]
    assert held[0] < held[1] <= held[2] + 1e-6 * abs(held[2])


def test_held_out_likelihood_on_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = lm.score(docs, crc_mod(7) == 2).toPandas()
    held = out[out.held_out]
    assert held.score.sum() >= held.base_score.sum()
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    for r in out.itertuples():
        n, k, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, k, total) and r.base_score == pytest.approx(base, rel=1e-9)
