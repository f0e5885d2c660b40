import hashlib
import random
import re

import numpy as np
import pytest

from pulsegrid.llm import _repeats, substring_dedup, suffix_dedup
from pulsegrid.llm._buckets import refined


def brute(rows, symbols_of, W):
    """rows: (doc_id, text) without repeats; gone symbols by doc."""
    first, out = {}, {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        x = symbols_of(t or "")
        gone = [False] * len(x)
        for i in range(len(x) - W + 1):
            k = tuple(x[i : i + W])
            if k in first:
                for j in range(i, i + W):
                    gone[j] = True
            else:
                first[k] = (d, i)
        out[d] = (x, gone)
    return out


def corpus(seed, n=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "日本", "x" * 30]
    passage = [[rnd.choice(vocabulary) for _ in range(rnd.randint(15, 60))] for _ in range(5)]
    texts = [None, "", " \t\n", "a", "a " * 200, "aaaa" * 200, "ab" * 300, "ab" * 300]
    for _ in range(n):
        ws = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 80))]
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(ws))
            p = rnd.choice(passage)
            ws[at:at] = p[rnd.randint(0, 5) :]
        texts.append(rnd.choice([" ", "\n"]).join(ws))
    texts += texts[-5:] * 2
    rnd.shuffle(texts)
    return list(enumerate(texts))


def word_list(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


@pytest.mark.parametrize("seed,piece", [(1, 1 << 19), (2, 40)])
def test_words_equal_brute_force(spark, monkeypatch, seed, piece):
    monkeypatch.setattr(_repeats, "PIECE", piece)
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x", 5) for d, t in rows] + [(rows[20][0], rows[20][1], "again", 6)], "doc_id long, text string, kept string, n int").repartition(5)
    want = brute(rows, word_list, 20)
    out = substring_dedup.remove(docs, splits=(0.2, 0.5)).collect()
    assert len(out) == len(rows) + 1
    for r in out:
        x, gone = want[r.doc_id]
        kept = " ".join(w for w, g in zip(x, gone) if not g)
        assert (r.n_words, r.n_removed) == (len(x), sum(gone)), r.doc_id
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("seed", [3, 4])
def test_bytes_equal_brute_force(spark, seed):
    rows = corpus(seed) + [(None, "tail " * 60)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_bytes string").repartition(5)
    want = brute(rows, lambda t: t.encode(), 100)
    out = suffix_dedup.remove(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        x, gone = want[r.doc_id]
        kept = bytes(b for b, g in zip(x, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(x), sum(gone), spans), r.doc_id
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_index_compaction_keeps_the_answers(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FANOUT", 2)
    rows = corpus(7)
    want = brute(rows, word_list, 20)
    index = substring_dedup.FingerprintIndex(spark)
    for lo in range(0, len(rows), 20):
        batch = spark.createDataFrame(rows[lo : lo + 20], "doc_id long, text string")
        for r in index.add(batch, digest=False).collect():
            x, gone = want[r.doc_id]
            assert r.kept == " ".join(w for w, g in zip(x, gone) if not g), r.doc_id
    assert len(index.runs) <= 2


def test_an_index_is_opened_again_and_later_batches_are_later(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FANOUT", 2)
    rows = corpus(8)
    rows = [(len(rows) - i, t) for i, (_, t) in enumerate(rows)]  # ids fall from batch to batch
    batches = [sorted(rows[lo : lo + 17]) for lo in range(0, len(rows), 17)]
    place = {d: k for k, (d, _) in enumerate(r for b in batches for r in b)}
    want = brute([(place[d], t) for d, t in rows], word_list, 20)
    for k, b in enumerate(batches):
        index = substring_dedup.FingerprintIndex(spark, path=str(tmp_path / "index"))
        assert len(index.runs) <= 2 and bool(index.runs) == bool(k)
        for r in index.add(spark.createDataFrame(b, "doc_id long, text string"), digest=False).collect():
            x, gone = want[place[r.doc_id]]
            assert r.kept == " ".join(w for w, g in zip(x, gone) if not g), r.doc_id


@pytest.mark.parametrize("module,symbols_of,window", [(substring_dedup, word_list, 20), (suffix_dedup, lambda t: t.encode(), 100)])
def test_rows_without_a_doc_id_and_rows_that_share_one(spark, module, symbols_of, window):
    rnd = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = sorted({" ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(1, 40))) for _ in range(2000)})
    same = [passage, passage + " more", "other " + passage]
    shared = [" ".join(f"s{rnd.randrange(10**6)}" for _ in range(rnd.randint(1, 40))) for _ in range(20)]
    docs = spark.createDataFrame([(None, t) for t in texts + same] + [(5, t) for t in shared] + [(5, shared[0])], "doc_id long, text string")
    out = module.remove(docs, digest=False).collect()
    whole = lambda kept: kept if isinstance(kept, str) else bytes(kept).decode()
    got = sorted(whole(r.kept) for r in out if r.doc_id is None)
    assert len(got) == 2003 and sum(passage in k for k in got) == 1 and set(texts) - set(got) == set()
    gone = sum(len(symbols_of(t)) for t in texts + same) - sum(len(symbols_of(k)) for k in got)
    assert gone >= 2 * len(symbols_of(passage))
    mine = sorted(whole(r.kept) for r in out if r.doc_id == 5)
    assert len(mine) == 21 and all(len(symbols_of(k)) <= len(symbols_of(t)) for k, t in zip(mine, sorted([*shared, shared[0]])))


def test_very_long_texts_and_buckets(spark):
    rnd = random.Random(12)
    long = " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(3000)) for _ in range(200_000))
    rows = [(1, long), (2, long[500_000:600_000]), (3, "x" * 700_000), (4, long + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.remove(docs).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 100_000 and got[3].n_removed == 699_999 and got[3].n_spans == 1
    assert got[4].n_bytes - got[4].n_removed <= 4
    got = {r.doc_id: r for r in substring_dedup.remove(docs).collect()}
    assert got[1].n_removed == 0 and got[2].n_words - got[2].n_removed <= 2 and got[4].n_words - got[4].n_removed == 1


@pytest.mark.parametrize("window", [1, 3, 8, 20, 64, 100])
def test_refined_buckets_hold_equal_windows(window):
    for seed in range(40):
        rnd = random.Random(seed)
        stem = bytes(rnd.choice(b"ab") for _ in range(300))
        texts = [stem[rnd.randrange(50) :][: rnd.randrange(250)] + bytes([rnd.randrange(256)]) for _ in range(rnd.randint(0, 12))]
        at, pointer = refined(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64), window)
        windows, base = [], 0
        for t in texts:
            windows += [(base + i, t[i : i + window]) for i in range(len(t) - window + 1)]
            base += len(t)
        assert at.tolist() == [p for p, _ in windows]
        of = dict(zip([w for _, w in windows], pointer.tolist()))
        assert [of[w] for _, w in windows] == pointer.tolist() and len(set(of.values())) == len(of)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove(docs).count() == 0 and suffix_dedup.remove(docs).count() == 0
