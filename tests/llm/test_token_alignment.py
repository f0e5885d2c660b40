import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from pulsegrid.llm import token_alignment
from pulsegrid.llm.queries import vocabulary

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SCHEMA = "keys int, doc_id long, text string, n_a string"


def brute(rows):
    """Whole texts by the libraries, all pairs of tokens that end together."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(P.path(A)), SentencePieceProcessor(model_file=P.path(B))
    a.encode_special_tokens = True
    alphabet = token_alignment.byte_alphabet()
    out, links = [], []
    for _, text in rows:
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        sa = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ia]
        sb = []
        for i in ib:
            p = b.id_to_piece(i)
            sb.append(bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") and p.endswith(">") else p.replace("▁", " ").encode())
        whole = (" " + (text or "")).encode()
        if not text or b"".join(sa) != whole or b"".join(sb) != whole:
            out.append(None)
            links.append([])
            continue
        ea, eb = np.cumsum([len(s) for s in sa]).tolist(), np.cumsum([len(s) for s in sb]).tolist()
        both = sorted(set(ea) & set(eb))
        groups, low = [], 0
        for end in both:
            groups.append(",".join(str(i) for i, e in zip(ia, ea) if low < e <= end) + "|" + ",".join(str(i) for i, e in zip(ib, eb) if low < e <= end))
            low = end
        out.append((len(ia), len(ib), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append([(i, j) for i, e in zip(ia, ea) for j, f in zip(ib, eb) if e == f])
    n = Counter(p for x in links for p in x)
    high = {}
    for (_, j), c in n.items():
        high[j] = max(high.get(j, 0), c)
    told = []
    for (doc, _), o, x in zip(rows, out, links):
        if o is None:
            told.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            told.append((doc, *o[:3], len(x), sum(n[p] == high[p[1]] for p in x), sum(n[p] for p in x), o[3]))
    return told


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n b", "a \n\n b  c\t d", "don't stop", "x<|endoftext|>y <|endoftext|> z", "<s> </s> <unk>", "<0x41> <0x0A>",
    "▁x a▁b ▁ c", "naïve café — “quotes” …", "日本語 の テスト", "🙂🙂 👩‍👩‍👧 z", "a b c d e", "x\x1cy \x1f z", "\x00 a", "1234567 89 3.14", "  lead", "trail  ", "ab " * 300, "supercalifragilistic " * 3, "!!! ... ,,, ;;",
]


def test_odd_texts_equal_the_libraries(spark):
    rnd = random.Random(2)
    rows = list(enumerate(ODD)) + [(None, "a b"), (3, "a b"), (3, "a b")]
    bits = ["the", "The", "tokens", " ", "  ", "\n", "\t", "é", "ß", "漢", "'s", "'", "42", "-", "—", "🙂", "<s>", "​", "\r\n", "x" * 20]
    rows += [(1000 + i, "".join(rnd.choice(bits) + rnd.choice(["", " "]) for _ in range(rnd.randint(1, 60)))) for i in range(120)]
    df = spark.createDataFrame([(1, i, t, "z") for i, t in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in token_alignment.align(df, vocabulary(A), vocabulary(B)).collect()]
    key = lambda r: tuple((x is None, x) if x is None else (False, x) for x in map(lambda v: -1 if v is None else v, r))
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert sum(r[1] > 0 for r in got) > 100


@pytest.mark.parametrize("cuts", [True, False])
def test_pieces_of_texts_are_encoded_apart_or_whole(cuts):
    aligner = token_alignment.Aligner(P.path(A), P.path(B))
    assert aligner.cuts
    aligner.cuts = cuts
    texts = [t for t in ODD if t]
    want = [(*r[1:5], r[7]) for r in brute(list(enumerate(texts)))]
    assert [d[:5] for d in aligner.documents(texts)] == want


def test_workers_forget(monkeypatch):
    monkeypatch.setattr(token_alignment, "REMEMBER", 5)
    aligner = token_alignment.Aligner(P.path(A), P.path(B))
    for t in ["one two three four five six seven", "one two eight nine ten", "one seven ten"]:
        (row,) = aligner.documents([t])
        assert row[:5] == (lambda r: (*r[1:5], r[7]))(brute([(0, t)])[0])


def test_counts_over_many_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_alignment, "GATHER", 50)
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 400, 200) for _ in range(20)]
    rows = []
    for d in docs:
        keys, times = np.unique(d, return_counts=True)
        rows.append((token_alignment.packed(keys, 31), token_alignment.packed(times, 32)))
    df = spark.createDataFrame(rows, "keys binary, times binary").repartition(4)
    found = token_alignment.count_shards(token_alignment.partial_counts(df, 31), str(tmp_path / "shards"), 4)
    keys, n = np.unique(np.concatenate(docs), return_counts=True)
    asked = np.arange(-5, 420)
    got = token_alignment.Counts([(r["path"], r["first"], r["last"], r["size"]) for r in found]).of(asked)
    assert got.tolist() == [dict(zip(keys.tolist(), n.tolist())).get(k, 0) for k in asked.tolist()]
    assert len(found) > 2 and sum(r["size"] for r in found) == len(keys)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    got = token_alignment.align(df, vocabulary(A), vocabulary(B))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and got.count() == 0
    only = spark.createDataFrame([(1, 1, None, ""), (1, 2, "", "")], SCHEMA)
    assert [tuple(r) for r in token_alignment.align(only, vocabulary(A), vocabulary(B)).orderBy("doc_id").collect()] == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]
