import hashlib

import pytest

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from pulsegrid.llm import bpe, token_counts  # noqa: E402

TEXTS = [
    None, "", " ", "\n", "a", "Hello, World! don't I'LL we'Ve", "a<|endoftext|> b <|startoftext|>x<|endoftext|>",
    "  \n\n hi  there\t\x1c \x85x 　 y ", "ΣΑΣ İstanbul é é 日本語 12345 ½", "\x00\x01 \U0001f600 x̂ ﬁ", "ab" * 20_000, "same", "same",
    "Échanges über Ñandú ²³ª ÿ ȺȾ",
]


def frame(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "null id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long")


def test_token_counts_equal_the_library(spark):
    path = P.path("byte_bpe_50k.json")
    got = {r.doc_id: r for r in token_counts.count_tokens(frame(spark), path).collect()}
    lib = tokenizers.Tokenizer.from_file(path)
    for i, t in enumerate(TEXTS):
        assert got[i].n_tokens == len(lib.encode(t or "", add_special_tokens=False).ids), t
        assert got[i].n_bytes == len((t or "").encode())
    assert got[None].n_tokens == len(lib.encode("null id").ids)
    assert token_counts.count_tokens(frame(spark).limit(0), path).count() == 0


def test_bpe_equals_the_library(spark):
    path = P.path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.encode(frame(spark), path).collect()}
    dig = {r.doc_id: r for r in bpe.encode_digest(frame(spark), path).collect()}
    back = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(frame(spark), path), path).collect()}
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded == text == back[i]
        assert dig[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert dig[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(frame(spark).limit(0), path).count() == 0


def test_trie_states_equal_plain_merging():
    enc = bpe.TrieEncoder(P.path("word_bpe_49k.json"))
    words = {"a", "aa", "aaa", "aaaa", "banana", "bananas", "ba", "internationalization", "über", "ñandú", "qzxqzx", "thethethe", "日本"}
    for word, tokens in enc.encode_words(sorted(words)):
        path = "".join(enc.letters[b] for b in word.encode())
        assert tokens == enc.merged(enc.symbols(path + enc.end))
