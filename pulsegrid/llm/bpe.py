"""BPE encoding and decoding by a walk over the trie of distinct words.

The last token of a word's BPE encoding depends only on the prefix that ends
there: it is the one token that ends at that place and stands next to the last
token of the rest as BPE itself would leave the two. So a trie of the distinct
words needs one state per node, its last token, and a depth-first walk computes
the encoding of each shared prefix once. Following the last tokens backwards
spells the encoding of a word.

The words are sorted, which lists the trie in depth-first order: the common
prefix with the word before is the path that is kept on the stack, the rest are
new nodes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import keyed_text
from .token_counts import _blocks

#: The pre-tokenizer's rule as the vocabulary file gives it (fixed value).
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts of these characters are normalised and cut here, all others by the library.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-įı-ɏ]*")
#: The rule for those, once they are in lower case: letters and numbers of that range, written out.
_LETTERS, _NUMBERS = "".join(chr(c) for c in range(0x24F + 1) if chr(c).isalpha()), "".join(chr(c) for c in range(0x24F + 1) if chr(c).isnumeric())
_PLAIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}ⱥⱦ]+|[{_NUMBERS}]|[^\s{_LETTERS}ⱥⱦ{_NUMBERS}]+")
#: Distinct words that a worker remembers at once.
REMEMBER = 250_000

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes themselves, then the code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class TrieEncoder:
    """Encoder for a word-level BPE file of ``tokenizers`` (end-of-word suffix, no continuing prefix)."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        self.longest = max((len(t) for t in self.vocab), default=1)
        #: token → rank of the merge that made it, and its two halves
        self.made = {x + y: (i, x, y) for i, (x, y) in enumerate(merges)}
        if len(self.made) != len(merges):
            raise ValueError("two merges make the same token; last-token states need one")
        self.usable = {t for t in self.vocab if self.whole(t)}
        self.beside: dict[tuple[str, str], bool] = {}
        #: word → ids, and pieces, as text joined by a space
        self.ids: dict[str, str] = {}
        self.pieces: dict[str, str] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the pair of the lowest rank first, the leftmost of equals."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: (self.rank.get((symbols[i], symbols[i + 1]), len(self.rank)), i))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def whole(self, token: str) -> bool:
        """Does BPE build this token from its own letters?"""
        return self.merged(self.symbols(token)) == [token]

    def fits(self, left: str, token: str) -> bool:
        """Does BPE leave ``left`` and ``token`` as they are, side by side?

        The merges that made the two are undone, the latest first. At each
        moment the two symbols at the border must not have been due to merge
        before the merge that is being undone; of equal merges the one further
        left comes first.
        """
        rank, made, limit = self.rank, self.made, len(self.rank) + 1
        while True:
            if rank.get((left, token), limit) < limit:
                return False
            a, b = made.get(left), made.get(token)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                limit, left = a[0], a[2]
            else:
                limit, token = b[0] + 1, b[1]

    def step(self, path: str, states: list[str | None], at: int, end: bool) -> str | None:
        """Last token of ``path[:at]``; ``end``: the word ends there. None: no token fits."""
        beside = self.beside
        for start in range(max(0, at - self.longest), at):
            token = path[start:at]
            if end:
                token += self.end
            if token in self.usable:
                if not start:
                    return token
                left = states[start]
                if left is None:
                    continue
                key = (left, token)
                found = beside.get(key)
                if found is None:
                    if len(beside) > 300_000:
                        beside.clear()
                    found = beside[key] = self.fits(left, token)
                if found:
                    return token
        return None

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """Encodings of distinct words, in sorted order; each shared prefix is computed once."""
        letters = self.letters
        paths = sorted(("".join(letters[b] for b in w.encode()), w) for w in words)
        states: list[str | None] = [None]
        before = ""
        for path, word in paths:
            shared, most = 0, min(len(before), len(path) - 1)
            while shared < most and before[shared] == path[shared]:
                shared += 1
            shared = min(shared, len(states) - 1)
            del states[shared + 1 :]
            for at in range(shared + 1, len(path)):
                states.append(self.step(path, states, at, end=False))
            last = self.step(path, states, len(path), end=True)
            before = path
            yield word, self.spelled(path, states, last)

    def spelled(self, path: str, states: list[str | None], last: str | None) -> list[str]:
        out, at, suffix = [], len(path), self.end
        while at > 0:
            if last is None:  # a letter outside the vocabulary: plain BPE drops what it does not know
                return [t for t in self.merged(self.symbols(path + self.end)) if t in self.vocab]
            out.append(last)
            at -= len(last) - len(suffix)
            last, suffix = states[at], ""
        return out[::-1]

    def cut(self, text: str) -> list[str]:
        """Words of a text, special strings among them."""
        if self.special_re is not None and self.special_re.search(text):
            out: list[str] = []
            at = 0
            for m in self.special_re.finditer(text):
                out += self.cut_plain(text[at : m.start()])
                out.append(m[0])
                at = m.end()
            return out + self.cut_plain(text[at:])
        return self.cut_plain(text)

    def cut_plain(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _PLAIN_WORDS.findall(text.lower())
        text = self.tokenizer.normalizer.normalize_str(text)
        back = {c: b for b, c in enumerate(self.letters)}
        return [bytes(back[c] for c in w).decode() for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, words: set[str]) -> None:
        if len(self.ids) > REMEMBER:
            self.ids.clear()
            self.pieces.clear()
        vocab, ids, pieces = self.vocab, self.ids, self.pieces
        for w in self.special.keys() & words:
            ids[w], pieces[w] = str(self.special[w]), w
        for w, tokens in self.encode_words(words.difference(ids)):
            ids[w] = " ".join([str(vocab[t]) for t in tokens])
            pieces[w] = " ".join(tokens)

    def encoded(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Number of tokens, ids joined by a space, decoded text."""
        for block in _blocks(texts):
            cut = [self.cut(t or "") for t in block]
            self.learn(set().union(*cut))
            for ws in cut:
                if all(map(self.ids.__getitem__, set(ws))):
                    ids = " ".join(map(self.ids.__getitem__, ws))
                    yield ids.count(" ") + 1 if ids else 0, ids, " ".join(map(self.pieces.__getitem__, ws))
                else:  # a word of no token at all leaves nothing
                    some = [w for w in ws if self.ids[w]]
                    ids = " ".join(map(self.ids.__getitem__, some))
                    yield ids.count(" ") + 1 if ids else 0, ids, " ".join(map(self.pieces.__getitem__, some))


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


#: Characters of decoded text in a batch of results, about.
RESULT = 4_000_000


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of every document.

    A null or empty text has no tokens and decodes to the empty text; repeated
    rows each give a row; other columns are ignored. Results leave in batches
    of bounded size, with the ids as one flat array.
    """

    def pack(rows: list[tuple[int | None, int, str, str]]) -> pa.RecordBatch:
        flat = np.fromstring(" ".join(r[2] for r in rows if r[2]), np.int32, sep=" ")
        ends = np.cumsum([0, *(r[1] for r in rows)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), ids, pa.array([r[3] for r in rows], pa.string())], names=SCHEMA.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows, size = [], 0
            for d, got in zip(b.column(0).to_pylist(), enc.encoded(b.column(1).to_pylist()), strict=True):
                rows.append((d, *got))
                size += len(got[2])
                if size > RESULT:
                    yield pack(rows)
                    rows, size = [], 0
            if rows:
                yield pack(rows)

    return keyed_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """Like :func:`encode`, with SHA-256 digests of the ids and the decoded text in place of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n, a, d = [], [], []
            for k, ids, text in enc.encoded(b.column(1).to_pylist()):
                n.append(k)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                d.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], schema=DIGEST)

    return keyed_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text for rows of doc_id and ids; a null list decodes to the empty text, unknown ids vanish."""
    from pyspark.sql import functions as F

    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = encoder(path).names
        for b in batches:
            text = [" ".join(names[i] for i in ids or () if i in names) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], schema=schema)

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, decoded string")
