"""Token counts without token ids.

Texts fall into pre-tokens. Each distinct pre-token of a task is measured once,
its number of pieces is joined to the frequency of the pre-token in each
document, and the products are summed. No list of ids is ever built, and the
plan has no shuffle: a document's count depends on nothing but its own text, so
the dictionary of distinct pre-tokens is kept per worker and bounded.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from ._common import keyed_text

#: The byte-level pre-tokenizer's rule, as published with the vocabulary (fixed value), for texts of
#: Latin letters, with their letters and numbers written out. Other texts are cut by the library.
_L, _N = ("".join(chr(c) for c in range(0x24F + 1) if kind(chr(c))) for kind in (str.isalpha, str.isnumeric))
_PLAIN_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ]*")
#: Distinct pre-tokens that a worker remembers at once.
REMEMBER = 400_000

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_distinct", pa.int64())])


class PieceCounter:
    """Pieces of distinct pre-tokens, for a byte-level BPE file of ``tokenizers``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.known: dict[str, int] = {}

    def pre_tokens(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _PLAIN_PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str) -> tuple[Counter, int]:
        """Frequencies of the pre-tokens, and how often special strings occur."""
        if self.special is None or not self.special.search(text):
            return Counter(self.pre_tokens(text)), 0
        parts = self.special.split(text)
        return Counter(chain.from_iterable(self.pre_tokens(p) for p in parts if p)), len(parts) - 1

    def learn(self, pieces: set[str]) -> None:
        """Measure pre-tokens that have not been seen, once each."""
        if len(self.known) > REMEMBER:
            self.known.clear()
        new = [p for p in pieces if p not in self.known]
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[p] = len(e)


@lru_cache(maxsize=2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def _blocks(texts: list[str | None], limit: int = 2_000_000) -> Iterator[list[str | None]]:
    """Runs of texts of bounded total length; a longer text stands alone."""
    block, size = [], 0
    for t in texts:
        if block and size + len(t or "") > limit:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t or "")
    if block:
        yield block


def count_batch(counter: PieceCounter, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct pre-tokens of each text: a join of two frequency tables, by codes."""
    total, distinct = [], []
    for block in _blocks(texts):
        freq = [counter.split(t or "") for t in block]
        counter.learn(set().union(*(f.keys() for f, _ in freq)))
        known = counter.known
        for f, special in freq:
            total.append(special + sum(map(int.__mul__, map(known.__getitem__, f), f.values())))
            distinct.append(len(f))
    return np.array(total, np.int64), np.array(distinct, np.int64)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and n_distinct (distinct pre-tokens) of every text.

    A null or empty text has 0 bytes and 0 tokens; repeated rows each give a
    row; a null doc_id stays null; an empty table gives an empty result. Other
    columns are ignored. Special strings inside a text count as the one token
    they are, as is the library's default.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for b in batches:
            text = b.column(1)
            n_bytes = pc.fill_null(pc.binary_length(text.cast(pa.binary())), 0).cast(pa.int64())
            total, distinct = count_batch(counter, text.to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, pa.array(total), pa.array(distinct)], schema=SCHEMA)

    return keyed_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, n_distinct long")
