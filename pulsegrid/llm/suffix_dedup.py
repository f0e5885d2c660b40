"""Removal of byte strings that occur earlier, by bucket-pointer refinement.

Neighbouring 100-byte strings that elect one 36-byte gram form a group; the
first buckets are those grams (:mod:`._repeats`). A bucket in which all groups
span the same bytes (compared by a hash) is done: nothing in it can differ
later. In every other bucket the positions of the first group of each kind are
opened, and refined in rounds: the buckets of their first 8 bytes are sorted by
the bucket pointers 8, 16, 32 and last 36 bytes further on, each round reading
the pointers that the one before has written, and taking only positions that
are not alone (:mod:`._buckets`).

Refinement is exact and stays within what a task has opened, so that a gram
that a third of all rows hold is refined in many tasks. What is left of each
bucket, once for a task, meets the other tasks' by name: a hash of its first 64
bytes, and for the last round that of the 64 bytes that begin 36 bytes further
on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _blocks, _repeats

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
KEPT = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary())])


def _maker(length: int, gram: int | None):
    gram = gram or max(1, min(36, length // 2))
    return lambda: _repeats.Bytes(length, gram)


def _digest(kind, symbols, gone):
    spans = int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
    return len(symbols), int(gone.sum()), spans, hashlib.sha256(kind.kept(symbols, gone)).hexdigest()


def _kept(kind, symbols, gone):
    return (kind.kept(symbols, gone),)


def remove(docs: DataFrame, length: int = 100, gram: int | None = None, digest: bool = True) -> DataFrame:
    """Each document without the bytes covered by a ``length``-byte string that also starts earlier.

    Earlier: at a smaller doc_id, or in the same document further left; strings
    never cross documents and are judged on the input. With ``digest``: doc_id,
    n_bytes, n_removed, n_spans, kept_sha256; without: doc_id and the ``kept``
    bytes. Null and empty texts have no bytes. A row that repeats a doc_id and
    its text counts as the same document and gets the same result; rows that
    share only the doc_id are ordered by a digest of their text. Rows without a
    doc_id come last, by a digest of their text. A text's length is not
    limited; an empty table gives an empty result. Other columns are ignored.
    """
    n_parts, make = _blocks.parts(docs.sparkSession), _maker(length, gram)
    found, _, _ = _repeats.marks(docs, make, n_parts)
    if digest:
        return _repeats.removed(docs, found, make, n_parts, _digest, SCHEMA, DDL)
    return _repeats.removed(docs, found, make, n_parts, _kept, KEPT, "doc_id long, kept binary")
