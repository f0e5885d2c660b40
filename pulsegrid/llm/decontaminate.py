"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of a few dozen words and weighted by
TF-IDF, with document frequencies of the whole corpus. A randomised SVD of
these passages, computed in distributed passes, gives the latent space. Each
passage of each document is projected into it and compared with the benchmark
passages by cosine. A block has more passages than the space has directions, so
the space holds each of them only in part and even a verbatim copy may be far
from it there; the exact TF-IDF cosine, by posting lists of the benchmark's
words, is taken too, and either one makes a candidate. Candidates are then
checked word by word: by the longest common subsequence of the item and the
part of the text around the candidate, and by the item's answer, its last
sentence.

The cosines are shares of the whole passage vector, so words that no
benchmark item has count against a passage. The most that each word can add to
any cosine of either kind is known beforehand; the sums of those bounds along a
text pass over nearly all passages before any is compared, and lose none.

The benchmark is broadcast in blocks of bounded size, one pass over the corpus
for each block. The documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import _blocks
from ._common import keyed_text, mix64, staged

#: What is taken off both ends of a word.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’‚–—…¿¡·|"
#: Hashed TF-IDF features.
FEATURES = 1 << 17
PASSAGE = 24
#: Passages are as long as suits an item: so many words for items of at least so many. Texts move on by a quarter of a passage, items by half of one.
SPANS = ((20, PASSAGE), (10, 12), (0, 6))
#: Rank of the latent space, at most, and the extra columns of the random projection.
RANK, EXTRA, POWER = 192, 16, 2
#: Least cosine of a candidate, latent or exact.
COSINE = 0.55
#: An item is found if so much of it is there in order, or so much and its answer.
LCS, LCS_WITH_ANSWER, ANSWER = 0.7, 0.5, 0.9
#: Items in a block: their passages and vectors stay below 100 MB.
BLOCK_ITEMS = 5_000
_CHUNK = 1 << 12
#: Bytes of text that are cut into words at once.
_SLICE = 1 << 19
#: Cells of a table of exact cosines, passages of a text x passages of the block.
_CELLS = 1 << 20


def terms(text: str | None) -> list[str]:
    """Words in lower case without marks at their ends; pieces of marks alone do not count."""
    return [s for w in text.lower().split() if (s := w.strip(_MARKS))] if text else []


def _powers(base: int) -> np.ndarray:
    out = np.full(2 * _SLICE, base & (1 << 64) - 1, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_UP, _DOWN = [], []


def _hash_words(words: pa.Array) -> np.ndarray:
    """Feature numbers of words by a polynomial hash over their bytes, modulo 2^64; -1 for empty words."""
    if not _UP:
        _UP.append(_powers(_BASE)), _DOWN.append(_powers(pow(_BASE, -1, 1 << 64)))
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    out = np.empty(len(words), np.int64)
    lo = 0
    while lo < len(words):  # pieces that the table of powers covers; a longer word is hashed by itself
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + 2 * _SLICE, "right")) - 1)
        at = ends[lo : hi + 1] - ends[lo]
        piece = data[ends[lo] : ends[hi]]
        if len(piece) > 2 * _SLICE:
            out[lo] = xxhash.xxh64_intdigest(piece.tobytes()) % FEATURES
        else:
            prefix = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _UP[0][: len(piece)], out=prefix[1:])
            h = (prefix[at[1:]] - prefix[at[:-1]]) * _DOWN[0][np.minimum(at[:-1], 2 * _SLICE - 1)]
            out[lo:hi] = (mix64(h) >> np.uint64(40)).astype(np.int64) % FEATURES
        lo = hi
    out[ends[1:] == ends[:-1]] = -1
    return out


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words of some texts, and where each text's words begin and end (len + 1 numbers).

    The words are those of ``terms``, one by one; lower case is Arrow's, which
    differs from Python's only in the feature that a word falls on.
    """
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.string())))
    words = pc.utf8_trim(lists.flatten(), _MARKS)
    codes = _hash_words(words)
    bounds = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int64)
    real = codes >= 0
    return codes[real], np.r_[0, np.cumsum(real)][bounds]


def codes_of(text: str | None) -> np.ndarray:
    """Feature numbers of the words of one text."""
    return coded(pa.array([text], pa.string()))[0]


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of at most _SLICE bytes of text."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _SLICE, "right")))
            yield b.slice(at, to - at)
            at = to


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, and the number of documents; FEATURES numbers reach the driver."""
    n_parts = FEATURES // _CHUNK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for b in _slices(batches, 0):
            codes, bounds = coded(b.column(0))
            held = np.repeat(np.arange(b.num_rows) * FEATURES, np.diff(bounds)) + codes
            held = np.sort(held.astype(np.int32) if b.num_rows * FEATURES < 1 << 31 else held)
            df += np.bincount(held[np.r_[len(held) > 0, held[1:] != held[:-1]][: len(held)]] % FEATURES, minlength=FEATURES)
            n += b.num_rows
        at = np.flatnonzero(df)
        yield from _blocks.pack((at // _CHUNK).astype(np.int32), [at.astype(np.int32), df[at]])
        yield from _blocks.pack(np.zeros(1, np.int32), [np.array([-1], np.int32), np.array([n])])

    def add(part: int, held: dict) -> Iterator[pa.RecordBatch]:
        at, n = _blocks.joined(held[0], [np.int32, np.int64])
        total = np.bincount(at[at >= 0] - part * _CHUNK, n[at >= 0], _CHUNK).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([int(n[at < 0].sum())]), pa.array([total.tobytes()], pa.binary())], names=["part", "docs", "df"])

    found = _blocks.by_part(keyed_text(docs).select("text").mapInArrow(count, _blocks.BLOCK_DDL), n_parts, add, "part int, docs long, df binary")
    df, n = np.zeros(FEATURES, np.int64), 0
    for r in found.collect():
        df[r["part"] * _CHUNK : (r["part"] + 1) * _CHUNK] = np.frombuffer(r["df"], np.int64)
        n += r["docs"]
    return df, n


def span_of(n: int) -> int:
    """Words in a passage for an item of n words: in a much longer one, other words would outweigh the item's."""
    return next(span for least, span in SPANS if n >= least)


def cut(n: int, step: int, span: int = PASSAGE) -> list[int]:
    """Starts of the passages of a text of n words; the last one ends with the text."""
    if n <= span:
        return [0]
    return [*range(0, n - span, step), n - span]


def _rows(texts: list[str | None], idf: np.ndarray, span: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Normalised sparse passage vectors of the items among some that have passages of ``span`` words."""
    out = []
    for t in texts:
        c = codes_of(t)
        for s in cut(len(c), span // 2, span) if len(c) and span_of(len(c)) == span else ():
            f, n = np.unique(c[s : s + span], return_counts=True)
            w = n * idf[f]
            out.append((f, w / np.linalg.norm(w)))
    return out


def latent_space(items: DataFrame, idf: np.ndarray, vocabulary: np.ndarray, rank: int = RANK, span: int = PASSAGE) -> np.ndarray:
    """Right singular vectors (vocabulary x rank) of the items' passage matrix, by randomised subspace iteration.

    Each pass multiplies the distributed rows by a small dense matrix and sums
    the products; only matrices of vocabulary x (rank + EXTRA) reach the driver.
    """
    place = np.full(FEATURES, -1, np.int64)
    place[vocabulary] = np.arange(len(vocabulary))
    width = min(rank + EXTRA, len(vocabulary))
    spark = items.sparkSession
    rng = np.random.default_rng(11)
    q, _ = np.linalg.qr(rng.standard_normal((len(vocabulary), width)))

    def product(q: np.ndarray) -> np.ndarray:
        """(A'A) q"""
        shared = spark.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, total = shared.value, np.zeros(shared.value.shape)
            for b in batches:
                for f, w in _rows(b.column(0).to_pylist(), idf, span):
                    at = place[f]
                    total[at] += np.outer(w, w @ q[at])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

        # a few parts, whatever the number of items: each sends one matrix
        parts = items.select("text").repartition(min(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        return sum(np.frombuffer(r["m"]).reshape(q.shape) for r in parts.mapInArrow(run, "m binary").toLocalIterator())

    for _ in range(POWER):
        q, _ = np.linalg.qr(product(q))
    s, u = np.linalg.eigh(q.T @ product(q))
    keep = np.argsort(-s)[: min(rank, width)]
    keep = keep[s[keep] > 1e-10]
    return (q @ u[:, keep]).astype(np.float32)


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit rows."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = at.get(w, 0)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def answer_of(text: str | None) -> list[str]:
    """Words of the last sentence of three words or more; else all words."""
    for s in reversed(re.split(r"[.!?\n]+", text or "")):
        if len(ws := terms(s)) >= 3:
            return ws
    return terms(text)


@dataclass
class Index:
    """A block of benchmark items with their passages, all of ``span`` words, in the latent space."""

    span: int
    ids: list[int]
    #: rows of the benchmark that are equal to each item
    times: list[int]
    words: list[list[str]]
    answers: list[list[str]]
    idf: np.ndarray
    place: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    #: postings of each vocabulary word: from ``ptr``, the block's passages and the word's normalised weights there
    ptr: np.ndarray
    passage: np.ndarray
    weight: np.ndarray

    def __post_init__(self):
        # the most that one occurrence of a word can add to x . v over all passages v
        self.most = np.zeros(len(self.place))
        vocabulary = np.flatnonzero(self.place >= 0)
        for at in range(0, len(vocabulary), 4096):
            some = vocabulary[at : at + 4096]
            self.most[some] = np.abs(self.space[self.place[some]] @ self.vectors.T).max(axis=1, initial=0.0)
        self.most *= self.idf
        # the same for the exact cosine
        self.most_exact = np.zeros(len(self.place))
        self.most_exact[vocabulary] = np.maximum.reduceat(self.weight, self.ptr[self.place[vocabulary]])
        self.most_exact *= self.idf
        self.idf2 = self.idf.astype(np.float64) ** 2

    def exact(self, row: np.ndarray, at: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        """Products of n sparse vectors, as (row, vocabulary place, weight), with the block's passages."""
        size = self.ptr[at + 1] - self.ptr[at]
        ends = np.cumsum(size)
        post = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.ptr[at] - (ends - size), size)
        cell = np.repeat(row * len(self.item), size) + self.passage[post]
        return np.bincount(cell, np.repeat(w, size) * self.weight[post], n * len(self.item)).reshape(n, -1)

    def candidates(self, codes: np.ndarray) -> list[tuple[int, int, float]]:
        """(item, start of the item in the text, cosine) of the passages of one text."""
        return [c[1:] for c in self.candidates_of(codes, np.array([0, len(codes)]))]

    def candidates_of(self, codes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(text, item, start of the item in the text, cosine) of the passages of some texts, as ``coded`` gives them."""
        if not len(codes) or not len(self.item):
            return []
        # passages of all texts, as places in codes; the last one of a text ends with it
        n, span, step_by = np.diff(bounds), self.span, max(1, self.span // 4)
        count = np.where(n > span, -(-(n - span) // step_by) + 1, (n > 0).astype(np.int64))
        row = np.repeat(np.arange(len(n)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        starts = bounds[row] + np.minimum(step * step_by, np.maximum(n[row] - span, 0))
        ends = np.minimum(starts + span, bounds[row + 1])
        # upper bounds of the cosines with any passage: occurrences that count alone only shorten the vector
        sums = lambda v: np.r_[0, np.cumsum(v, dtype=np.float64)]
        known, sparse, whole = sums(self.most[codes]), sums(self.most_exact[codes]), sums(self.idf2[codes])
        least = COSINE * (1 - 1e-6) * np.sqrt(np.maximum(whole[ends] - whole[starts], 0)) - 1e-6
        by_latent, by_exact = known[ends] - known[starts] >= least, sparse[ends] - sparse[starts] >= least
        may = np.flatnonzero(by_latent | by_exact)
        out = []
        size = max(1, min(4096, _CELLS // len(self.item)))
        for lo in range(0, len(may), size):
            some = may[lo : lo + size]
            out += self._compared(codes, row[some], starts[some], ends[some], bounds)
        return out

    def _compared(self, codes, row, starts, ends, bounds) -> list[tuple[int, int, int, float]]:
        """The candidates among some passages."""
        m = len(starts)
        # sparse TF-IDF vectors: (passage, feature) with their counts
        lens = ends - starts
        who = np.repeat(np.arange(m), lens)
        at = np.arange(len(who)) - np.repeat(np.cumsum(lens) - lens, lens) + starts[who]
        key, times = np.unique(who * FEATURES + codes[at], return_counts=True)
        who, f = key // FEATURES, key % FEATURES
        w = times * self.idf[f]
        norm = np.sqrt(np.bincount(who, w * w, m))
        in_block = self.place[f] >= 0
        who, at, w = who[in_block], self.place[f[in_block]], w[in_block]
        # no cosine of either kind is above the share that the block's words have of the vector
        share = np.sqrt(np.bincount(who, w * w, m)) >= COSINE * (1 - 1e-6) * norm
        if not share.any():
            return []
        keep = share[who]
        number = np.cumsum(share) - 1
        who, at, w = number[who[keep]], at[keep], w[keep].astype(np.float32)
        row, starts, norm, m = row[share], starts[share], norm[share], int(share.sum())
        first = np.flatnonzero(np.r_[True, np.diff(who) != 0])  # each has a word: its share is above zero
        x = np.add.reduceat(self.space[at] * w[:, None], first, axis=0)
        cos = np.maximum((x @ self.vectors.T).astype(float), self.exact(who, at, w, m))
        cos /= np.maximum(norm, 1e-12)[:, None]
        k, j = np.nonzero(cos >= COSINE)
        begin = starts[k] - bounds[row[k]] - self.offset[j]
        return list(zip(row[k].tolist(), self.item[j].tolist(), begin.tolist(), cos[k, j].tolist(), strict=True))

    def hits(self, texts: pa.Array, codes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """(text, item id, best cosine, LCS share, answer share) of the items that some texts, coded as given, hold."""
        held: dict[int, dict[int, list[tuple[float, int]]]] = {}
        near = 2 * max(1, self.span // 4)
        for d, i, s, c in self.candidates_of(codes, bounds):
            held.setdefault(d, {}).setdefault(i, []).append((c, s))
        out = []
        for d, by_item in sorted(held.items()):
            ws = terms(texts[d].as_py())
            for i, found in sorted(by_item.items()):
                item, best, size = self.words[i], (0.0, 0.0), len(self.words[i])
                seen: set[int] = set()
                for _, s in sorted(found, key=lambda v: (-v[0], v[1])):  # the best cosine speaks for its place
                    if s // near in seen:
                        continue
                    seen.add(s // near)
                    around = ws[max(0, s - self.span) : max(0, s) + size + self.span]
                    share = lcs(item, around) / size
                    if share > best[0] or not best[0]:
                        best = max(best, (share, lcs(self.answers[i], around) / max(1, len(self.answers[i]))))
                if best[0] >= LCS or (best[0] >= LCS_WITH_ANSWER and best[1] >= ANSWER):
                    out += [(d, self.ids[i], max(c for c, _ in found), *best)] * self.times[i]
        return out


def build(items: DataFrame, idf: np.ndarray, rank: int = RANK, span: int = PASSAGE) -> Index | None:
    """Index of the items of a block (item_id, text) that have passages of ``span`` words; None if there is none."""
    rows = [(r["item_id"], r["text"], r["times"]) for r in _distinct(items).collect()]  # BLOCK_ITEMS, about
    rows = sorted((r for r in rows if (ws := terms(r[1])) and span_of(len(ws)) == span), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return None
    item, offset, passages = [], [], []
    for k, (_, t, _) in enumerate(rows):
        n = len(terms(t))
        for s in cut(n, span // 2, span):
            item.append(k), offset.append(s)
        passages += _rows([t], idf, span)
    vocabulary = np.unique(np.concatenate([codes_of(r[1]) for r in rows]))
    space = latent_space(items.where("text is not null"), idf, vocabulary, rank, span)
    place = np.full(FEATURES, -1, np.int64)
    place[vocabulary] = np.arange(len(vocabulary))
    vectors = np.stack([w @ space[place[f]] for f, w in passages]).astype(np.float32)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    at = np.concatenate([place[f] for f, _ in passages])
    order = np.argsort(at, kind="stable")
    passage = np.repeat(np.arange(len(passages)), [len(f) for f, _ in passages])[order]
    weight = np.concatenate([w for _, w in passages])[order]
    ptr = np.searchsorted(at[order], np.arange(len(vocabulary) + 1))
    return Index(span, [r[0] for r in rows], [r[2] for r in rows], [terms(r[1]) for r in rows], [answer_of(r[1]) for r in rows], idf.astype(np.float32), place, space, vectors, np.array(item), np.array(offset), ptr, passage, weight)


def _distinct(items: DataFrame) -> DataFrame:
    """Each item once, with the number of its rows."""
    if "times" in items.columns:
        return items
    return items.select("item_id", "text").groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("times"))


def _blocks_of(items: DataFrame, limit: int) -> list[DataFrame]:
    """The distinct items in blocks of about ``limit``, split by a hash."""
    items = _distinct(items)
    n = -(-items.count() // limit)
    at = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n)))
    return [items.where(at == k) for k in range(n)] if n > 1 else [items] * n


_KINDS = (("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64()))


def _hits(keyed: DataFrame, benchmark: DataFrame, block_items: int) -> DataFrame:
    """(key, item_id, cosine, lcs, answer) of texts (key, text) that hold items, one table of texts for each block of items."""
    spark = keyed.sparkSession
    ddl = f"key {dict(keyed.dtypes)['key']}, item_id long, cosine double, lcs double, answer double"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    df, n = document_frequencies(keyed.select(F.lit(None).alias("doc_id"), "text"))
    idf = np.log((1 + n) / (1 + df)) + 0.1
    out = None
    for block in _blocks_of(items, block_items):
        indexes = [i for _, span in SPANS if (i := build(block, idf, span=span)) is not None]
        if not indexes:
            continue
        shared = spark.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches, 1):
                codes, bounds = coded(b.column(1))
                found = sorted((h for index in shared.value for h in index.hits(b.column(1), codes, bounds)), key=lambda h: h[0])
                cols = list(zip(*found, strict=True)) or [()] * 5
                ids = b.column(0).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, kind) for c, (_, kind) in zip(cols[1:], _KINDS, strict=True))], ["key", *(name for name, _ in _KINDS)])

        got = keyed.mapInArrow(run, ddl)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], ddl)


def hits(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, cosine, lcs and answer for each document that holds a benchmark item.

    ``lcs`` is the share of the item's words found in order around the best
    candidate, ``answer`` that of its answer. Null texts and texts without
    words hold nothing, items without words are never found; rows that repeat
    each give their rows; an empty table gives an empty result. Other columns
    of both tables are ignored.
    """
    return _hits(keyed_text(docs).withColumnRenamed("doc_id", "key"), benchmark, block_items).withColumnRenamed("key", "doc_id")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of the table whose text holds no benchmark item, with all columns.

    Each row goes by its own text, known by its digest: rows without a doc_id
    are removed like others, and of rows that share one only those that hold
    an item. Null texts stay.
    """
    digest = F.sha2(F.col("text").cast("string").cast("binary"), 256)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest.alias("_id"))
    found = staged(_hits(docs.select(digest.alias("key"), F.col("text").cast("string").alias("text")), benchmark, BLOCK_ITEMS).select(F.col("key").alias("_held")).distinct(), "held")
    kept = whole.join(found, F.col("_id") == F.col("_held"), "left_anti")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
