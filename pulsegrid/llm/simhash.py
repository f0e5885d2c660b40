"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints of 64 bits link if they differ in at most ``distance`` bits. The
64 bits are cut into fields; two linked fingerprints differ in few bits of at
least one field (the pigeonhole threshold of that field). In each field the
codewords of a linear code with a small covering radius are the anchors: a
fingerprint is at home at its nearest anchor, and is replicated to every anchor
within covering radius plus threshold, so it meets at home everyone within the
threshold. Fingerprints are compared at each anchor, homes with visitors, by
their full 64 bits.

Fields of 23 bits use the perfect Golay code (radius 3), the field of 18 bits
a Hamming code of 15 bits beside three free bits (radius 1). Error patterns
are listed by syndrome, so the anchors of a fingerprint are found by table.

Equal fingerprints are one node, so copies cost nothing. Anchors with many
homes are split: each slice of homes meets all visitors. An anchor gives out a
spanning forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import re
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import _blocks
from ._common import keyed_text, staged
from ._components import components

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()
SEED = 42
#: Homes at one slice of an anchor, about.
SLICE = 4096


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of word shingles, ASCII letters in lower case; no words: 0."""
    ws = _WORDS.findall(text.encode().lower()) if text else ()
    if not ws:
        return 0
    n = max(1, len(ws) - shingle + 1)
    whole = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws])
    starts = [0, *ends[: n - 1].tolist()]
    f = xxhash.xxh64_intdigest
    h = np.array([f(whole[a : b - 1], SEED) for a, b in zip(starts, ends[-n:].tolist(), strict=True)], np.uint64)
    lanes = _LANES[h.view(np.uint8).reshape(n, 8)]  # a byte for each bit
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 255):
        counts += lanes[at : at + 255].sum(axis=0).view(np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _digest(text):
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")), text.isNull())


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, h (a digest that tells texts of one id apart) and fp (the 64 bits as a signed long)."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], schema=schema)

    return keyed_text(docs).withColumn("h", _digest(F.col("text"))).mapInArrow(run, "doc_id long, h long, fp long")


class Code:
    """A linear code given by the columns of its parity check, as anchors of one field."""

    def __init__(self, shift: int, columns: list[int], radius: int, threshold: int):
        self.shift, self.bits, self.radius, self.threshold = shift, len(columns), radius, threshold
        self.mask = np.uint64((1 << self.bits) - 1)
        checks = max(columns).bit_length()
        cols = np.array(columns, np.uint64)
        half = self.bits // 2
        self.half = half
        self.low, self.high = (self._syndromes(c) for c in (cols[:half], cols[half:]))
        patterns = [(0, 0, 0)]
        for w in range(1, radius + threshold + 1):
            for at in combinations(range(self.bits), w):
                s = e = 0
                for i in at:
                    s, e = s ^ columns[i], e | 1 << i
                patterns.append((s, w, e))
        patterns.sort()
        syndromes = np.array([p[0] for p in patterns])
        self.errors = np.array([p[2] for p in patterns], np.uint64)
        self.first = np.searchsorted(syndromes, np.arange((1 << checks) + 1))
        nearest = self.first[:-1]
        if (np.diff(self.first) == 0).any() or max(patterns[i][1] for i in nearest) > radius:
            raise ValueError("the code does not cover its field within the radius")

    @staticmethod
    def _syndromes(columns: np.ndarray) -> np.ndarray:
        out = np.zeros(1, np.uint64)
        for c in columns:
            out = np.concatenate([out, out ^ c])
        return out

    def anchors(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the fingerprint, anchor, whether it is home), for each anchor within reach."""
        v = (fps >> np.uint64(self.shift)) & self.mask
        s = self.low[v & np.uint64((1 << self.half) - 1)] ^ self.high[v >> np.uint64(self.half)]
        first = self.first[s.astype(np.int64)]
        n = self.first[s.astype(np.int64) + 1] - first
        at = np.repeat(np.arange(len(fps)), n)
        step = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        return at, v[at] ^ self.errors[np.repeat(first, n) + step], step == 0


def golay_columns() -> list[int]:
    """Remainders of x^i by the generator polynomial of the (23, 12) Golay code."""
    out, r = [], 1
    for _ in range(23):
        out.append(r)
        r <<= 1
        if r >> 11:
            r ^= 0b101011100011
    return out


@lru_cache(maxsize=4)
def codes(distance: int) -> tuple[Code, ...]:
    """The three fields with their codes, for a distance of up to 5 bits."""
    if not 0 <= distance <= 5:
        raise ValueError("distance must be 0 to 5")
    t = distance // 3
    return Code(0, golay_columns(), 3, t), Code(23, golay_columns(), 3, t), Code(46, [*range(1, 16), 0, 0, 0], 1, t)


class Forest:
    """Union-find over numbers below n, the smallest as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def close_pairs(homes: np.ndarray, visitors: np.ndarray, distance: int, cells: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the distance, block by block."""
    rows = max(1, cells // max(1, len(visitors)))
    for at in range(0, len(homes), rows):
        near = np.bitwise_count(homes[at : at + rows, None] ^ visitors[None, :]) <= distance
        i, j = np.nonzero(near)
        yield i + at, j


def _keys(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = []
    for k, code in enumerate(codes(distance)):
        at, anchor, home = code.anchors(fps)
        got.append((at, anchor | np.uint64(k << 32), home))
    return tuple(np.concatenate(c) for c in zip(*got, strict=True))


def _part(keys: np.ndarray, n_parts: int) -> np.ndarray:
    from ._common import mix64

    return (mix64(keys) % np.uint64(n_parts)).astype(np.int32)


def links(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b) node numbers whose fingerprints are within the distance: at least a spanning forest.

    ``nodes`` has a number ``node`` and a distinct ``fp`` in each row.
    """
    spark = nodes.sparkSession
    n_parts = _blocks.parts(spark)
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, keys, home = _keys(b.column(1).to_numpy().view(np.uint64), distance)
            k, n = np.unique(keys[home], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n)], schema=schema)

    # at most one row for each anchor: 4096 + 4096 + 16384 of them
    busy = nodes.select("node", "fp").mapInArrow(homes, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > SLICE)
    slices = {r["key"]: -(-r["n"] // SLICE) for r in busy.collect()}
    hot = np.array(sorted(slices), np.uint64)
    times = np.array([slices[int(k)] for k in hot], np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fps = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            at, keys, home = _keys(fps, distance)
            if len(hot):
                where = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
                n = np.where(hot[where] == keys, times[where], 1)
                own = ((fps[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % n
                at, keys, home, own = (np.repeat(x, n) for x in (at, keys, home, own))
                slice_ = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                home = home & (slice_ == own)
                keys = keys | (slice_.astype(np.uint64) << np.uint64(34))
            yield from _blocks.pack(_part(keys, n_parts), [keys, fps[at], node[at], home.astype(np.uint8)])

    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(_: int, held: dict) -> Iterator[pa.RecordBatch]:
        keys, fps, node, home = _blocks.joined(held[0], [np.uint64, np.uint64, np.int64, np.uint8])
        order = np.lexsort((node, keys))
        keys, fps, node, home = keys[order], fps[order], node[order], home[order].astype(bool)
        cut = np.flatnonzero(np.diff(keys)) + 1
        a, b = [], []
        for lo, hi in zip(np.r_[0, cut], np.r_[cut, len(keys)], strict=True):
            at_home = np.flatnonzero(home[lo:hi])
            if hi - lo < 2 or not len(at_home):
                continue
            forest = Forest(hi - lo)
            for i, j in close_pairs(fps[lo:hi][at_home], fps[lo:hi], distance):
                i = at_home[i]
                some = i != j
                for x, y in zip(i[some].tolist(), j[some].tolist(), strict=True):
                    if forest.join(x, y):
                        a.append(node[lo + x])
                        b.append(node[lo + y])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out)

    sent = nodes.select("node", "fp").mapInArrow(send, _blocks.BLOCK_DDL)
    return _blocks.by_part(sent, n_parts, meet, "a long, b long")


def groups(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, h (a digest of the text), fp, root (the component's number) and component_id (the smallest doc_id reachable) of every row.

    Null and empty texts have the fingerprint zero and link like any other;
    texts of fewer words than a shingle hash as a whole; repeated rows are in
    one component; rows without a doc_id take the component of their
    fingerprint, null if no row of it has a doc_id. Other columns are ignored.
    """
    prints = staged(fingerprints(docs, shingle), "fingerprints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp")), "nodes")
    roots = components(links(nodes.select("node", "fp"), distance))
    rooted = staged(nodes.join(roots, "node", "left").select(F.col("fp").alias("fp2"), F.coalesce("root", "node").alias("root"), "least"), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    rooted = staged(rooted.drop("least").join(least, "root"), "components")
    return prints.join(rooted, F.col("fp") == F.col("fp2"), "left").select("doc_id", "h", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """One row of each component: that of the smallest doc_id, of several such the one with the smallest digest of its text.

    Rows without a doc_id go where a row of their component has one. Rows
    that repeat a doc_id and its text give one; rows that share a doc_id but lie
    in different components each stay. All columns stay, whatever their names.
    """
    grouped = groups(docs, distance, shingle)
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("one"))
    # plain equalities, so that one partitioning serves the join and what follows
    keyed = lambda c: [F.coalesce(c, F.lit(0)).alias("_k"), c.isNull().alias("_n")]
    stay = staged(first.select(*keyed(F.col("one.doc_id")), F.col("one.h").alias("_h")).distinct(), "stay")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *keyed(F.col("doc_id").cast("long")), _digest(F.col("text")).alias("_h"))
    kept = whole.join(stay, ["_k", "_n", "_h"], "left_semi").dropDuplicates(["_k", "_n", "_h"])
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
