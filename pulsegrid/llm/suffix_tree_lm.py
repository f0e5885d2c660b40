"""Language-model scores by a probabilistic suffix tree over words.

States of the tree are contexts of up to ``depth`` words, reached from the last
word backwards. A context is kept if its next-word distribution diverges from
that of the longest kept suffix. A kept context knows the next words that
follow it often enough; the rest of its mass goes to its suffix (absolute
discounting), and at the root to add-one unigram probabilities. A token is
scored in the longest kept suffix of its history.

Frequencies are counted over all training rows. A context, a next word or a word
has a number if it occurs :func:`floor` times: a count that grows with the
corpus to the power of two thirds, so the tables of the tree grow with its cube
root and the driver can hold them. Tasks get them in blocks of at most
MOST_ENTRIES continuations, by the last word of the context; each block is a
pass of its own over the texts, and a text's gains add up. Words without a
number, most of a vocabulary, meet their counts by key, in packed blocks.

Words are known by 64 bits of hash.
"""

from __future__ import annotations

import weakref
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import _blocks
from ._common import mix64, staged
from ._repeats import NO_ID_TAG, Hasher, _part, _read

#: Absolute discount of a retained continuation.
DISCOUNT = 0.75
#: A context is kept if its distribution is this far from its suffix's (relative entropy, bits).
DIVERGENCE = 0.01
#: Words in a context at most.
DEPTH = 4
#: Continuations in a block of the tree: 64 MB of them.
MOST_ENTRIES = 4_000_000
#: Bytes of text that are cut into words at once, and of a word that is hashed with others.
_SLICE, _LONG = 1 << 21, 1 << 20
#: Distinct words or continuations that a task sums up before it sends them.
_HELD = 1_000_000


@dataclass(frozen=True)
class Floors:
    """Tokens from which on a word, a context and a continuation have to occur more than once, more than that ever more often."""

    word: float = 1e6
    context: float = 1e4
    next: float = 1e6


def floor(total: int, base: float) -> float:
    return max(2.0, (total / base) ** (2 / 3))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = mix64(np.arange(1, 257, dtype=np.uint64) + np.uint64(5 << 32))
_HASHER: list[Hasher] = []


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words that stand at some places of a text."""
    if not _HASHER:
        _HASHER.append(Hasher(0x9E3779B97F4A7C15, 2 * _LONG + 1))
    out = np.zeros(len(starts), np.uint64)
    cut = np.flatnonzero(np.diff(starts // _LONG)) + 1
    for lo, hi in zip(np.r_[0, cut].tolist(), np.r_[cut, len(starts)].tolist(), strict=True):
        if lo == hi:
            continue
        begin = int(starts[lo])
        if ends[hi - 1] - starts[hi - 1] > _LONG:  # only the last word of a piece can reach so far
            hi -= 1
            out[hi] = xxhash.xxh3_64_intdigest(data[starts[hi] : ends[hi]].tobytes())
            if lo == hi:
                continue
        prefix = _HASHER[0].prefix(_CODES[data[begin : ends[hi - 1]]])
        out[lo:hi] = mix64(_HASHER[0].spans(prefix, starts[lo:hi] - begin, ends[lo:hi] - begin))
    return out


#: The end of a text is a token; no word has this hash but by chance.
END = np.uint64(0xFFFFFFFFFFFFFFFF)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of some texts, A-Z in lower case, and where each text's begin and end (len + 1 numbers)."""
    whole = pc.binary_join_element_wise(pc.fill_null(texts, "").cast(pa.binary()), b"", b"\n")
    bounds = np.frombuffer(whole.buffers()[1], np.int32, len(whole) + 1, 4 * whole.offset).astype(np.int64)
    data = _LOWER[np.frombuffer(whole.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]] if len(whole) else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    space = _SPACE[data]
    edge = np.diff(np.r_[np.int8(1), space.astype(np.int8)])
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)  # each text ends with a line feed
    row = np.searchsorted(bounds, starts, "right") - 1
    out = np.full(len(starts) + len(whole), END, np.uint64)
    out[np.arange(len(starts)) + row] = _hashes(data, starts, ends)
    return out, np.r_[0, np.cumsum(np.bincount(row, minlength=len(whole)) + 1)].astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of at most _SLICE bytes of text."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _SLICE, "right")))
            yield b.slice(at, to - at)
            at = to


class _Table:
    """Places of distinct keys by open addressing, looked up many at a time."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot, self.key = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, keys.dtype)
        left, at = np.arange(len(keys)), self._start(keys)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]  # of several the last stays
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask
        held = self.slot >= 0
        self.key[held] = keys[self.slot[held]]

    def _start(self, x: np.ndarray) -> np.ndarray:
        return ((x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self._start(np.ascontiguousarray(x))
        place = self.slot[at]
        found = (self.key[at] == x) & (place >= 0)
        left = np.flatnonzero(~found & (place >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            there = self.slot[at]
            hit = (self.key[at] == x[left]) & (there >= 0)
            place[left[hit]], found[left[hit]] = there[hit], True
            on = ~hit & (there >= 0)
            left, at = left[on], at[on]
        return np.where(found, place, 0).astype(np.int64), found


#: Tables of the arrays that a worker looks things up in, by the array; a table goes with its array.
_TABLES: dict[int, tuple[weakref.ref, _Table]] = {}


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x among distinct keys, 0 where there is none, and whether there is one."""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = id(keys)
    if at not in _TABLES or _TABLES[at][0]() is not keys:
        _TABLES[at] = weakref.ref(keys, lambda _: _TABLES.pop(at, None)), _Table(keys)
    return _TABLES[at][1].find(x.astype(keys.dtype, copy=False))


@dataclass
class Order:
    """The contexts of some number of words, and their continuations.

    A context's key is its suffix's place among the contexts of one word less,
    times the number of words, plus the word in front; ``rows`` are the places of
    the keys at hand. An entry's key is its context's place, times the number of
    words, plus the next word.
    """

    keys: np.ndarray
    rows: np.ndarray
    kept: np.ndarray
    left: np.ndarray
    entry: np.ndarray
    full: np.ndarray
    gain: np.ndarray


@dataclass
class Tree:
    """Words with a number, sorted by hash, and the contexts by their length."""

    words: np.ndarray
    counts: np.ndarray
    total: int
    vocabulary: int
    orders: list[Order] = field(default_factory=list)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for those without."""
        at, found = _find(self.words, hashes)
        return np.where(found, at, -1)

    def root(self) -> np.ndarray:
        return np.log10((self.counts + 1) / (self.total + self.vocabulary + 1))

    def places(self, ids: np.ndarray, bounds: np.ndarray, orders: list[Order]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order, the tokens whose history ends in one of its contexts, and the context's place."""
        start = np.repeat(bounds[:-1], np.diff(bounds))
        at = np.arange(len(ids))
        node = np.zeros(len(ids), np.int64)
        for k, o in enumerate(orders, 1):
            some = at - k >= start[at]
            at, node = at[some], node[some]
            word = ids[at - k]
            known = word >= 0
            at, node, word = at[known], node[known], word[known]
            place, found = _find(o.keys, node * len(self.words) + word)
            at, node = at[found], o.rows[place[found]]
            yield at, node

    def gains(self, ids: np.ndarray, bounds: np.ndarray, orders: list[Order] | None = None) -> np.ndarray:
        """log10 of each token's probability over its unigram one."""
        out = np.zeros(len(ids))
        orders = self.orders if orders is None else orders
        for o, (at, node) in zip(orders, self.places(ids, bounds, orders)):
            kept = o.kept[node]
            at, node = at[kept], node[kept]
            entry, there = _find(o.entry, node * len(self.words) + ids[at])
            there &= ids[at] >= 0
            out[at] = np.where(there, o.gain[entry] if len(o.gain) else 0.0, out[at] + o.left[node])
        return out

    def probability(self, order: int, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Probability of the words after the contexts (places among those of ``order`` words)."""
        if not order:
            return 10.0 ** self.root()[word]
        o = self.orders[order - 1]
        below = self.probability(order - 1, o.keys[node] // len(self.words), word)
        entry, there = _find(o.entry, node * len(self.words) + word)
        mine = np.where(there, o.full[entry] if len(o.full) else 0.0, 10.0 ** o.left[node] * below)
        return np.where(o.kept[node], mine, below)

    def block(self, k: int, n: int) -> list[Order]:
        """The contexts whose last word falls on block k of n, with what is known of them."""
        out, last = [], None
        V = len(self.words)
        for o in self.orders:
            last = o.keys % V if last is None else last[o.keys // V]
            mine = mix64(last.astype(np.uint64)) % np.uint64(n) == np.uint64(k)
            entries = mine[o.entry // V]
            out.append(Order(o.keys[mine], np.flatnonzero(mine), o.kept, o.left, o.entry[entries], o.full[:0], o.gain[entries]))
        return out


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]][: len(key)])
    return key[first], np.add.reduceat(n, first) if len(first) else n[:0]


class _Sums:
    """Counts by key, summed up; what is held is bounded."""

    def __init__(self, n_parts: int):
        self.n_parts, self.held, self.size = n_parts, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        s = np.sort(keys)
        first = np.flatnonzero(np.r_[len(s) > 0, s[1:] != s[:-1]][: len(s)])
        self.held.append((s[first], np.diff(np.r_[first, len(s)]).astype(np.int64)))
        self.size += len(first)
        if self.size > 2 * _HELD:
            k, n = _summed(*(np.concatenate(c) for c in zip(*self.held, strict=True)))
            self.held, self.size = [(k, n)], len(k)
            if self.size > _HELD:
                yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            k, n = _summed(*(np.concatenate(c) for c in zip(*self.held, strict=True)))
            yield from _blocks.pack((mix64(k) % np.uint64(self.n_parts)).astype(np.int32), [k.view(np.uint64), n.astype(np.uint32)])
        self.held, self.size = [], 0


_COUNTED = (np.uint64, np.uint32)
#: Kinds of blocks: counts of words, their sum and number, own values of a row, its words without a number.
WORDS, SIZES, OWN, RARE = range(4)
OWN_T = (np.int64, np.uint32, np.uint8, np.uint32, np.uint32, np.uint32, np.float64, np.float64)
RARE_T = (np.uint64, np.int64, np.uint32, np.uint32)


def _word_counts(train: DataFrame, n_parts: int) -> DataFrame:
    """Sorted blocks of (word, count) by part, and of each part's sum and number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(n_parts)
        for b in _slices(batches, 0):
            yield from sums.add(tokens(b.column(0))[0])
        yield from sums.send()

    def add(part: int, held: dict) -> Iterator[pa.RecordBatch]:
        h, n = _blocks.joined(held[0], _COUNTED)
        h, n = _summed(h, n.astype(np.int64))
        yield from _blocks.pack(np.full(len(h), part, np.int32), [h, n], WORDS)
        yield from _blocks.pack(np.full(1, part, np.int32), [np.array([n.sum()]), np.array([len(n)])], SIZES)

    return staged(_blocks.by_part(train.mapInArrow(count, _blocks.BLOCK_DDL), n_parts, add, _blocks.BLOCK_DDL), "words")


def _frequent(words: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Words that occur ``least`` times, by hash."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, block in zip(b.column("n").to_pylist(), b.column("block").to_pylist(), strict=True):
                h, c = _blocks.unpack(n, block, (np.uint64, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(h[c >= least].view(np.int64)), pa.array(c[c >= least])], names=["h", "c"])

    got = words.where(F.col("kind") == WORDS).mapInArrow(some, "h long, c long").toArrow()  # as many as the floor allows
    h, c = got["h"].to_numpy().astype(np.int64).view(np.uint64), got["c"].to_numpy().astype(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def _continuations(train: DataFrame, tree: Tree, orders: list[Order], least: float, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(context of the last order, next word) as entry keys, with their counts, where those are ``least`` or more."""
    shared = train.sparkSession.sparkContext.broadcast((tree.words, orders))
    enough = tree.counts >= least

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, orders = Tree(shared.value[0], None, 0, 0), shared.value[1]
        sums = _Sums(n_parts)
        for b in _slices(batches, 0):
            h, bounds = tokens(b.column(0))
            ids = tree.number(h)
            *_, (at, node) = tree.places(ids, bounds, orders)
            at, node = at[ids[at] >= 0], node[ids[at] >= 0]
            some = enough[ids[at]]
            yield from sums.add((node[some] * len(tree.words) + ids[at[some]]).view(np.uint64))
        yield from sums.send()

    def add(_: int, held: dict) -> Iterator[pa.RecordBatch]:
        k, n = _blocks.joined(held[0], _COUNTED)
        k, n = _summed(k, n.astype(np.int64))
        some = n >= least
        yield pa.RecordBatch.from_arrays([pa.array(k[some].view(np.int64)), pa.array(n[some])], names=["k", "n"])

    got = _blocks.by_part(train.mapInArrow(count, _blocks.BLOCK_DDL), n_parts, add, "k long, n long").toArrow()  # as many as the floor allows
    k, n = got["k"].to_numpy().astype(np.int64), got["n"].to_numpy().astype(np.int64)
    order = np.argsort(k)
    return k[order], n[order]


def fit(train: DataFrame, depth: int = DEPTH, floors: Floors = Floors()) -> tuple[Tree, DataFrame]:
    """The tree, and the staged counts of all training words."""
    n_parts = _blocks.parts(train.sparkSession)
    train = train.select("text")
    words = _word_counts(train, n_parts)
    total = vocabulary = 0
    for r in words.where(F.col("kind") == SIZES).select("n", "block").toLocalIterator():
        n, v = _blocks.unpack(r["n"], r["block"], (np.int64, np.int64))
        total, vocabulary = total + int(n[0]), vocabulary + int(v[0])
    tree = Tree(*_frequent(words, floor(total, floors.word)), total, vocabulary)
    V = len(tree.words)
    least_context, least_next = floor(total, floors.context), floor(total, floors.next)
    # contexts of one word: the empty context's place is 0
    keys = np.flatnonzero((tree.counts >= least_context) & (tree.words != END))
    size = tree.counts[keys]
    after: list[tuple[np.ndarray, np.ndarray]] = []  # of each order: entry keys, and the place of context and next word among the contexts of the next order
    for order in range(1, depth + 1):
        if not len(keys):
            break
        n = len(keys)
        now = Order(keys, np.arange(n), np.zeros(n, bool), np.zeros(n), *(np.zeros(0, t) for t in (np.int64, float, float)))
        tree.orders.append(now)
        blocks = max(1, -(-n // MOST_ENTRIES))
        none = lambda o: Order(o.keys, o.rows, *(o.keys[:0],) * 5)
        found = [_continuations(train, tree, [none(o) for o in tree.block(k, blocks)], least_next, n_parts) for k in range(blocks)]
        k, c = (np.concatenate(x) for x in zip(*found, strict=True))
        up = np.argsort(k)
        k, c = k[up], c[up]
        node, word = k // V, k % V
        p = (c - DISCOUNT) / size[node]
        mass = np.bincount(node, p, n)
        left = np.maximum(1e-12, 1.0 - mass)
        q = tree.probability(order - 1, keys[node] // V, word)
        full = p + left[node] * q
        far = np.bincount(node, full * np.log2(full / q), n)
        now.kept = (far >= DIVERGENCE) & (np.bincount(node, minlength=n) > 0)
        now.left = np.log10(left)
        mine = now.kept[node]
        now.entry, now.full = k[mine], full[mine]
        now.gain = np.log10(full[mine]) - tree.root()[word[mine]]
        # contexts of one word more: continuations that are frequent enough, but for the end
        many = (c >= least_context) & (tree.words[word] != END)
        node, word, c, k = node[many], word[many], c[many], k[many]
        front, suffix = keys[node] % V, keys[node] // V
        if order == 1:
            place, there = _find(keys, word)
        else:
            at, there = _find(after[-1][0], suffix * V + word)
            place = after[-1][1][at] if len(after[-1][1]) else at
        # a suffix is as frequent as what it ends, so it is there
        node, word, c, k, front, place = (x[there] for x in (node, word, c, k, front, place))
        longer = place * V + front
        up = np.argsort(longer)
        rank = np.empty(len(up), np.int64)
        rank[up] = np.arange(len(up))
        after.append((k, rank))
        keys, size = longer[up], c[up]
    return tree, words


def score(docs: DataFrame, held_out: Column, depth: int = DEPTH, floors: Floors = Floors()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``base_score`` is the add-one unigram log10 probability, ``score`` the
    tree's; both end with the end-of-text token, so a null or empty text has
    one token. Rows whose ``held_out`` is true or null are not learned from.
    Repeated rows are scored alike; rows that share a doc_id, or have none, are
    told apart by a digest of their text; other columns are ignored. A text's
    length is not limited. With nothing to learn from, every token has
    probability 1 / (V + 1) with V = 0.
    """
    held = F.coalesce(held_out, F.lit(True))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tree, words = fit(docs.where(~held).select(text.alias("text")), depth, floors)
    spark = docs.sparkSession
    n_parts = _blocks.parts(spark)
    norm = float(np.log10(tree.total + tree.vocabulary + 1))
    blocks = max(1, -(-sum(len(o.entry) for o in tree.orders) // MOST_ENTRIES))

    def passed(k: int):
        shared = spark.sparkContext.broadcast((Tree(tree.words, tree.counts, tree.total, tree.vocabulary), tree.block(k, blocks)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, orders = shared.value
            root = np.r_[tree.root(), 0.0]  # the last is for -1: words without a number
            for b in _slices(batches, 1):
                d, tag, _ = _read(b)
                h, bounds = tokens(b.column(1))
                ids = tree.number(h)
                row = np.repeat(np.arange(b.num_rows), np.diff(bounds))
                per = lambda v: np.bincount(row, v, b.num_rows)
                gain = per(tree.gains(ids, bounds, orders))
                zero = np.zeros(b.num_rows)
                flag = b.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
                values = (d, tag, flag, zero + 1, np.diff(bounds), per(ids >= 0), per(root[ids]), gain) if not k else (d, tag, flag, zero, zero, zero, zero, gain)
                yield from _blocks.pack(_part(d, n_parts), [v.astype(t) for v, t in zip(values, OWN_T, strict=True)], OWN)
                if not k:
                    rare = ids < 0
                    order = np.lexsort((h[rare], row[rare]))
                    x, r = h[rare][order], row[rare][order]
                    first = np.flatnonzero(np.r_[len(x) > 0, (x[1:] != x[:-1]) | (r[1:] != r[:-1])][: len(x)])
                    n = np.diff(np.r_[first, len(x)])
                    x, r = x[first], r[first]
                    yield from _blocks.pack((mix64(x) % np.uint64(n_parts)).astype(np.int32), [x, d[r], tag[r], n.astype(np.uint32)], RARE)

        return run

    def meet(part: int, held: dict) -> Iterator[pa.RecordBatch]:
        """What the words without a number add to their rows."""
        h, c = _blocks.joined(held.pop(WORDS, []), (np.uint64, np.int64))
        order = np.argsort(h)
        h, c = h[order], c[order]
        x, d, tag, n = _blocks.joined(held.pop(RARE, []), RARE_T)
        at, there = _Table(h).find(x)  # looked up once: not kept
        c = np.where(there, c[at], 0) if len(c) else np.zeros(len(x), np.int64)
        order = np.lexsort((tag, d))
        d, tag, n, c = d[order], tag[order], n[order].astype(np.int64), c[order]
        first = np.flatnonzero(np.r_[len(d) > 0, (d[1:] != d[:-1]) | (tag[1:] != tag[:-1])][: len(d)])
        if not len(first):
            return
        zero = np.zeros(len(first))
        known, base = (np.add.reduceat(v, first) for v in (n * (c > 0), n * (np.log10(c + 1) - norm)))
        values = (d[first], tag[first], zero, zero, zero, known, base, zero)
        yield from _blocks.pack(_part(d[first], n_parts), [v.astype(t) for v, t in zip(values, OWN_T, strict=True)], OWN)

    def finish(_: int, held: dict) -> Iterator[pa.RecordBatch]:
        d, tag, flag, rows, n, known, base, gain = _blocks.joined(held[OWN], OWN_T)
        order = np.lexsort((tag, d))
        d, tag = d[order], tag[order]
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (tag[1:] != tag[:-1])])
        rows, n, known, base, gain = (np.add.reduceat(v[order].astype(t), first) for v, t in ((rows, np.int64), (n, np.int64), (known, np.int64), (base, float), (gain, float)))
        flag = np.maximum.reduceat(flag[order], first)
        each = np.repeat(np.arange(len(first)), rows)  # rows that repeat have been added up
        none = (tag[first] & NO_ID_TAG) > 0
        out = [pa.array(d[first][each], mask=none[each]), pa.array(flag[each] > 0), *(pa.array((v // rows)[each]) for v in (n, known)), pa.array(np.full(len(each), tree.total)), *(pa.array((v / rows)[each]) for v in (base, base + gain))]
        yield pa.RecordBatch.from_arrays(out, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), held.alias("held"))
    each = staged(keyed.mapInArrow(passed(0), _blocks.BLOCK_DDL), "scores")
    asked = each.where(F.col("kind") == RARE).unionByName(words.where(F.col("kind") == WORDS))
    own = each.where(F.col("kind") == OWN).unionByName(_blocks.by_part(asked, n_parts, meet, _blocks.BLOCK_DDL))
    for k in range(1, blocks):
        own = own.unionByName(keyed.mapInArrow(passed(k), _blocks.BLOCK_DDL))
    return _blocks.by_part(own, n_parts, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
