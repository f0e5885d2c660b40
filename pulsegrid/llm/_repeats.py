"""Exact repeats of fixed windows of symbols, across all documents.

A window (W symbols) occurs earlier if an equal one starts at an earlier place.
Holding every window of the corpus side by side would move many times the
corpus, so windows travel in groups:

1. Each window elects an anchor, the gram of G symbols in it with the smallest
   hash, the leftmost of equals. Equal windows elect the same gram at the same
   place. Neighbouring windows with one anchor form a group; a group has a
   bucket (its anchor gram) and an identity (hash of all symbols it spans).
2. Groups meet by bucket. A group whose identity occurs earlier repeats
   as a whole. In a bucket of one identity there is nothing else to find. In
   a bucket of several identities the first group of each is opened:
   its windows are hashed one by one.
3. A task puts equal windows of what it opened together (words by hash, bytes by
   refining buckets of bytes, :mod:`._buckets`) and sends each window once.
   Windows of all tasks meet by hash, and all but the first repeat.

So what is unique sends a record for each group, long repeats send one mark
for each group, and only the edges of repeats are looked at window by window.
Hashes of bucket and identity, and the two hashes of an opened window, are
independent: a group rests on 128 bits, a window on 96 or 128.

A map task sends a bucket and identity once, and opens its own groups where it
sees that a bucket has several identities, so a passage that a third of all
rows share gives each task one record.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import _blocks
from ._buckets import refined
from ._common import keyed_text, mix64, staged

#: Kinds of blocks.
GROUP, OLD_GROUP, WINDOW, OLD_WINDOW, MARK, OPEN, TEXT, RUN, WINDOW_RUN, OLD_OPEN, OLD_TEXT, OPENED = range(12)
GROUP_T = (np.uint64, np.uint64, np.int64, np.uint32, np.uint32, np.uint32)  # bucket, identity, doc, tag, start, windows
PLACE_T = (np.int64, np.uint32, np.uint32)  # doc, tag, start: of a window, after its two hashes
MARK_T = (np.int64, np.uint32, np.uint32, np.uint32)  # doc, tag, start, windows
#: Symbols that are hashed at once; longer documents go in overlapping pieces.
PIECE = 1 << 18
#: Bytes of text whose words or bytes a task holds at once; a longer text stands alone.
SLICE = 4 << 20
#: Opened windows that a task holds before it sends them.
MOST_WINDOWS = 250_000
_POS = np.uint64((1 << 21) - 1)
#: Rows without a doc_id sort last, by 55 bits of their text's hash; the top bit of their tag tells them.
NO_ID, NO_ID_BITS, NO_ID_TAG = np.iinfo(np.int64).max, (1 << 55) - 1, 1 << 31


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Polynomial hashes of spans, modulo 2^64, of symbols with random 64-bit codes."""

    def __init__(self, base: int, n: int = 4 * PIECE):
        self.up, self.down = _powers(base, n), _powers(pow(base, -1, 1 << 64), n)

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.up[: len(codes)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, a, b) -> np.ndarray:
        return (prefix[b] - prefix[a]) * self.down[a]


_HASHERS: list[Hasher] = []


def hashers() -> list[Hasher]:
    if not _HASHERS:
        _HASHERS.extend(Hasher(b) for b in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95))
    return _HASHERS


class Bytes:
    """UTF-8 bytes as symbols."""

    #: Hashes of a window: of its first and of its last bytes, which together are all of it.
    NAMES = (np.uint64, np.uint64)

    def __init__(self, window: int = 100, gram: int = 36):
        self.window, self.gram = window, gram
        self.table = [mix64(np.arange(1, 257, dtype=np.uint64) + np.uint64(s << 32)) for s in (7, 11)]

    def symbols(self, text: bytes) -> np.ndarray:
        return np.frombuffer(text, np.uint8)

    def codes(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.table[0][symbols], self.table[1][symbols]

    def concat(self, pieces: list[np.ndarray]) -> np.ndarray:
        return np.concatenate(pieces)

    def take(self, symbols: np.ndarray, a: int, b: int) -> np.ndarray:
        return symbols[a:b]

    def kept(self, symbols: np.ndarray, gone: np.ndarray) -> bytes:
        return symbols[~gone].tobytes()

    def alike(self, spans: list[np.ndarray], lens: np.ndarray) -> tuple[tuple[np.ndarray, ...], Callable]:
        """Keys that are equal for equal windows of the spans, and the hashes of some windows.

        The keys are pointers of refined buckets. What meets from several tasks
        are buckets of the greatest power of two below the window, named by a
        hash, and of those the part that has the same bucket where the window's
        last such string begins.
        """
        data = self.concat(spans)
        at, pointer = refined(data, lens, self.window)
        depth = 1 << max((self.window - 1).bit_length() - 1, 0)

        def names(some: np.ndarray) -> tuple[np.ndarray, ...]:
            h1 = hashers()[0]
            head, last = np.zeros(len(some), np.uint64), np.zeros(len(some), np.uint64)
            # by pieces that the table of powers covers
            up = np.argsort(at[some])
            p = at[some][up]
            cut = np.flatnonzero(np.diff(p // (2 * PIECE))) + 1
            for lo, hi in zip(np.r_[0, cut], np.r_[cut, len(p)], strict=True):
                if lo == hi:
                    continue
                begin = int(p[lo])
                q = p[lo:hi] - begin
                codes = self.table[0][data[begin : begin + int(q[-1]) + self.window]]
                prefix = h1.prefix(codes)
                head[up[lo:hi]] = mix64(h1.spans(prefix, q, q + depth))
                q = q + self.window - depth
                last[up[lo:hi]] = mix64(h1.spans(prefix, q, q + depth))
            return head, last

        return (pointer,), names


class Words:
    """Words as symbols."""

    RULE = re.compile(rb"[^\x20\x09-\x0D]+")
    #: Two hashes of a window.
    NAMES = (np.uint64, np.uint32)

    def __init__(self, window: int = 20, gram: int = 6):
        self.window, self.gram = window, gram
        self.known: dict[bytes, bytes] = {}

    def symbols(self, text: bytes) -> list[bytes]:
        return self.RULE.findall(text)

    def codes(self, symbols: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        if len(known) > 200_000:
            known.clear()
        f = xxhash.xxh3_128_digest
        for w in set(symbols).difference(known):
            known[w] = f(w)
        both = np.frombuffer(b"".join(map(known.__getitem__, symbols)), np.uint64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def concat(self, pieces: list[list[bytes]]) -> list[bytes]:
        return [w for p in pieces for w in p]

    def take(self, symbols: list[bytes], a: int, b: int) -> list[bytes]:
        return symbols[a:b]

    def kept(self, symbols: list[bytes], gone: np.ndarray) -> bytes:
        return b" ".join([w for w, g in zip(symbols, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(symbols)

    def alike(self, spans: list[list[bytes]], lens: np.ndarray) -> tuple[tuple[np.ndarray, ...], Callable]:
        """Keys that are equal for equal windows of the spans, and the hashes of some windows: the same."""
        W = self.window
        h1, h2 = hashers()
        out = []
        cut = np.flatnonzero(np.diff(np.cumsum(lens) // PIECE)) + 1
        for lo, hi in zip(np.r_[0, cut], np.r_[cut, len(lens)], strict=True):
            if lo == hi:
                continue
            c1, c2 = self.codes(self.concat(spans[lo:hi]))
            p1, p2 = h1.prefix(c1), h2.prefix(c2)
            n = lens[lo:hi] - W + 1
            p = np.repeat(np.cumsum(lens[lo:hi]) - lens[lo:hi], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out.append((mix64(h1.spans(p1, p, p + W)), (mix64(h2.spans(p2, p, p + W)) >> np.uint64(32)).astype(np.uint32)))
        a, b = (np.concatenate(c) for c in zip(*out, strict=True))
        return (a, b), lambda some: (a[some], b[some])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if span < w else x


def _groups(kind, pieces: list, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Groups of the pieces' windows: piece, start within the document, windows, bucket, identity."""
    W, G = kind.window, kind.gram
    lens = np.array([len(p) for p in pieces])
    total = int(lens.sum())
    if total < W:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    c1, c2 = kind.codes(kind.concat(pieces))
    h1, h2 = hashers()
    p1, p2 = h1.prefix(c1), h2.prefix(c2)
    n = total - G + 1
    grams = mix64((p1[G:] - p1[:n]) * h1.down[:n])
    low = sliding_min((grams & ~_POS) | np.arange(n, dtype=np.uint64), W - G + 1)
    owner = np.repeat(np.arange(len(pieces)), lens)
    p = np.flatnonzero(owner[: total - W + 1] == owner[W - 1 :])
    if not len(p):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    anchor = (low[p] & _POS).astype(np.int64)
    new = np.r_[True, (np.diff(anchor) != 0) | (np.diff(p) != 1)]
    first = np.flatnonzero(new)
    s, t = p[first], p[np.r_[first[1:], len(p)] - 1]
    count = t - s + 1
    identity = mix64(h2.spans(p2, s, t + W) + count.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    piece = owner[s]
    base = np.cumsum(lens) - lens
    return piece, s - base[piece] + at[piece], count, grams[anchor[first]], identity


def groups(kind, symbols: list) -> tuple[np.ndarray, ...]:
    """Groups of whole documents: index of the document, start, windows, bucket, identity."""
    out, pieces, at, doc, size = [], [], [], [], 0

    def flush() -> None:
        nonlocal size
        if pieces:
            piece, s, n, b, i = _groups(kind, pieces, np.array(at))
            out.append((np.array(doc)[piece], s, n, b, i))
        pieces.clear(), at.clear(), doc.clear()
        size = 0

    for d, x in enumerate(symbols):
        for start in range(0, max(1, len(x) - kind.window + 1), PIECE):
            piece = kind.take(x, start, start + PIECE + kind.window - 1)
            if size + len(piece) > 2 * PIECE:
                flush()
            pieces.append(piece), at.append(start), doc.append(d)
            size += len(piece)
    flush()
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else _groups(kind, [], np.zeros(0))


@dataclass
class Opened:
    """Runs of neighbouring windows that have been opened: where they are, and the symbols that they span."""

    doc: np.ndarray
    tag: np.ndarray
    start: np.ndarray
    count: np.ndarray
    spans: list


def opened(kind, symbols, ids, tags, doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[Opened]:
    """The windows of some groups of documents; groups that touch go together, up to MOST_WINDOWS a time."""
    order = np.lexsort((start, doc))
    doc, start, count = doc[order], start[order].astype(np.int64), count[order].astype(np.int64)
    before = np.cumsum(count) - count
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + count[:-1]) | (np.diff(before // max(1, PIECE // 2)) != 0)]
    first = np.flatnonzero(new)
    doc, start, count = doc[first], start[first], np.add.reduceat(count, first)
    cut = np.flatnonzero(np.diff(np.cumsum(count) // MOST_WINDOWS)) + 1
    for lo, hi in zip(np.r_[0, cut].tolist(), np.r_[cut, len(doc)].tolist(), strict=True):
        if lo == hi:
            continue
        d, s, n = doc[lo:hi], start[lo:hi], count[lo:hi]
        spans = [kind.take(symbols[i], a, b) for i, a, b in zip(d.tolist(), s.tolist(), (s + n + kind.window - 1).tolist(), strict=True)]
        yield Opened(ids[d], tags[d], s, n, spans)


def _part(x: np.ndarray, n_parts: int) -> np.ndarray:
    return (mix64(x.view(np.uint64) if x.dtype == np.int64 else x) % np.uint64(n_parts)).astype(np.int32)


def _marks(doc, tag, start, n, n_parts: int, kind: int = MARK) -> Iterator[pa.RecordBatch]:
    up = np.lexsort((start, tag, doc))
    cols = [c[up].astype(t) for c, t in zip((doc, tag, start, n), MARK_T, strict=True)]
    yield from _blocks.pack(_part(cols[0], n_parts), cols, kind)


def _read(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids, tags (a digest that tells rows of one id apart) and texts of a batch."""
    texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
    digest = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64)
    none = b.column(0).is_null().to_numpy(zero_copy_only=False).astype(bool)
    ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    far = NO_ID - ((digest >> np.uint64(9)) & np.uint64(NO_ID_BITS)).astype(np.int64)
    tags = (digest & np.uint64(NO_ID_TAG - 1)).astype(np.uint32) | np.where(none, np.uint32(NO_ID_TAG), np.uint32(0))
    return np.where(none, far, ids), tags, texts


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of at most SLICE bytes of text."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1).cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
            yield b.slice(at, to - at)
            at = to


def _first(order_by: tuple[np.ndarray, ...], same: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sort by ``same``, then ``order_by``; for each row of that order, is it the first of its kind?"""
    order = np.lexsort((*order_by[::-1], *same[::-1]))
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in same:
            new[1:] |= np.diff(k[order]) != 0
    return order, new


def _emit_windows(kind, made: list[Opened], n_parts: int, doc_parts: int, as_kind: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """Each window once, in document order, and marks of the windows that repeat here.

    As OLD windows (``as_kind``) they have no place, and nothing is marked.
    """
    if not made:
        return
    count = np.concatenate([m.count for m in made])
    spans = [x for m in made for x in m.spans]
    keys, names = kind.alike(spans, count + kind.window - 1)
    of = lambda name: np.repeat(np.concatenate([getattr(m, name) for m in made]), count)
    di, dt = of("doc"), of("tag")
    s = of("start") + np.arange(len(di)) - np.repeat(np.cumsum(count) - count, count)
    made.clear()
    order, new = _first((di, dt, s), keys)
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    up = order[new]
    up = up[np.lexsort((s[up], dt[up], di[up]))]
    a, b = names(up)
    if as_kind != WINDOW:
        yield from _blocks.pack(_part(a ^ b, n_parts), [a, b], as_kind)
        return
    again = order[(di[order] != di[lead]) | (dt[order] != dt[lead]) | (s[order] != s[lead])]
    yield from _marks(di[again], dt[again], s[again], np.ones(len(again)), doc_parts)
    yield from _blocks.pack(_part(a ^ b, n_parts), [a, b, di[up], dt[up], s[up].astype(np.uint32)], WINDOW)


def _send_groups(make: Callable, n_parts: int, doc_parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = make()
        for batch in _slices(batches):
            ids, tags, texts = _read(batch)
            symbols = [kind.symbols(t) for t in texts]
            doc, s, n, bucket, identity = groups(kind, symbols)
            di, dt = ids[doc], tags[doc]
            order, new = _first((di, dt, s), (bucket, identity))
            doc, s, n, bucket, identity, di, dt = (x[order] for x in (doc, s, n, bucket, identity, di, dt))
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else new
            again = (di != di[lead]) | (dt != dt[lead]) | (s != s[lead])
            yield from _marks(di[again], dt[again], s[again], n[again], doc_parts)
            doc, s, n, bucket, identity, di, dt = (x[new] for x in (doc, s, n, bucket, identity, di, dt))
            if not len(doc):
                continue
            edge = np.flatnonzero(np.r_[True, np.diff(bucket) != 0])
            size = np.diff(np.r_[edge, len(bucket)])
            several = np.repeat(size > 1, size)
            if several.any():
                for some in opened(kind, symbols, ids, tags, doc[several], s[several], n[several]):
                    yield from _emit_windows(kind, [some], n_parts, doc_parts)
            mark = np.unique(bucket[several])
            zero = np.zeros(len(mark), np.int64)
            one = ~several
            cols = [np.r_[bucket[one], mark], np.r_[identity[one], zero.astype(np.uint64)], np.r_[di[one], zero], np.r_[dt[one], zero].astype(np.uint32), np.r_[s[one], zero].astype(np.uint32), np.r_[n[one], zero].astype(np.uint32)]
            up = np.lexsort((cols[4], cols[3], cols[2]))
            yield from _blocks.pack(_part(cols[0][up], n_parts), [c[up] for c in cols], GROUP)

    return run


def _passed_on(part: int, blocks: list[tuple[int, bytes]], dtypes: tuple, at: int, kind: int) -> Iterator[pa.RecordBatch]:
    """Blocks that only pass through a part, as few large ones in document order; ``at`` is the column of the document."""
    cols = _blocks.joined(blocks, dtypes)
    up = np.lexsort((cols[at + 2], cols[at + 1], cols[at]))
    yield from _blocks.pack(np.full(len(up), part, np.int32), [c[up] for c in cols], kind)


def _meet_groups(names: tuple, doc_parts: int, keep_run: bool) -> Callable:
    """Marks of groups that repeat, requests to open groups, and the new run of the index."""

    def reduce(part: int, held: dict) -> Iterator[pa.RecordBatch]:
        yield from _passed_on(part, held.pop(WINDOW, []), (*names, *PLACE_T), len(names), WINDOW)
        yield from _passed_on(part, held.pop(MARK, []), MARK_T, 0, MARK)
        old = _blocks.joined(held.pop(OLD_GROUP, []), GROUP_T)
        new = _blocks.joined(held.pop(GROUP, []), GROUP_T)
        fresh = np.r_[np.zeros(len(old[0]), np.int8), np.ones(len(new[0]), np.int8)]
        bucket, identity, doc, tag, s, n = (np.concatenate(c) for c in zip(old, new, strict=True))
        if not len(bucket):
            return
        order, first = _first((fresh, doc, tag, s), (bucket, identity))
        bucket, identity, doc, tag, s, n, fresh = (x[order] for x in (bucket, identity, doc, tag, s, n, fresh))
        lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        marker = identity == 0
        again = ~first & ~marker & (fresh == 1) & ((doc != doc[lead]) | (tag != tag[lead]) | (s != s[lead]) | (fresh[lead] == 0))
        yield from _marks(doc[again], tag[again], s[again], n[again], doc_parts)
        edge = np.flatnonzero(np.r_[True, np.diff(bucket) != 0])
        size = np.diff(np.r_[edge, len(bucket)])
        kinds = np.add.reduceat(first.astype(np.int64), edge)
        old_mark = np.maximum.reduceat((marker & (fresh == 0)).astype(np.int8), edge) > 0
        any_mark = np.maximum.reduceat(marker.astype(np.int8), edge) > 0
        several = (kinds > 1) | any_mark
        per = lambda x: np.repeat(x, size)
        open_ = first & ~marker & per(several) & ((fresh == 1) | ~per(old_mark))
        for k, some in ((OPEN, open_ & (fresh == 1)), (OLD_OPEN, open_ & (fresh == 0))):
            yield from _marks(doc[some], tag[some], s[some], n[some], doc_parts, k)
        if keep_run:
            alone = first & ~marker & (fresh == 1) & ~per(several)
            mark = bucket[edge[several & ~old_mark]]
            zero = np.zeros(len(mark), np.int64)
            cols = [np.r_[bucket[alone], mark], np.r_[identity[alone], zero.astype(np.uint64)], np.r_[doc[alone], zero], np.r_[tag[alone], zero].astype(np.uint32), np.r_[s[alone], zero].astype(np.uint32), np.r_[n[alone], zero].astype(np.uint32)]
            up = np.lexsort((cols[1], cols[0]))
            yield from _blocks.pack(np.full(len(up), part, np.int32), [c[up] for c in cols], RUN)

    return reduce


def _packed_texts(docs: DataFrame, n_parts: int, as_kind: int = TEXT) -> DataFrame:
    """Texts as compressed blocks by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for b in _slices(batches):
            ids, tags, texts = _read(b)
            part = _part(ids, n_parts)
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.diff(part[order])) + 1
            for some in np.split(order, cut):
                if not len(some):
                    continue
                whole = b"".join([texts[i] for i in some])
                head = ids[some].tobytes() + tags[some].tobytes() + np.array([len(texts[i]) for i in some], np.int64).tobytes()
                block = np.array([len(whole)], np.int64).tobytes() + head + codec.compress(whole, asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([part[some[0]]], pa.int32()), pa.array([as_kind], pa.int32()), pa.array([len(some)], pa.int32()), pa.array([block], pa.binary())], schema=_blocks.BLOCK)

    return keyed_text(docs).mapInArrow(run, _blocks.BLOCK_DDL)


def _unpacked(n: int, block: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    size = int(np.frombuffer(block, np.int64, 1)[0])
    ids, tags = np.frombuffer(block, np.int64, n, 8), np.frombuffer(block, np.uint32, n, 8 + 8 * n)
    ends = np.cumsum(np.frombuffer(block, np.int64, n, 8 + 12 * n))
    whole = pa.Codec("zstd").decompress(block[8 + 20 * n :], size, asbytes=True) if size else b""
    return ids, tags, [whole[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]


class _ByDocument:
    """Marks of a part, found by id and tag."""

    def __init__(self, blocks: list[tuple[int, bytes]]):
        doc, tag, self.start, self.count = _blocks.joined(blocks, MARK_T)
        order = np.lexsort((self.start, tag, doc))
        doc, tag, self.start, self.count = doc[order], tag[order], self.start[order].astype(np.int64), self.count[order].astype(np.int64)
        edge = np.flatnonzero(np.r_[len(doc) > 0, (np.diff(doc) != 0) | (np.diff(tag) != 0)])
        end = np.r_[edge, len(doc)][1:]
        self.at = {(d, t): (a, b) for d, t, a, b in zip(doc[edge].tolist(), tag[edge].tolist(), edge.tolist(), end.tolist(), strict=True)}

    def of(self, doc: int, tag: int) -> tuple[np.ndarray, np.ndarray] | None:
        if (r := self.at.get((doc, tag))) is None:
            return None
        return self.start[r[0] : r[1]], self.count[r[0] : r[1]]


def _open_groups(make: Callable, n_parts: int, doc_parts: int) -> Callable:
    """The windows of the groups that are asked for, those of earlier batches apart."""

    def reduce(part: int, held: dict) -> Iterator[pa.RecordBatch]:
        kind = make()
        for ask, text, as_kind in ((OPEN, TEXT, WINDOW), (OLD_OPEN, OLD_TEXT, OPENED)):
            wanted, made, size = _ByDocument(held.pop(ask, [])), [], 0
            blocks = held.pop(text, []) if wanted.at else []
            for n, block in blocks:
                ids, tags, texts = _unpacked(n, block)
                symbols, doc, start, count = {}, [], [], []
                for i, (d, t) in enumerate(zip(ids.tolist(), tags.tolist(), strict=True)):
                    if (found := wanted.of(d, t)) is not None:
                        symbols[i] = kind.symbols(texts[i])
                        doc.append(np.full(len(found[0]), i)), start.append(found[0]), count.append(found[1])
                if not doc:
                    continue
                for some in opened(kind, symbols, ids, tags, np.concatenate(doc), np.concatenate(start), np.concatenate(count)):
                    made.append(some)
                    size += int(some.count.sum())
                    if size > MOST_WINDOWS:
                        yield from _emit_windows(kind, made, n_parts, doc_parts, as_kind)
                        size = 0
            yield from _emit_windows(kind, made, n_parts, doc_parts, as_kind)

    return reduce


def _among(run: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the hashes (a, b), sorted, stand in a sorted piece of a run: a merge join, verified by the second hash."""
    at = np.searchsorted(a, run[0])
    out = np.zeros(len(a), bool)
    left = np.flatnonzero(at < len(a))
    while len(left):  # once, but where first hashes collide
        left = left[a[at[left]] == run[0][left]]
        out[at[left[b[at[left]] == run[1][left]]]] = True
        at[left] += 1
        left = left[at[left] < len(a)]
    return out


def _refine(a: np.ndarray, b: np.ndarray, order_by: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Order by a, then b, then ``order_by``, and which are the first of their (a, b); buckets of one a alone are done."""
    order = np.argsort(a)
    s = a[order]
    same = np.r_[s[1:] == s[:-1], False][: len(s)]
    many = same | np.r_[False, same[:-1]][: len(s)]
    some = order[many]
    some = some[np.lexsort((*(x[some] for x in order_by[::-1]), b[some], a[some]))]
    order[many] = some
    new = np.ones(len(order), bool)
    new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    return order, new


def _meet_windows(names: tuple, doc_parts: int, keep_run: bool) -> Callable:
    """Marks of windows that repeat: new ones by sorting, those of the index by merging with its sorted runs."""

    def reduce(part: int, held: dict) -> Iterator[pa.RecordBatch]:
        yield from _passed_on(part, held.pop(MARK, []), MARK_T, 0, MARK)
        brought = _blocks.joined(held.pop(OPENED, []), names)  # of earlier documents, not yet in a run
        a, b, doc, tag, s = _blocks.joined(held.pop(WINDOW, []), (*names, *PLACE_T))
        order, first = _refine(a, b, (doc, tag, s))
        a, b, doc, tag, s = (x[order] for x in (a, b, doc, tag, s))
        lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0)) if len(first) else np.zeros(0, np.int64)
        up, down = np.flatnonzero(first), np.cumsum(first) - 1
        old = np.zeros(len(up), bool)
        up_b, _ = _refine(*brought, ())
        brought = [x[up_b] for x in brought]
        for run in ([brought] if len(brought[0]) else []) + [_blocks.unpack(n, block, names) for n, block in held.pop(OLD_WINDOW, ())]:
            old |= _among(run, a[up], b[up])
        again = old[down] | ~first & ((doc != doc[lead]) | (tag != tag[lead]) | (s != s[lead])) if len(a) else np.zeros(0, bool)
        yield from _marks(doc[again], tag[again], s[again], np.ones(int(again.sum())), doc_parts)
        if keep_run:
            mine = up[~old]
            x, y = np.r_[a[mine], brought[0]], np.r_[b[mine], brought[1]]
            order, new = _refine(x, y, ())
            x, y = x[order][new], y[order][new]
            yield from _blocks.pack(np.full(len(x), part, np.int32), [x, y], WINDOW_RUN)

    return reduce


def _as(blocks: DataFrame, kind: int) -> DataFrame:
    return blocks.select("part", F.lit(kind).alias("kind"), "n", "block")


def marks(docs: DataFrame, make: Callable, n_parts: int, past: tuple[DataFrame, DataFrame] | None = None, past_docs: DataFrame | None = None, keep_run: bool = False, doc_parts: int | None = None) -> tuple[list[DataFrame], DataFrame | None, DataFrame | None]:
    """Marks of the windows of ``docs`` that occur earlier, and the new runs of groups and of windows.

    ``past`` are runs of groups and windows of earlier documents, ``past_docs``
    those documents: some of their groups may have to be opened. Groups and
    windows lie in ``n_parts`` parts, which all runs share; documents, of which
    a batch may have few, in ``doc_parts``.
    """
    doc_parts = min(doc_parts or n_parts, n_parts)
    sent = keyed_text(docs).mapInArrow(_send_groups(make, n_parts, doc_parts), _blocks.BLOCK_DDL)
    if past is not None:
        sent = sent.unionByName(_as(past[0], OLD_GROUP))
    met = staged(_blocks.by_part(sent, n_parts, _meet_groups(make().NAMES, doc_parts, keep_run), _blocks.BLOCK_DDL), "groups")
    ask = met.where(F.col("kind").isin(OPEN, OLD_OPEN)).unionByName(_packed_texts(docs, doc_parts))
    if past_docs is not None:
        ask = ask.unionByName(_packed_texts(past_docs, doc_parts, OLD_TEXT))
    windows = _blocks.by_part(ask, doc_parts, _open_groups(make, n_parts, doc_parts), _blocks.BLOCK_DDL).unionByName(met.where(F.col("kind") == WINDOW))
    if past is not None:
        windows = windows.unionByName(_as(past[1], OLD_WINDOW))
    met2 = staged(_blocks.by_part(windows, n_parts, _meet_windows(make().NAMES, doc_parts, keep_run), _blocks.BLOCK_DDL), "windows")
    found = [met.where(F.col("kind") == MARK), met2.where(F.col("kind") == MARK)]
    if not keep_run:
        return found, None, None
    return found, met.where(F.col("kind") == RUN), met2.where(F.col("kind") == WINDOW_RUN)


def covered(window: int, size: int, found: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Which of ``size`` symbols lie in a marked window."""
    if found is None:
        return np.zeros(size, bool)
    start, count = found
    edge = np.bincount(start, minlength=size + 1) - np.bincount(start + count + window - 1, minlength=size + 1)
    return np.cumsum(edge[:size]) > 0


def removed(docs: DataFrame, found: list[DataFrame], make: Callable, n_parts: int, finish: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """Rows that ``finish(kind, symbols, gone)`` makes of each document and the symbols to remove, after its doc_id."""

    def reduce(_: int, held: dict) -> Iterator[pa.RecordBatch]:
        kind, by_doc = make(), _ByDocument(held.pop(MARK, []))
        for n, block in held.pop(TEXT, ()):
            ids, tags, texts = _unpacked(n, block)
            out = []
            for d, t, text in zip(ids.tolist(), tags.tolist(), texts, strict=True):
                symbols = kind.symbols(text)
                gone = covered(kind.window, len(symbols), by_doc.of(d, t))
                out.append((None if t & NO_ID_TAG else d, *finish(kind, symbols, gone)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    blocks = _packed_texts(docs, n_parts)
    for f in found:
        blocks = blocks.unionByName(f)
    return _blocks.by_part(blocks, n_parts, reduce, ddl)
