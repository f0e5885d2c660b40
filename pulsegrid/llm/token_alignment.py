"""Alignment of the tokens of two tokenizers over a corpus.

Both cut the same bytes, so the offsets where tokens of both end cut them into
groups, and the two tokens that end there are linked. How often an id pair is
linked in the corpus is counted from packed pair keys, whole numbers of the B
id before the A id:

1. Texts are cut at single spaces between two other characters, where neither
   tokenizer ever joins; each distinct piece is encoded and aligned once and
   its groups and keys remembered. Per text the keys and how often each occurs
   are written to the shared folder.
2. Every partition makes one sorted list of its keys and counts
   (``numpy.unique``); the lists are sorted by key ranges, and runs of a key
   are added up. Each range is a shard: two files of sorted keys and of counts
   in the shared folder.
3. Texts look their keys up by binary search in the memory-mapped shards.

The counts never meet in one place: a task maps the shards that its keys fall
in. The driver gets a row for each shard, and for each B id its highest count
(bounded by the vocabulary).
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._common import keyed_text, shared_dir, staged

#: A single space between two characters that are no white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Distinct pieces that a worker remembers at once.
REMEMBER = 300_000
#: Characters of text that are worked on at once.
SLICE = 2_000_000
#: Keys that a partition gathers before it adds up equal ones.
GATHER = 2_000_000

_DOC = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("keys", pa.binary()), ("times", pa.binary())])
_DOC_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Groups and pair keys of texts, for a byte-level file of ``tokenizers`` (A) and a ``sentencepiece`` model (B)."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        names = self.a.get_vocab(with_added_tokens=True)
        added = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.a_bytes = {i: t.encode() if t in added else bytes(map(alphabet.__getitem__, t)) for t, i in names.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = np.zeros(max(self.a_bytes) + 1, np.int64), np.array([len(x) for x in self.b_bytes])
        for i, x in self.a_bytes.items():
            self.a_sizes[i] = len(x)
        named = lambda n, marks: np.array([[f"{i}{m}" for i in range(n)] for m in marks], object)
        self.a_texts, self.b_texts = named(len(self.a_sizes), ",|"), named(len(self.b_sizes), ",;")
        self.shift = max(self.a_bytes).bit_length()
        self.bits = self.shift + (len(pieces) - 1).bit_length()
        self.cuts = self._cuts(json.loads(self.a.to_str()), pieces)
        self._forget()

    def _cuts(self, a: dict, pieces: list[str]) -> bool:
        """Whether pieces of a text can be encoded apart: A cuts before words, B changes no text and has no entry that goes on after a space."""
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.b.serialized_model_proto())
        n = spec.normalizer_spec
        pre = a.get("pre_tokenizer") or {}
        return (
            not a.get("normalizer") and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space")
            and n.name == "identity" and not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces
            and not any(re.search("[^▁]▁", p) for p in pieces) and all(p.type != 4 for p in spec.pieces)
        )

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.groups: list[str] = []
        self.facts = np.zeros((0, 4), np.int64)  # usable, A tokens, B tokens, groups
        self.keys, self.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def cut(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cuts else [text]

    def _flat(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes

    def _spelled(self, whole: list[bytes], ids: list[list[int]], table, flat: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which pieces the tokens spell byte by byte; all at once if they all do."""
        totals = np.diff(np.r_[0, np.cumsum(sizes[flat])][np.r_[0, np.cumsum(counts)]])
        if (totals == np.fromiter(map(len, whole), np.int64, len(whole))).all() and b"".join(map(table.__getitem__, chain.from_iterable(ids))) == b"".join(whole):
            return np.ones(len(whole), bool)
        return np.array([b"".join(map(table.__getitem__, x)) == w for x, w in zip(ids, whole, strict=True)], bool)

    def _align(self, pieces: list[str], a: list[list[int]], b: list[list[int]]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of all pieces at once: facts (usable, A tokens, B tokens, groups), groups as text, keys of the links, and links of each piece."""
        whole = [(" " + p).encode() for p in pieces]
        (ids_a, n_a), (ids_b, n_b) = self._flat(a), self._flat(b)
        good = self._spelled(whole, a, self.a_bytes, ids_a, n_a, self.a_sizes) & self._spelled(whole, b, self.b_bytes, ids_b, n_b, self.b_sizes)
        if not good.all():
            (ids_a, n_a), (ids_b, n_b) = (self._flat([x if g else [] for x, g in zip(ids, good.tolist(), strict=True)]) for ids in (a, b))
        # both sides have the same bytes, piece after piece, so offsets in the row of all pieces can be compared
        ends_a, ends_b = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b])
        at = np.searchsorted(ends_b, ends_a)
        last_a = ends_b[at] == ends_a if len(at) else np.zeros(0, bool)
        i, j = np.flatnonzero(last_a), at[last_a]
        last_b = np.zeros(len(ids_b), bool)
        last_b[j] = True
        links = np.diff(np.r_[0, np.cumsum(last_a)][np.r_[0, np.cumsum(n_a)]])
        # the text of the groups: A ids, then B ids, each with the mark behind it
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        parts = np.empty(len(ids_a) + len(ids_b), object)
        before_b = np.r_[0, j + 1]  # B ids up to the end of each group
        parts[np.arange(len(ids_a)) + before_b[group_a]] = self.a_texts[last_a.astype(np.int64), ids_a]
        after_a = np.r_[i + 1, len(ids_a)]
        parts[np.arange(len(ids_b)) + after_a[group_b]] = self.b_texts[last_b.astype(np.int64), ids_b]
        parts, stops = parts.tolist(), np.cumsum(n_a + n_b).tolist()
        texts, begin = [], 0
        for end in stops:
            texts.append("".join(parts[begin:end])[:-1])
            begin = end
        return np.c_[good, n_a, n_b, links].astype(np.int64), texts, ids_b[j] << self.shift | ids_a[i], links

    def learn(self, pieces: set[str]) -> None:
        """Encode and align pieces that have not been seen, once each."""
        if len(self.code) > REMEMBER:
            self._forget()
        new = [p for p in pieces if p not in self.code]
        gc.disable()  # lists of ids by the hundred thousand, none in a circle
        try:
            self._learn(new)
        finally:
            gc.enable()

    def _learn(self, new: list[str]) -> None:
        facts, keys, sizes = [self.facts], [self.keys], []
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            a = [x.ids for x in self.a.encode_batch_fast([" " + p for p in some], add_special_tokens=False)]
            f, groups, k, n = self._align(some, a, self.b.encode(some, num_threads=1))
            self.code.update(zip(some, range(len(self.code), len(self.code) + len(some)), strict=True))
            self.groups += groups
            facts.append(f)
            keys.append(k)
            sizes.append(n)
        if new:
            self.facts, self.keys = np.concatenate(facts), np.concatenate(keys)
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes))])

    def documents(self, texts: list[str]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, keys, times) of texts that are not empty."""
        cut = list(map(self.cut, texts))
        self.learn(set(chain.from_iterable(cut)))
        sizes = np.array([len(c) for c in cut])
        code = np.fromiter(map(self.code.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        facts = np.add.reduceat(self.facts[code], first)
        links = self.starts[code + 1] - self.starts[code]
        at = np.repeat(self.starts[code] - np.r_[0, np.cumsum(links)[:-1]], links) + np.arange(links.sum())
        keys, doc = self.keys[at], np.repeat(np.repeat(np.arange(len(texts)), sizes), links)
        per = 1 << (63 - self.bits)  # documents whose number fits beside a key
        for lo in range(0, len(texts), per):
            here = slice(*np.searchsorted(doc, [lo, lo + per]))
            both, times = np.unique((doc[here] - lo) << self.bits | keys[here], return_counts=True)
            ends = np.searchsorted(both >> self.bits, np.arange(min(per, len(texts) - lo)), side="right")
            begin = 0
            for i, end in enumerate(ends.tolist(), lo):
                good, n_a, n_b, n_groups = facts[i].tolist()
                if good < sizes[i]:
                    yield 0, 0, 0, 0, "", b"", b""
                else:
                    name = hashlib.sha256(";".join(map(self.groups.__getitem__, code[first[i] : first[i] + sizes[i]].tolist())).encode()).hexdigest()
                    yield n_a, n_b, n_groups, n_groups, name, packed(both[begin:end] & ((1 << self.bits) - 1), self.bits), packed(times[begin:end], 32)
                begin = end


def packed(x: np.ndarray, bits: int) -> bytes:
    """Whole numbers byte plane by byte plane, which compresses well."""
    size = 4 if bits <= 32 else 8
    return np.ascontiguousarray(x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T).tobytes()


def unpacked(raw: bytes, bits: int) -> np.ndarray:
    size = 4 if bits <= 32 else 8
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(f"<u{size}").ravel().astype(np.int64)


@lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _slices(ids: list, texts: list[str | None]) -> Iterator[tuple[list, list[str | None]]]:
    """Rows of bounded total length; a longer text stands alone."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t or "") > SLICE:
            yield ids[begin:i], texts[begin:i]
            begin, size = i, 0
        size += len(t or "")
    if begin < len(texts):
        yield ids[begin:], texts[begin:]


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row: numbers of tokens, groups and links, the digest of the groups, and its packed pair keys with how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        for b in batches:
            for ids, texts in _slices(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = [(0, 0, 0, 0, "", b"", b"")] * len(texts)
                some = [i for i, t in enumerate(texts) if t]
                if some:
                    for i, row in zip(some, aligner.documents([texts[i] for i in some]), strict=True):
                        found[i] = row
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([ids, *zip(*found, strict=True)], _DOC, strict=True)], schema=_DOC)

    return keyed_text(docs).mapInArrow(run, _DOC_DDL)


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, n)
    return keys, total


def partial_counts(links: DataFrame, bits: int) -> DataFrame:
    """(key, n): each partition's keys once, with how often they are linked there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k:
                    keys.append(unpacked(k, bits))
                    n.append(unpacked(t, 32))
                    held += len(keys[-1])
            if held > GATHER:
                k, t = _added(np.concatenate(keys), np.concatenate(n))
                keys, n, held = [k], [t], 0
        k, t = _added(np.concatenate(keys), np.concatenate(n))
        for at in range(0, len(k), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(k[at : at + 100_000]), pa.array(t[at : at + 100_000])], ["key", "n"])

    return links.select("keys", "times").mapInArrow(run, "key long, n long")


def _local(folder: str) -> str:
    """The path of a folder of a mounted file system; shards are mapped into memory, so they have to lie in one."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"count shards are memory-mapped: {folder} must be on a file system that all machines mount")
    return unquote(url.path)


def count_shards(partial: DataFrame, folder: str, shift: int) -> list[dict]:
    """Sort the partial counts by ranges of keys, add up the runs and write each range as files of keys and of counts.

    A task that is run again writes files of new names; only those of tasks
    that ended well are told to the driver.
    """
    spark = partial.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        size, first, last, best_b, best_n = 0, 0, 0, [], []

        def put(keys: np.ndarray, total: np.ndarray) -> None:
            nonlocal size, first, last
            first = int(keys[0]) if not size else first
            last, size = int(keys[-1]), size + len(keys)
            keys.astype("<i8").tofile(fk)
            total.astype("<i8").tofile(fn)
            b = keys >> shift
            cut = np.r_[0, np.flatnonzero(np.diff(b)) + 1]
            best_b.append(b[cut])
            best_n.append(np.maximum.reduceat(total, cut))

        with open(f"{path}.keys", "wb") as fk, open(f"{path}.counts", "wb") as fn:
            rest_k, rest_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for b in batches:
                keys, total = np.concatenate([rest_k, b.column(0).to_numpy()]), np.concatenate([rest_n, b.column(1).to_numpy()])
                if len(keys):
                    cut = np.r_[0, np.flatnonzero(np.diff(keys)) + 1]
                    keys, total = keys[cut], np.add.reduceat(total, cut)
                    if len(keys) > 1:
                        put(keys[:-1], total[:-1])
                    rest_k, rest_n = keys[-1:], total[-1:]  # its run may go on
            if len(rest_k):
                put(rest_k, rest_n)
        if size:
            b, at = np.unique(np.concatenate(best_b), return_inverse=True)
            high = np.zeros(len(b), np.int64)
            np.maximum.at(high, at, np.concatenate(best_n))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([first], pa.int64()), pa.array([last], pa.int64()), pa.array([size], pa.int64()), pa.array([b.astype("<i8").tobytes()], pa.binary()), pa.array([high.astype("<i8").tobytes()], pa.binary())], ["path", "first", "last", "size", "b", "high"])

    lined = partial.repartitionByRange(n, "key").sortWithinPartitions("key")
    rows = lined.mapInArrow(run, "path string, first long, last long, size long, b binary, high binary").collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["first"])


class Counts:
    """Look-ups in the shards: sorted keys and counts, mapped into memory when first asked for."""

    def __init__(self, shards: list[tuple[str, int, int, int]]):
        self.shards, self.maps = shards, {}

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys; 0 where a key is not there."""
        out = np.zeros(len(keys), np.int64)
        for i, (path, first, last, size) in enumerate(self.shards):
            lo, hi = np.searchsorted(keys, first), np.searchsorted(keys, last, side="right")
            if lo == hi:
                continue
            if i not in self.maps:
                self.maps[i] = [np.memmap(f"{path}.{what}", "<i8", "r", shape=(size,)) for what in ("keys", "counts")]
            held, n = self.maps[i]
            at = np.minimum(np.searchsorted(held, keys[lo:hi]), size - 1)
            out[lo:hi] = np.where(held[at] == keys[lo:hi], n[at], 0)
        return out


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    A is asked for a space and the text, B for the text (it adds the space). A
    text that is null or empty, or that a tokenizer does not spell byte by
    byte, has no tokens: zeros, and '' for the digest. Tokens are never empty,
    so one token of each side ends where a group does, and links are as many
    as groups. Repeated rows each count and give a row; a null doc_id stays
    null; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    aligner = _aligner(a_path, b_path)
    shift, bits, n_b = aligner.shift, aligner.bits, len(aligner.b_bytes)
    links = staged(aligned(docs, a_path, b_path), "aligned")
    found = count_shards(partial_counts(links, bits), f"{_local(shared_dir(spark))}/pair-counts-{uuid.uuid4().hex}", shift)
    high = np.zeros(n_b, np.int64)
    for r in found:
        b, h = np.frombuffer(r["b"], "<i8"), np.frombuffer(r["high"], "<i8")
        high[b] = np.maximum(high[b], h)
    shards = [(r["path"], r["first"], r["last"], r["size"]) for r in found]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(shards)
        for b in batches:
            raw = [unpacked(k, bits) for k in b.column(2).to_pylist()]
            sizes = np.array([len(k) for k in raw])
            times = np.concatenate([np.zeros(0, np.int64), *(unpacked(t, 32) for t in b.column(3).to_pylist())])
            keys, at = np.unique(np.concatenate([np.zeros(0, np.int64), *raw]), return_inverse=True)
            n = counts.of(keys)
            best = (n == high[keys >> shift])[at] * times
            ends = np.cumsum(sizes)
            add = lambda x, ends=ends, sizes=sizes: (c := np.r_[0, np.cumsum(x)])[ends] - c[ends - sizes]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(add(best)), pa.array(add(n[at] * times))], ["doc_id", "rest", "n_best", "count_sum"])

    rest = F.struct("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    kind = "struct<n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string>"
    done = links.select("doc_id", rest.alias("rest"), "keys", "times").mapInArrow(look_up, f"doc_id long, rest {kind}, n_best long, count_sum long")
    return done.select("doc_id", "rest.n_a", "rest.n_b", "rest.n_groups", "rest.n_links", "n_best", "count_sum", "rest.groups_sha256")


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(b, a, n): how often each pair of ids is linked in the corpus."""
    aligner = _aligner(a_path, b_path)
    part = partial_counts(staged(aligned(docs, a_path, b_path), "aligned"), aligner.bits)
    return part.groupBy("key").agg(F.sum("n").alias("n")).select(F.shiftright("key", aligner.shift).alias("b"), F.col("key").bitwiseAND((1 << aligner.shift) - 1).alias("a"), "n")
