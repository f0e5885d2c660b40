"""Near-duplicate vectors by passes over sorted random hashes.

Every pass draws its own random hyperplanes; the signs of a vector, one bit
after the other, are its hash, and the vectors of a label lie in the order of
their hashes. Vectors close in angle share long beginnings, so they lie close
in the order of some pass. The order is cut into blocks of ``WINDOW`` ranks,
and each block is compared with itself and the next one. Verified pairs of all
passes together are the links, and their components the groups.

Pairs are never written out. A vector carries its block in every pass, so a
task can tell whether a pair has been compared by an earlier pass, and counts
it only once; of the links it sends a spanning forest.

Nothing is lost to the bound of the window: equal vectors are one vector with
a number of copies, and wherever a block has a link into the last block it was
compared with, it goes on with the next 1, 2, 4, ... blocks until a stretch
has none. The number of passes follows from the largest label and the wanted
share of pairs at the threshold (``RECALL``), the worst case; closer pairs
meet more often.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import dropped, staged
from ._components import components

#: Ranks in a block; a vector meets at least so many of its followers.
WINDOW = 512
#: Blocks in a task's share.
TILE = 8
#: Signs in a hash: more than the logarithm of any number of vectors.
BITS = 60
#: Share of the pairs at the threshold that the passes shall bring together, hashes of even halves assumed.
RECALL = 0.99
#: Passes whose blocks are compared in one job, which bounds what is shuffled at once.
AT_ONCE = 6

_FOUND = "kind int, a long, b long"
_FOUND_ARROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
COUNT, EDGE, OPEN = 0, 1, 2


def passes(largest: int, threshold: float) -> int:
    """How many passes bring together ``RECALL`` of the pairs at the threshold, among so many vectors."""
    same = 1 - math.acos(threshold) / math.pi
    meet = same ** max(0.0, math.log2(max(largest, 1) / WINDOW))
    return 1 if meet > RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - meet))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _planes(p: int, dim: int) -> np.ndarray:
    return np.random.default_rng([11, p, dim]).standard_normal((dim, BITS))


def codes(x: np.ndarray, p: int) -> np.ndarray:
    """Hashes of pass ``p``, the first sign in the highest bit."""
    signs = (x @ _planes(p, x.shape[1])) > 0
    return signs.astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def distinct(vectors: DataFrame) -> DataFrame:
    """Each different vector of a label once: k, label, dim, v, first (smallest vec_id) and n (rows)."""
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = vectors.where(F.col("label").isNotNull() & (F.size("v") > 0) & usable)
    v = v.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return v.select(F.monotonically_increasing_id().alias("k"), "label", F.size("v").alias("dim"), "v", "first", "n")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(k, label, unit vectors) of the rows of a batch, one dimension at a time."""
    for b in batches:
        dim = b.column(2).to_numpy(zero_copy_only=False)
        for d in np.unique(dim):
            some = b.filter(pa.array(dim == d))
            flat = some.column(3)
            x = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(len(flat), d)
            yield some.column(0).to_numpy(), some.column(1), int(d), unit(x)


def _ranked(base: DataFrame, n_passes: int) -> DataFrame:
    """(pass, k, block): the blocks of all passes, from one sort of (pass, label, dimension, hash, k)."""
    spark = base.sparkSession

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, label, d, x in _slices(batches):
            for p in range(n_passes):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), p, np.int32)), label, pa.array(np.full(len(k), d, np.int32)), pa.array(codes(x, p)), pa.array(k)], ["pass", "label", "dim", "code", "k"])

    every = base.select("k", "label", "dim", "v").mapInArrow(hashed, "pass int, label long, dim int, code long, k long")
    keys = ["pass", "label", "dim", "code", "k"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lined = every.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("pass", "k", F.monotonically_increasing_id().alias("at"))
    lined = staged(lined, "ranked")
    part = F.shiftright("at", 33)
    sizes = {r.part: r.n for r in lined.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each partition
    starts, total = [], 0
    for i in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(i, 0)
    start = F.element_at(F.lit(starts or [0]).cast("array<long>"), part.cast("int") + 1)
    rank = start + F.col("at").bitwiseAND((1 << 33) - 1)
    return lined.select("pass", "k", F.floor(rank / WINDOW).alias("block"))


def _blocks_of(ranked: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(k, blocks[, ends]): a vector's block in every pass, and how many blocks ahead that block has been compared."""
    if ends is None:
        lists = ranked.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("pass", "block"))).alias("s"))
        return lists.select("k", F.col("s.block").alias("blocks"))
    lists = ranked.join(ends, "block", "left").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("pass", "block", F.coalesce("ahead", F.lit(1)).alias("ahead"), F.coalesce("to", F.lit(0)).alias("to")))).alias("s"))
    return lists.select("k", F.col("s.block").alias("blocks"), F.col("s.ahead").alias("aheads"), F.col("s.to").alias("tos"))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that hold together what all of them do: every node points to the smallest it reaches."""
    nodes, ab = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ab[: len(a)], ab[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            break
    off = root != np.arange(len(root))
    return nodes[off], nodes[root[off]]


def _met(blocks: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per pair and pass, how many blocks lie between."""
    return np.abs(blocks[a] - blocks[b])


class _Finder:
    """What one task finds: links counted once, a forest, blocks that have to go on."""

    def __init__(self, k: np.ndarray, x: np.ndarray, n: np.ndarray, blocks: np.ndarray, threshold: float):
        self.k, self.x, self.n, self.blocks, self.threshold = k, x, n, blocks, threshold
        self.count = np.zeros(len(k), np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.open: list[int] = []

    def compare(self, left: np.ndarray, right: np.ndarray, fresh) -> bool:
        """Compare rows ``left`` with rows ``right`` (or with themselves); ``fresh(a, b)`` marks pairs that no one else counts."""
        a, b = np.nonzero(self.x[left] @ self.x[right].T >= self.threshold)
        a, b = left[a], right[b]
        if left is right:
            a, b = a[a < b], b[a < b]
        if not len(a):
            return False
        new = fresh(a, b)
        if new.any():
            np.add.at(self.count, a[new], self.n[b[new]])
            np.add.at(self.count, b[new], self.n[a[new]])
            self.edges.append(_forest(a[new], b[new]))
        return True

    def found(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.count)
        a, b = _forest(*map(np.concatenate, zip(*self.edges))) if self.edges else (np.zeros(0, int), np.zeros(0, int))
        kind = np.repeat([COUNT, EDGE, OPEN], [len(some), len(a), len(self.open)]).astype(np.int32)
        first = np.concatenate([self.k[some], self.k[a], np.array(self.open, np.int64)])
        second = np.concatenate([self.count[some], self.k[b], np.zeros(len(self.open), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(first), pa.array(second)], schema=_FOUND_ARROW)


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    flat = t.column(name).combine_chunks()
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False)).reshape(len(t), -1)


def _near(base: DataFrame, blocks: DataFrame, first: int, last: int, threshold: float) -> DataFrame:
    """Blocks with themselves and with the next one, for the passes ``first`` to ``last``."""

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by([("label", "ascending"), ("dim", "ascending"), ("block", "ascending")])
        p = t.column("pass")[0].as_py()
        tile = t.column("tile")[0].as_py()
        label, dim, block = (t.column(c).to_numpy() for c in ("label", "dim", "block"))
        cut = np.flatnonzero((np.diff(label) != 0) | (np.diff(dim) != 0)) + 1
        out = []
        for lo, hi in zip(np.r_[0, cut], np.r_[cut, len(t)]):
            some = t.slice(lo, hi - lo)
            at = block[lo:hi]
            f = _Finder(some.column("k").to_numpy(), unit(_matrix(some, "v").astype(float)), some.column("n").to_numpy(), _matrix(some, "blocks"), threshold)

            def fresh(a, b, f=f):
                return ~(_met(f.blocks[:, :p], a, b) <= 1).any(1)

            for m in np.unique(at):
                if m // TILE != tile:
                    continue  # the first block of the next tile comes along to be met only
                own, then = np.flatnonzero(at == m), np.flatnonzero(at == m + 1)
                f.compare(own, own, fresh)
                if len(then) and f.compare(own, then, fresh):
                    f.open.append(int(m))
            out.append(f.found())
        return pa.Table.from_batches(out, _FOUND_ARROW)

    some = F.slice("blocks", first + 1, last - first)
    rows = base.join(blocks, "k").select("k", "label", "dim", "v", "n", "blocks", F.posexplode(some).alias("pass", "block"))
    rows = rows.withColumn("pass", F.col("pass") + first).withColumn("tile", F.floor(F.col("block") / TILE))
    before = F.when((F.col("block") % TILE == 0), F.array("tile", F.col("tile") - 1)).otherwise(F.array("tile"))
    return rows.withColumn("tile", F.explode(before)).groupBy("pass", "tile").applyInArrow(compare, _FOUND)


def _farther(base: DataFrame, ranked: DataFrame, ends: DataFrame, threshold: float) -> DataFrame:
    """Each block that goes on (``to`` > 0) with the blocks ``ahead`` + 1 to ``to`` after it."""

    def compare(t: pa.Table) -> pa.Table:
        p, block = t.column("pass")[0].as_py(), t.column("from")[0].as_py()
        blocks, aheads, tos = (_matrix(t, c) for c in ("blocks", "aheads", "tos"))
        f = _Finder(t.column("k").to_numpy(), np.zeros((len(t), 1)), t.column("n").to_numpy(), blocks, threshold)
        label, dim = (t.column(c).to_numpy() for c in ("label", "dim"))
        right = t.column("right").to_numpy(zero_copy_only=False).astype(bool)

        def fresh(a, b):
            gap = _met(blocks, a, b)
            low = blocks[a] <= blocks[b]
            ahead, to = np.where(low, aheads[a], aheads[b]), np.where(low, tos[a], tos[b])
            return ~(gap <= ahead).any(1) & ~(gap <= to)[:, :p].any(1)

        goes_on = False
        for l, d in {(int(l), int(d)) for l, d in zip(label[~right], dim[~right])}:
            own, then = (np.flatnonzero((label == l) & (dim == d) & side) for side in (~right, right))
            if len(own) and len(then):
                at = np.concatenate([own, then])
                x = unit(_matrix(t.take(pa.array(at)), "v").astype(float))
                f.x = np.zeros((len(t), d))
                f.x[at] = x
                goes_on |= f.compare(own, then, fresh)
        if goes_on:
            f.open.append(block)
        return pa.Table.from_batches([f.found()], _FOUND_ARROW)

    on = ends.where("to > 0").select("block", F.explode(F.sequence(F.col("ahead") + 1, F.col("to"))).alias("step"))
    pairs = on.select(F.col("block").alias("from"), "step", F.col("block").alias("of"), F.lit(False).alias("right")).unionByName(on.select(F.col("block").alias("from"), "step", (F.col("block") + F.col("step")).alias("of"), F.lit(True).alias("right")))
    who = ranked.join(pairs.withColumnRenamed("of", "block"), "block").select("pass", "k", "from", "step", "right")
    there = ranked.join(who.select("k").distinct(), "k", "left_semi")
    rows = who.join(_blocks_of(there, ends), "k").join(base.select("k", "label", "dim", "v", "n"), "k")
    return rows.groupBy("pass", "from", "step").applyInArrow(compare, _FOUND)


def _found(vectors: DataFrame, threshold: float, n_passes: int | None) -> tuple[DataFrame, list[DataFrame]]:
    """The different vectors, and what all passes found among them."""
    base = staged(distinct(vectors), "vectors")
    largest = base.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    n_passes = n_passes or passes(largest, threshold)
    ranked = staged(_ranked(base, n_passes), "blocks")
    blocks = staged(_blocks_of(ranked), "block-lists")
    found = [staged(_near(base, blocks, p, min(p + AT_ONCE, n_passes), threshold), "near") for p in range(0, n_passes, AT_ONCE)]
    ends, fresh = None, found
    while True:
        go = [f.where(F.col("kind") == OPEN).select(F.col("a").alias("block")) for f in fresh]
        go = staged(_union(go).distinct(), "open")
        if go.isEmpty():
            break
        # compared so far: ``ahead`` blocks; the next stretch is as long as all before it
        was = go.select("block", F.lit(1).cast("long").alias("ahead")) if ends is None else ends.select("block", F.greatest("ahead", "to").alias("ahead"))
        new = was.join(go.withColumn("on", F.lit(True)), "block", "left").select("block", "ahead", F.when(F.col("on"), F.col("ahead") * 2).otherwise(F.lit(0)).alias("to"))
        ends = staged(new, "ends")
        fresh = [staged(_farther(base, ranked, ends, threshold), "farther")]
        found += fresh
    dropped(blocks)
    return base, found


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, n_passes: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Rows link when their labels are equal and not null and their cosine, in
    doubles, is at least the threshold; vectors of different length do not. A
    vector that is null, empty, zero, or holds a null or non-finite component
    links with nothing, and stands for itself. Repeated rows are vectors of
    their own that link with each other. component_id is the smallest vec_id
    that is not null; a row without vec_id is kept if its group has none.
    Other columns are ignored; an empty table gives an empty result.
    """
    kind = dict(vectors.dtypes)["embedding"]
    v = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")  # singles travel as such, and are doubles in the tasks
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    base, found = _found(rows, threshold, n_passes)
    every = _union(found)
    counts = every.where(F.col("kind") == COUNT).groupBy(F.col("a").alias("k")).agg(F.sum("b").alias("links"))
    groups = staged(components(every.where(F.col("kind") == EDGE).select("a", "b")), "groups")
    firsts = groups.join(base.select(F.col("k").alias("node"), "first"), "node").groupBy("root").agg(F.min("first").alias("smallest"))
    of = groups.join(firsts, "root").select(F.col("node").alias("k"), "smallest")
    told = base.join(counts, "k", "left").join(of, "k", "left").select(
        "label", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("smallest", "first").alias("smallest")
    )
    out = rows.join(staged(told, "told"), ["label", "v"], "left").withColumn("alone", F.col("links").isNull())
    component = F.when(F.col("alone"), F.col("vec_id")).otherwise(F.col("smallest"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


#: Every pair of a label, and the smallest vec_id that is reached.
SQL = """WITH RECURSIVE u AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c.b, e.vec_id)) AS component_id, e.vec_id <= coalesce(c.b, e.vec_id) AS kept
FROM embeddings AS e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id"""
