"""Incremental removal of repeated word windows with a log-structured fingerprint index.

The index is a list of immutable runs, each sorted by hash within its parts:
runs of group fingerprints and runs of window hashes (:mod:`._repeats` tells
how windows form groups). A batch of new documents is hashed and meets all runs
part by part; its sorted window hashes are merge-joined with those of each run
and verified by a second independent hash of the whole window. A batch leaves a
run of what it brought. When there are more than FANOUT runs they are compacted
into one. With a folder of its own the index can be opened again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _blocks, _repeats
from ._common import keyed_text, staged

#: Runs that may stand side by side.
FANOUT = 3
#: Where the table is cut into batches, as shares of the range of ids: each doubles what the index holds.
SPLITS = (0.0625, 0.125, 0.25, 0.5)
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string"
KEPT = pa.schema([("doc_id", pa.int64()), ("kept", pa.string())])


def _digest(kind, symbols, gone):
    return len(symbols), int(gone.sum()), hashlib.sha256(kind.kept(symbols, gone)).hexdigest()


def _kept(kind, symbols, gone):
    return (kind.kept(symbols, gone).decode(),)


class FingerprintIndex:
    """Fingerprints of the documents added so far, and those documents.

    With ``path``, a folder in a store that driver and executors share, runs
    and documents are kept there, and an index that is already there goes on.
    """

    def __init__(self, spark, window: int = 20, gram: int | None = None, n_parts: int | None = None, path: str | None = None):
        self.spark, self.path = spark, path
        self.runs: list[tuple[DataFrame, DataFrame]] = []
        self.docs: DataFrame | None = None
        self._names: list[str] = []
        self._added = 0
        gram = gram or max(1, min(6, window // 2))
        self.n_parts = n_parts or _blocks.parts(spark)
        if path and (last := self._manifest()):
            window, gram, self.n_parts, self._added = last["window"], last["gram"], last["n_parts"], last["version"]
            self._names = last["runs"].split(",")
            self.runs = [(self._read(f"{n}/groups"), self._read(f"{n}/windows")) for n in self._names]
            self.docs = spark.read.parquet(f"{path}/docs")
        self.window, self.gram = window, gram
        self.make = lambda: _repeats.Words(window, gram)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(_blocks.BLOCK_DDL).parquet(f"{self.path}/{name}")

    def _manifest(self):
        """The last state written, or None if the folder holds none."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return None
        return self.spark.read.parquet(f"{self.path}/manifest").orderBy(F.desc("version")).first()

    def _store(self, groups: DataFrame, windows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """A run, in a folder of its own if the index has one."""
        if not self.path:
            return groups, windows
        groups.write.mode("overwrite").parquet(f"{self.path}/{name}/groups")
        windows.write.mode("overwrite").parquet(f"{self.path}/{name}/windows")
        self._names.append(name)
        return self._read(f"{name}/groups"), self._read(f"{name}/windows")

    def _commit(self) -> None:
        """Write the list of live runs as the newest version; what an unfinished batch wrote is never listed."""
        if self.path:
            row = (self._added, ",".join(self._names), self.window, self.gram, self.n_parts)
            state = self.spark.createDataFrame([row], "version long, runs string, window int, gram int, n_parts int")
            state.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _past(self) -> tuple[DataFrame, DataFrame] | None:
        if not self.runs:
            return None
        groups, windows = self.runs[0]
        for g, w in self.runs[1:]:
            groups, windows = groups.unionByName(g), windows.unionByName(w)
        return groups, windows

    def add(self, batch: DataFrame, digest: bool = True, share: float = 1.0) -> DataFrame:
        """The batch's documents without the words that the index, or an earlier place of the batch, has.

        A later batch counts as later whatever its doc_ids. The result does
        not change when more batches follow. Of the documents of earlier
        batches only those are hashed again that hold a group that has to be
        opened. ``share`` says how much of the usual number of parts the batch's
        documents call for.
        """
        parts = max(1, math.ceil(self.n_parts * share))
        found, groups, windows = _repeats.marks(batch, self.make, self.n_parts, self._past(), self.docs, keep_run=True, doc_parts=parts)
        self._added += 1
        self.runs.append(self._store(groups, windows, f"run-{self._added}"))
        own = keyed_text(batch)
        if self.path:
            own.write.mode("overwrite").parquet(f"{self.path}/docs/batch={self._added}")
            self.docs = self.spark.read.parquet(f"{self.path}/docs")
        else:
            self.docs = own if self.docs is None else self.docs.unionByName(own)
        if len(self.runs) > FANOUT:
            self.compact()
        self._commit()
        if digest:
            return _repeats.removed(batch, found, self.make, parts, _digest, SCHEMA, DDL)
        return _repeats.removed(batch, found, self.make, parts, _kept, KEPT, "doc_id long, kept string")

    def compact(self) -> None:
        """Merge all runs into one, sorted again; groups whose bucket has been opened are let go."""
        groups, windows = self._past()

        def merged_groups(part: int, held: dict) -> Iterator[pa.RecordBatch]:
            cols = _blocks.joined(held[0], _repeats.GROUP_T)
            order = np.lexsort((cols[1], cols[0]))
            cols = [c[order] for c in cols]
            opened = np.unique(cols[0][cols[1] == 0])
            keep = (cols[1] == 0) | ~np.isin(cols[0], opened)
            yield from _blocks.pack(np.full(int(keep.sum()), part, np.int32), [c[keep] for c in cols])

        def merged_windows(part: int, held: dict) -> Iterator[pa.RecordBatch]:
            cols = _blocks.joined(held[0], _repeats.Words.NAMES)
            order, new = _repeats._first((), tuple(cols))
            yield from _blocks.pack(np.full(int(new.sum()), part, np.int32), [c[order][new] for c in cols])

        merge = lambda d, f, name: staged(_blocks.by_part(zero(d), self.n_parts, f, _blocks.BLOCK_DDL), name)
        zero = lambda d: d.select("part", F.lit(0).alias("kind"), "n", "block")
        self._names = []
        self.runs = [self._store(merge(groups, merged_groups, "group-run"), merge(windows, merged_windows, "window-run"), f"compacted-{self._added}")]


def remove(docs: DataFrame, window: int = 20, gram: int | None = None, splits: tuple[float, ...] = SPLITS, digest: bool = True) -> DataFrame:
    """Each document without the words covered by a ``window``-word sequence that also starts earlier.

    The table goes through the index in batches of rising doc_id, cut at the
    given shares of the range of ids; the batches do not change the result.
    With ``digest``: doc_id, n_words, n_removed, kept_sha256; without: doc_id
    and the ``kept`` words joined by a space. Null and empty texts have no
    words. A row that repeats a doc_id and its text counts as the same
    document; rows that share only the doc_id are ordered by a digest of their
    text. Rows with a null doc_id come last. Other columns are ignored.
    """
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    index = FingerprintIndex(docs.sparkSession, window, gram)
    cuts = sorted({low + int((high - low) * s) for s in splits}) if low is not None else []
    if not cuts:
        return index.add(docs, digest)
    d = F.col("doc_id")
    edges = [low - 1, *cuts, high]
    tasks = docs.rdd.getNumPartitions()

    share = lambda a, b: (b - a) / max(1, high - low + 1)

    def batch(a: int, b: int) -> DataFrame:
        """Rows with ids above a, up to b, read by the batch's share of the tasks: each task sends a block to each part."""
        last = d.isNull() if b == high else F.lit(False)
        return docs.where((d > a) & (d <= b) | last).coalesce(max(1, math.ceil(tasks * share(a, b))))

    out = None
    for a, b in zip(edges, edges[1:]):
        if b > a:
            got = index.add(batch(a, b), digest, share(a, b))
            out = got if out is None else out.unionByName(got)
    return out


#: The same in DuckDB's SQL, over the documents table.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+19], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE n > 1),
k AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.p) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d) t LEFT JOIN g ON g.doc_id = t.doc_id AND g.p = t.p WHERE g.p IS NULL GROUP BY t.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
