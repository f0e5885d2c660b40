"""Shuffles of packed records.

A map task sorts its records by target part and sends each part one block of
columns, so that Spark moves few rows of dense bytes in place of many small
rows. A reduce task gets the blocks of a part together and works on them with
NumPy. Parts are numbers below a count that follows the session's shuffle
partitions; whoever packs records must have summed or deduplicated them, so
that a frequent key gives a map task's block one record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BLOCK = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("block", pa.binary())])
BLOCK_DDL = "part int, kind int, n int, block binary"
#: Records in a block at most: 64 K of them are a megabyte or two.
MOST = 1 << 16


def parts(spark: SparkSession) -> int:
    """Number of parts: the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _dense(c: np.ndarray) -> bytes:
    """Columns other than hashes go byte plane by byte plane, so that high bytes compress to nothing."""
    c = np.ascontiguousarray(c)
    if c.dtype == np.uint64 or c.dtype.itemsize == 1:
        return c.tobytes()
    return np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T).tobytes()


def pack(part: np.ndarray, columns: Sequence[np.ndarray], kind: int = 0) -> Iterator[pa.RecordBatch]:
    """Blocks of the records, by part; inside a block the given order stays."""
    if not len(part):
        return
    codec = pa.Codec("zstd", compression_level=1)
    order = np.argsort(part, kind="stable")
    part = part[order]
    columns = [c[order] for c in columns]
    cut = np.flatnonzero(np.diff(part)) + 1
    ids, ns, blocks = [], [], []
    for a, b in zip(np.r_[0, cut], np.r_[cut, len(part)], strict=True):
        for at in range(a, b, MOST):
            to = min(b, at + MOST)
            ids.append(int(part[a]))
            ns.append(to - at)
            blocks.append(codec.compress(b"".join(_dense(c[at:to]) for c in columns), asbytes=True))
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([kind] * len(ids), pa.int32()), pa.array(ns, pa.int32()), pa.array(blocks, pa.binary())], schema=BLOCK)


def unpack(n: int, block: bytes, dtypes: Sequence[np.dtype]) -> list[np.ndarray]:
    dtypes = list(map(np.dtype, dtypes))
    raw = pa.Codec("zstd").decompress(block, n * sum(t.itemsize for t in dtypes), asbytes=True)
    out, at = [], 0
    for t in dtypes:
        if t == np.uint64 or t.itemsize == 1:
            out.append(np.frombuffer(raw, t, n, at))
        else:
            planes = np.frombuffer(raw, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n)
            out.append(np.ascontiguousarray(planes.T).view(t).ravel())
        at += n * t.itemsize
    return out


def joined(blocks: list[tuple[int, bytes]], dtypes: Sequence[np.dtype]) -> list[np.ndarray]:
    got = [unpack(n, b, dtypes) for n, b in blocks]
    return [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.zeros(0, t) for t in dtypes]


def by_part(blocks: DataFrame, n_parts: int, reduce: Callable[[int, dict[int, list[tuple[int, bytes]]]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """Bring the blocks of each part together; ``reduce(part, {kind: [(n, block)]})`` makes the output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for b in batches:
            for part, kind, n, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now:
                    if held:
                        yield from reduce(now, held)
                    now, held = part, {}
                held.setdefault(kind, []).append((n, block))
        if held:
            yield from reduce(now, held)

    return blocks.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(run, ddl)
