"""Interleaved binary recordings as a Spark data source.

``spark.read.format("binary_signal")`` with options ``path`` (one file, or
several joined by commas, one after the other in time; paths or URIs of any
store that Arrow opens), ``channels`` (their number), ``fs``, ``dtype``
(int16), ``select`` (channels to read, by commas), ``start`` and ``stop``
(seconds) and ``block`` (samples in a partition). Conditions on sample_idx, t
and channel reach the source: blocks that cannot hold such a sample are no
partition, and of the others only the bytes between the first and the last
such sample are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .stores import files_below, read_range, size_of

DDL = "channel int, sample_idx bigint, t double, value double"


class _Block(InputPartition):
    def __init__(self, path: str, lo: int, hi: int, first: int):
        self.path, self.lo, self.hi, self.first = path, lo, hi, first


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p.strip() for p in options["path"].split(",")]
        self.n = int(options.get("channels", 1))
        self.fs = float(options.get("fs", 1250.0))
        self.dtype = options.get("dtype", "int16")
        chosen = options.get("select")
        self.chosen = [int(c) for c in chosen.split(",")] if chosen else list(range(self.n))
        self.lo, self.hi = float(options.get("start", "-inf")), float(options.get("stop", "inf"))
        self.from_sample, self.to_sample = 0, 1 << 62  # first sample wanted, and the one after the last
        self.block = int(options.get("block", 1 << 20))
        if any(c < -self.n or c >= self.n for c in self.chosen):
            raise ValueError(f"channels are 0 to {self.n - 1}")
        self.chosen = [c % self.n for c in self.chosen]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrow what is read; Spark still evaluates every condition on the rows that come."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column == "channel":
                if isinstance(f, EqualTo):
                    self.chosen = [c for c in self.chosen if c == f.value]
                elif isinstance(f, In):
                    self.chosen = [c for c in self.chosen if c in f.value]
            elif column in ("sample_idx", "t") and not isinstance(f, In) and hasattr(f, "value"):
                at = f.value if column == "sample_idx" else f.value * self.fs
                slack = 0 if column == "sample_idx" else 1  # times are divided by the rate, so a sample more on either side
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)) and at > -(1 << 62):
                    self.from_sample = max(self.from_sample, math.floor(at) - slack)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)) and at < 1 << 62:
                    self.to_sample = min(self.to_sample, math.ceil(at) + 1 + slack)
            elif column == "sample_idx" and isinstance(f, In) and f.value:
                self.from_sample, self.to_sample = max(self.from_sample, min(f.value)), min(self.to_sample, max(f.value) + 1)
            yield f

    def partitions(self) -> list[InputPartition]:
        """Blocks of samples, cut to the samples that are wanted."""
        out, first = [], 0
        frame = self.n * np.dtype(self.dtype).itemsize
        low = self.from_sample if self.lo == -math.inf else max(self.from_sample, math.floor(self.lo * self.fs) - 1)
        high = self.to_sample if self.hi == math.inf else min(self.to_sample, math.ceil(self.hi * self.fs) + 2)
        for p in self.paths:
            size = size_of(p)
            if size % frame:
                raise ValueError(f"{p} does not hold whole samples of {self.n} channels")
            samples = size // frame
            for at in range(0, samples, self.block):
                lo, hi = max(at, low - first), min(samples, at + self.block, high - first)
                if lo < hi and self.chosen:
                    out.append(_Block(p, lo, hi, first))
            first += samples
        return out

    def read(self, part: _Block) -> Iterator[pa.RecordBatch]:
        """Rows channel by channel, from the bytes of the block alone."""
        frame = self.n * np.dtype(self.dtype).itemsize
        x = np.frombuffer(read_range(part.path, part.lo * frame, (part.hi - part.lo) * frame), self.dtype).reshape(-1, self.n)
        i = np.arange(part.lo, part.hi, dtype=np.int64) + part.first
        t = i / self.fs
        keep = (t >= self.lo) & (t <= self.hi)
        schema = pa.schema([("channel", pa.int32()), ("sample_idx", pa.int64()), ("t", pa.float64()), ("value", pa.float64())])
        for c in self.chosen:
            v = x[keep, c].astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, np.int32)), pa.array(i[keep]), pa.array(t[keep]), pa.array(v)], schema=schema)


class BinarySignal(DataSource):
    @classmethod
    def name(cls) -> str:
        return "binary_signal"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, path: str | list[str], channels: int, fs: float, select: list[int] | None = None, start: float | None = None, stop: float | None = None, dtype: str = "int16", block: int | None = None) -> DataFrame:
    """Long signal table of a recording, or of several in a row. Turns the session's pushdown to Python sources on."""
    spark.dataSource.register(BinarySignal)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    r = spark.read.format("binary_signal").option("channels", channels).option("fs", fs).option("dtype", dtype)
    r = r.option("path", path if isinstance(path, str) else ",".join(path))
    for k, v in (("select", ",".join(map(str, select)) if select else None), ("start", start), ("stop", stop), ("block", block)):
        if v is not None:
            r = r.option(k, v)
    return r.load()


class Recording:
    """Recordings one after the other as one table that is cut like a matrix of samples x channels.

    ``rec[samples, channels]`` takes whole numbers, slices, lists and masks,
    counts negative numbers from the end, and gives the long table (channel,
    sample_idx, t, value) of what was chosen, read only where it lies.
    ``rec.T[channels, samples]`` is the same the other way round.
    """

    def __init__(self, spark: SparkSession, path: str | Sequence[str], channels: int, fs: float = 1250.0, dtype: str = "int16", turned: bool = False, block: int | None = None):
        self.spark, self.paths, self.channels, self.fs, self.dtype, self.turned, self.block = spark, [path] if isinstance(path, str) else list(path), channels, fs, dtype, turned, block
        frame = channels * np.dtype(dtype).itemsize
        self.lengths = [size_of(p) // frame for p in self.paths]

    @property
    def shape(self) -> tuple[int, int]:
        n = (sum(self.lengths), self.channels)
        return n[::-1] if self.turned else n

    @property
    def T(self) -> Recording:
        return Recording(self.spark, self.paths, self.channels, self.fs, self.dtype, not self.turned, self.block)

    def table(self) -> DataFrame:
        return read(self.spark, self.paths, self.channels, self.fs, dtype=self.dtype, block=self.block)

    def __len__(self) -> int:
        return self.shape[0]

    def __getitem__(self, index) -> DataFrame:
        index = index if isinstance(index, tuple) else (index,)
        if len(index) > 2:
            raise IndexError(f"a recording has samples and channels; got {len(index)} dimensions")
        rows, columns = (*index, slice(None))[:2]
        if self.turned:
            rows, columns = columns, rows
        return self.table().where(_chosen("sample_idx", rows, sum(self.lengths)) & _chosen("channel", columns, self.channels))


def _chosen(column: str, index, n: int):
    """Condition on a column for an index of one dimension of length ``n``."""
    c = F.col(column)
    if isinstance(index, slice):
        r = range(n)[index]
        if not len(r):
            return F.lit(False)
        low, high = min(r[0], r[-1]), max(r[0], r[-1])
        within = (c >= low) & (c <= high)
        return within if abs(r.step) == 1 else within & (F.pmod(c - low, F.lit(abs(r.step))) == 0)
    at = np.asarray(index)
    if at.dtype == bool:
        if at.shape != (n,):
            raise IndexError(f"a mask of {at.shape} for {n}")
        at = np.flatnonzero(at)
    at = np.atleast_1d(at)
    if len(at) and (at.min() < -n or at.max() >= n):
        raise IndexError(f"{column} {at.min()} to {at.max()} of {n}")
    return c.isin(sorted({int(i) % n for i in at})) if len(at) else F.lit(False)


def epoch_file(folder: str) -> str:
    """The recording of an epoch's folder: amplifier.dat, else the one continuous.dat below it (or below its rhythm data)."""
    every = files_below(folder)
    first = [f for f in every if f.rstrip("/").endswith(f"{folder.rstrip('/').rsplit('/', 1)[-1]}/amplifier.dat")]
    if first:
        return first[0]
    found = [f for f in every if f.endswith("/continuous.dat")]
    if len(found) > 1:
        found = [f for f in found if "Rhythm" in f]
    if len(found) != 1:
        raise ValueError(f"{folder}: {len(found)} recordings to choose from")
    return found[0]


def block_files(raw: DataFrame, name: str, channels: int, dtype: str = "int16", block: int = 1 << 18) -> DataFrame:
    """(path, content): files ``<name>-<block>.dat`` of interleaved samples; samples that are missing are zeros. Read in order they are the recording."""
    import pandas as pd

    def put(g: pd.DataFrame) -> pd.DataFrame:
        k, last = int(g["_block"].iloc[0]), int(g["_last"].iloc[0])
        x = np.zeros((min(block, last + 1 - k * block), channels), dtype)
        x[g["sample_idx"].to_numpy() - k * block, g["channel"].to_numpy()] = g["value"].to_numpy()
        return pd.DataFrame({"path": [f"{name}-{k:08d}.dat"], "content": [x.tobytes()]})

    last = raw.agg(F.max("sample_idx").alias("_last"))  # one row
    return raw.join(F.broadcast(last), F.lit(True)).withColumn("_block", F.floor(F.col("sample_idx") / block)).groupBy("_block").applyInPandas(put, "path string, content binary")


# operations on long raw tables (channel, sample_idx, value)


def remove_artifacts(raw: DataFrame, intervals: DataFrame, mode: str = "linear", channels: list[int] | None = None) -> DataFrame:
    """Samples of intervals [start, stop) become zero, or run straight from the value at start to that at stop; intervals beyond the recording are skipped."""
    from ..operators.joins import range_join

    if mode not in ("zeros", "linear"):
        raise NotImplementedError(mode)
    last = raw.agg(F.max("sample_idx").alias("_last"))
    iv = intervals.join(F.broadcast(last), F.lit(True)).where("start >= 0 and stop <= _last + 1").drop("_last")  # one row
    w = iv.select(F.col("start").alias("_lo"), F.col("stop").alias("_hi"))
    x = range_join(raw, w, "sample_idx", "_lo", "_hi", 1 << 16, ends="left", how="left")
    hit = F.col("_lo").isNotNull()
    if channels is not None:
        hit &= F.col("channel").isin(channels)
    if mode == "zeros":
        return x.withColumn("value", F.when(hit, 0).otherwise(F.col("value")).cast(raw.schema["value"].dataType)).select(*raw.columns)
    a = raw.select(F.col("channel").alias("_c"), F.col("sample_idx").alias("_s"), F.col("value").alias("_v0"))
    b = raw.select(F.col("channel").alias("_c2"), F.col("sample_idx").alias("_s2"), F.col("value").alias("_v1"))
    x = x.join(a, (F.col("channel") == F.col("_c")) & (F.col("_lo") == F.col("_s")), "left").join(b, (F.col("channel") == F.col("_c2")) & (F.col("_hi") == F.col("_s2")), "left")
    n = F.col("_hi") - F.col("_lo")
    line = F.col("_v0") + (F.col("sample_idx") - F.col("_lo")) * F.try_divide(F.coalesce("_v1", "_v0") - F.col("_v0"), n - 1)
    return x.withColumn("value", F.when(hit, F.coalesce(line, F.col("_v0").cast("double"))).otherwise(F.col("value")).cast(raw.schema["value"].dataType)).select(*raw.columns)


def cut_artifacts(raw: DataFrame, intervals: DataFrame) -> DataFrame:
    """Samples outside [start, stop), numbered anew without gaps: each index loses the length cut before it."""
    from ..operators.intervals import gap_offsets, merge
    from ..operators.joins import asof_join, range_join

    w = intervals.select(F.col("start").alias("_lo"), F.col("stop").alias("_hi"))
    kept = range_join(raw, w, "sample_idx", "_lo", "_hi", 1 << 16, ends="left", how="left_anti")
    m = gap_offsets(merge(intervals.select(F.col("start").cast("double"), F.col("stop").cast("double"))))
    m = m.select(F.col("stop").cast("long").alias("sample_idx"), (F.col("before") + F.col("stop") - F.col("start")).cast("long").alias("_cut"))
    got = asof_join(kept, m, "sample_idx", ["_cut"], width=float(1 << 16))
    return got.withColumn("sample_idx", F.col("sample_idx") - F.coalesce("_cut", F.lit(0))).select(*raw.columns)


def fill_channels(raw: DataFrame, missing: list[int]) -> DataFrame:
    """Zero channels at the given places; the others move up."""
    new = F.col("channel")
    for m in sorted(missing):
        new = F.when(new >= m, new + 1).otherwise(new)
    moved = raw.withColumn("channel", new.cast("int"))
    empty = raw.select("sample_idx").distinct().withColumn("channel", F.explode(F.array(*[F.lit(m) for m in missing]))).withColumn("value", F.lit(0).cast(raw.schema["value"].dataType))
    return moved.select("channel", "sample_idx", "value").unionByName(empty.select("channel", "sample_idx", "value"))


def reorder_channels(raw: DataFrame, order: list[int]) -> DataFrame:
    """Channel ``order[k]`` becomes channel k."""
    if sorted(order) != list(range(len(order))):
        raise ValueError("the order must name each channel once")
    at = F.array(*[F.lit(order.index(c)) for c in range(len(order))])
    return raw.withColumn("channel", F.element_at(at, F.col("channel") + 1))


def write(raw: DataFrame, path: str, channels: int, dtype: str = "int16", block: int = 1 << 18) -> None:
    """Interleaved blocks of samples as files block-<k>.dat in a folder, each by one task."""
    import pandas as pd

    def put(g: pd.DataFrame) -> pd.DataFrame:
        k, n = int(g["_block"].iloc[0]), g["sample_idx"].nunique()
        x = np.zeros((n, channels), dtype)
        x[g["sample_idx"].to_numpy() - g["sample_idx"].min(), g["channel"].to_numpy()] = g["value"].to_numpy()
        return pd.DataFrame({"block": [k], "data": [x.tobytes()]})

    blocks = raw.withColumn("_block", F.floor(F.col("sample_idx") / block)).groupBy("_block").applyInPandas(put, "block long, data binary")
    blocks.write.mode("overwrite").parquet(path)
