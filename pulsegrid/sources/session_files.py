"""Readers and writers of session files: XML headers, MAT structures, tracking tables, event text."""

from __future__ import annotations

import io
import struct
import zlib
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """:func:`headers` of the files that the path names."""
    return headers(spark.read.format("binaryFile").load(path).select("path", "content"))


def headers(files: DataFrame) -> DataFrame:
    """(session, n_channels, fs_lfp, fs_dat, groups) of each header file (path, content); groups are arrays of channels."""
    import xml.etree.ElementTree as ET

    import pandas as pd

    def parse(frames):
        for f in frames:
            rows = []
            for p, c in zip(f["path"], f["content"], strict=True):
                root = ET.fromstring(bytes(c))
                text = lambda q, r=root: (e.text if (e := r.find(q)) is not None else None)
                groups = [[int(ch.text) for ch in g.iter("channel")] for g in root.findall("./spikeDetection/channelGroups/group") or root.findall("./anatomicalDescription/channelGroups/group")]
                whole = lambda v: int(float(v)) if v is not None else None
                rows.append((p.rsplit("/", 2)[-2], whole(text("./acquisitionSystem/nChannels")), float(text("./fieldPotentials/lfpSamplingRate") or "nan"), float(text("./acquisitionSystem/samplingRate") or "nan"), groups))
            yield pd.DataFrame(rows, columns=["session", "n_channels", "fs_lfp", "fs_dat", "groups"])

    return files.mapInPandas(parse, "session string, n_channels int, fs_lfp double, fs_dat double, groups array<array<int>>")


def probe_layout(headers: DataFrame, coordinates: DataFrame | None = None) -> DataFrame:
    """(session, shank, nth, channel) in the order of the groups, with x and y if given."""
    g = headers.select("session", F.posexplode("groups").alias("shank", "_g")).select("session", "shank", F.posexplode("_g").alias("nth", "channel"))
    return g if coordinates is None else g.join(coordinates, ["session", "channel"], "left")


def read_position(spark: SparkSession, path: str, fs: float = 39.0625) -> DataFrame:
    """(sample_idx, t, x1, y1, x2, y2) of tab-separated tracking with a header line; -1 is missing."""
    raw = spark.read.csv(path, sep="\t", header=True, schema="x1 double, y1 double, x2 double, y2 double")
    cols = [F.when(F.col(c) != -1, F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")]
    n = raw.withColumn("_id", F.monotonically_increasing_id())
    # places follow from the sizes of the partitions before; their list has a row for each partition
    part = F.shiftright("_id", 33)
    sizes = n.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n")).collect()
    before, start = 0, {}
    for r in sorted(sizes, key=lambda r: r["_p"]):
        start[r["_p"]] = before
        before += r["_n"]
    offset = F.create_map(*[F.lit(v) for kv in start.items() for v in kv]) if start else F.create_map(F.lit(0).cast("long"), F.lit(0))
    i = (F.try_element_at(offset, part) + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")
    return n.select(i.alias("sample_idx"), (i / fs).alias("t"), *cols)


def write_events(epochs: DataFrame, path: str, name: str) -> None:
    """Text of two lines for each epoch: its start and its stop in milliseconds with the name and 1 or 2."""
    lines = epochs.orderBy("start").select(F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(f"{name} start 1").alias("l")), F.struct(F.col("stop").alias("t"), F.lit(f"{name} end 1").alias("l")))).alias("e"))
    lines.select(F.concat_ws(" ", F.format_string("%.6f", F.col("e.t") * 1000), F.col("e.l")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_epochs(epochs: DataFrame, path: str, kind: str, detector: str | None = None) -> None:
    """Epochs as the event dataset of a session: peak and centre in the middle, duration, detector."""
    mid = (F.col("start") + F.col("stop")) / 2
    out = epochs.withColumn("peak", mid).withColumn("center", mid).withColumn("duration", F.col("stop") - F.col("start"))
    out = out.withColumn("detector", F.lit(detector).cast("string")).withColumn("kind", F.lit(kind))
    if "session" not in out.columns:
        out = out.withColumn("session", F.lit("session"))
    out.write.mode("append").partitionBy("session", "kind").parquet(path)


def read_events(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    e = spark.read.parquet(path)
    return e if kind is None else e.where(F.col("kind") == kind)


# MAT files, version 5

#: element types of the format (fixed values)
_NUMERIC = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}


def parse_mat(data: bytes) -> dict[str, Any]:
    """Variables of a version 5 file: arrays, strings, cells as lists, structures as dicts or lists of dicts."""
    order = "<" if data[126:128] == b"IM" else ">"
    out: dict[str, Any] = {}
    at = 128
    while at + 8 <= len(data):
        kind, body, at = _element(data, at, order)
        if kind == 15:
            kind, body, _ = _element(zlib.decompress(body), 0, order)
        if kind == 14:
            name, value = _matrix(body, order)
            out[name] = value
    return out


def _element(data: bytes, at: int, order: str) -> tuple[int, bytes, int]:
    word = struct.unpack_from(order + "I", data, at)[0]
    if word >> 16:  # small element: size and type in one word
        return word & 0xFFFF, data[at + 4 : at + 4 + (word >> 16)], at + 8
    size = struct.unpack_from(order + "I", data, at + 4)[0]
    end = at + 8 + size
    return word, data[at + 8 : end], end if word == 15 else end + (-size) % 8


def _numbers(kind: int, body: bytes, order: str) -> np.ndarray:
    return np.frombuffer(body, order + _NUMERIC[kind])


def _matrix(body: bytes, order: str) -> tuple[str, Any]:
    if not body:
        return "", np.zeros((0, 0))
    _, flags, at = _element(body, 0, order)
    word = struct.unpack_from(order + "I", flags)[0]
    cls, imaginary = word & 0xFF, bool(word & 0x800)
    k, b, at = _element(body, at, order)
    shape = tuple(_numbers(k, b, order))
    _, b, at = _element(body, at, order)
    name = b.decode("latin-1")
    count = int(np.prod(shape))
    if cls == 1:
        cells = []
        for _ in range(count):
            _, b, at = _element(body, at, order)
            cells.append(_matrix(b, order)[1])
        return name, cells
    if cls in (2, 3):
        if cls == 3:
            _, _, at = _element(body, at, order)
        k, b, at = _element(body, at, order)
        width = int(_numbers(k, b, order)[0])
        _, b, at = _element(body, at, order)
        fields = [b[i : i + width].split(b"\0")[0].decode("latin-1") for i in range(0, len(b), width)]
        rows = []
        for _ in range(count):
            row = {}
            for f in fields:
                _, b, at = _element(body, at, order)
                row[f] = _matrix(b, order)[1]
            rows.append(row)
        return name, rows[0] if count == 1 else rows
    k, b, at = _element(body, at, order)
    if cls == 4:
        raw = b if k in (1, 2, 16) else _numbers(k, b, order).astype("u2").tobytes()
        text = raw.decode("utf-8" if k in (1, 2, 16) else "utf-16-le", "replace")
        return name, text if len(shape) < 2 or shape[0] <= 1 else ["".join(text[i :: shape[0]]).rstrip() for i in range(shape[0])]
    x = _numbers(k, b, order)
    if imaginary:
        k, b, at = _element(body, at, order)
        x = x + 1j * _numbers(k, b, order)
    return name, x.reshape(shape, order="F")


def build_mat(variables: dict[str, Any]) -> bytes:
    """A version 5 file of numeric arrays, strings, lists and dicts."""
    out = io.BytesIO()
    out.write(b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM")
    for name, v in variables.items():
        out.write(_pack(14, _pack_matrix(name, v)))
    return out.getvalue()


def _pack(kind: int, body: bytes) -> bytes:
    return struct.pack("<II", kind, len(body)) + body + b"\0" * ((-len(body)) % 8)


def _pack_matrix(name: str, v: Any) -> bytes:
    head = lambda cls, shape: _pack(6, struct.pack("<II", cls, 0)) + _pack(5, np.array(shape, "<i4").tobytes()) + _pack(1, name.encode())
    if v is None:
        v = np.zeros((0, 0))
    if isinstance(v, str):
        return head(4, (1, len(v))) + _pack(4, v.encode("utf-16-le"))
    if isinstance(v, dict):
        fields = list(v)
        names = b"".join(f.encode().ljust(32, b"\0") for f in fields)
        return head(2, (1, 1)) + struct.pack("<HHi", 5, 4, 32) + _pack(1, names) + b"".join(_pack(14, _pack_matrix("", v[f])) for f in fields)
    if isinstance(v, list):
        return head(1, (1, len(v))) + b"".join(_pack(14, _pack_matrix("", x)) for x in v)
    x = np.atleast_2d(np.asarray(v, float))
    return head(6, x.shape) + _pack(9, x.astype("<f8").tobytes(order="F"))


#: Rows of files that a task holds before it passes them on.
_ROWS = 1 << 16


def read_mat_events(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """:func:`mat_events` of the files that the path names."""
    return mat_events(spark.read.format("binaryFile").load(path).select("path", "content"), variable)


def mat_events(files: DataFrame, variable: str) -> DataFrame:
    """(session, event_id, start, stop, peak, amplitude, duration, frequency) of event structures in MAT files."""
    import pandas as pd

    columns = ["session", "event_id", "start", "stop", "peak", "amplitude", "duration", "frequency"]

    def rows(frames):
        for f in frames:
            held, size = [], 0
            for p, c in zip(f["path"], f["content"], strict=True):
                s = parse_mat(bytes(c)).get(variable, {})
                ts = np.atleast_2d(np.asarray(s.get("timestamps", np.zeros((0, 2))), float))
                n = len(ts)
                field = lambda k, s=s, n=n: (lambda v: np.full(n, v[0]) if len(v) == 1 else v if len(v) == n else np.full(n, np.nan))(np.asarray(s.get(k, np.zeros(0)), float).ravel())
                held.append((np.full(n, p.rsplit("/", 2)[-2], object), np.arange(n, dtype="int32"), ts[:, 0], ts[:, 1], field("peaks"), field("amplitude"), field("duration"), field("frequency")))
                size += n
                if size > _ROWS:
                    yield frame(held)
                    held, size = [], 0
            if held:
                yield frame(held)

    def frame(held):
        return pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*held)))))

    got = files.mapInPandas(rows, "session string, event_id int, start double, stop double, peak double, amplitude double, duration double, frequency double")
    return got.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if c in columns[2:] else c for c in columns])


def read_log_epochs(spark: SparkSession, path: str, gap: float = 30.0) -> DataFrame:
    """(session, start, stop): activity in a text log with clock times, merged over pauses of at most ``gap`` seconds."""
    from ..operators.intervals import merge

    clock = F.regexp_extract("value", r"(\d{1,2}):(\d{2}):(\d{2})", 0)
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("session"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), clock.alias("c")).where("c <> ''")
    p = F.split("c", ":")
    sec = p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int")
    from pyspark.sql import Window

    w = Window.partitionBy("session").orderBy("_b", "_i")
    x = rows.withColumn("s", sec)
    x = x.withColumn("_wrap", (F.col("s") < F.lag("s", 1, 0).over(w)).cast("int")).withColumn("t", F.col("s") + 86400 * F.sum("_wrap").over(w))
    first = F.min("t").over(Window.partitionBy("session"))
    x = x.withColumn("start", (F.col("t") - first).cast("double"))
    return merge(x.select("session", "start", F.col("start").alias("stop")), ["session"], gap)
