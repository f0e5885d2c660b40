"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text becomes counts of hashed 2- and 3-grams of its lower-cased UTF-8 bytes,
weighted by log(1 + count) and inverse document frequency, and normalised. Each
language has a few centroids, found by spherical k-means; the nearest one by
cosine names the language. A text further from its centroid than nearly all of
the training texts is marked as rejected.

Document frequencies come from all training rows. The centroids are fitted on a
sample bounded by ``sample`` rows a language. The model has DIMENSIONS floats
for each centroid, whatever the size of the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

DIMENSIONS = 4096
CENTROIDS = 3
#: Training rows a language that the centroids are fitted on, in expectation.
SAMPLE = 1500
#: Share of the training texts that lies beyond the limit of distance.
REJECT = 0.002

_SHIFT = np.uint32(32 - DIMENSIONS.bit_length() + 1)
_TO_SPACE = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def counts(text: str | None) -> np.ndarray:
    """Hashed n-gram counts of the whole text."""
    raw = (" " + (text or "").lower() + " ").encode("utf-8", "replace").translate(_TO_SPACE)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    two = (b[:-1] << np.uint32(8)) | b[1:]
    three = (two[:-1] << np.uint32(8)) | b[2:]
    at = np.concatenate([(two * np.uint32(2654435761)) >> _SHIFT, (three * np.uint32(2246822519)) >> _SHIFT])
    return np.bincount(at, minlength=DIMENSIONS)


def vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(np.stack([counts(t) for t in texts])).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def centroids(x: np.ndarray, k: int = CENTROIDS, rounds: int = 12) -> np.ndarray:
    """Spherical k-means with spread-out first centres; fewer than k rows give fewer centroids."""
    c = [x.mean(axis=0)]
    while len(c) < min(k, len(x)):
        c.append(x[np.argmin(np.max(x @ np.stack(c).T, axis=1))])
    c = np.stack(c)
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    centres: np.ndarray
    #: lowest accepted cosine of each centroid
    limits: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        some = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not some or not self.languages:
            return out
        for at in range(0, len(some), 256):
            part = some[at : at + 256]
            cos = vectors([texts[i] for i in part], self.idf) @ self.centres.T
            best = cos.argmax(axis=1)
            for i, j, s in zip(part, best.tolist(), cos.max(axis=1).tolist(), strict=True):
                out[i] = (self.languages[j], min(1.0, max(0.0, s)), s < self.limits[j])
        return out


def fit(train: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on rows of ``text`` and ``lang``; rows without a language are passed over.

    ``train`` may have a column ``at`` in [0, 1) that orders rows at random;
    the sample takes those below a share of each language.
    """
    rows = train.where("lang is not null and text is not null").select("text", "lang", "at")
    schema = pa.schema([("feature", pa.int32()), ("n", pa.int64())])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                total += counts(t) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS), pa.int32()), pa.array(np.r_[n, total], pa.int64())], schema=schema)

    found = rows.select("text").mapInArrow(frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    got = {r["feature"]: r["n"] for r in found.collect()}  # DIMENSIONS + 1 rows
    df = np.array([got.get(i, 0) for i in range(DIMENSIONS)], float)
    idf = (np.log((1 + got.get(-1, 0)) / (1 + df)) + 1).astype(np.float32)

    share = {r["lang"]: min(1.0, sample / r["count"]) for r in rows.groupBy("lang").count().collect()}
    if not share:
        return Model(idf, [], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0))
    shares = rows.sparkSession.createDataFrame(list(share.items()), "lang string, share double")
    chosen = rows.join(F.broadcast(shares), "lang").where("at < share")  # a row a language

    def vectorised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                x = vectors(s.column(1).to_pylist(), idf)
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "x"])

    def cluster(g: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(sorted(g["x"])), np.float32).reshape(-1, DIMENSIONS)
        c = centroids(x)
        cos = x @ c.T
        near = cos.argmax(axis=1)
        limit = [float(np.quantile(cos[near == j, j], REJECT)) if (near == j).any() else 0.0 for j in range(len(c))]
        return pd.DataFrame({"lang": g["lang"].iloc[0], "c": [v.tobytes() for v in c], "lim": limit})

    made = chosen.select("lang", "text").mapInArrow(vectorised, "lang string, x binary").groupBy("lang").applyInPandas(cluster, "lang string, c binary, lim double").collect()
    made.sort(key=lambda r: (r["lang"], r["c"]))
    return Model(idf, [r["lang"] for r in made], np.stack([np.frombuffer(r["c"], np.float32) for r in made]), np.array([r["lim"] for r in made]))


def identify(docs: DataFrame, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row.

    ``held_out`` tells the rows that the model must not learn from; a
    prediction sees the text alone. ``und`` with score 0 stands for a null
    text, a text without a letter, and any text if there is nothing to learn
    from. A row whose ``held_out`` is null counts as held out. Repeated rows
    are predicted alike; other columns are ignored.
    """
    held = F.coalesce(held_out, F.lit(True))
    text = F.col("text").cast("string")
    train = docs.where(~held).select(text.alias("text"), F.col("lang").cast("string").alias("lang"), (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)).alias("at"))
    model = fit(train, sample)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = shared.value.predict(b.column(2).to_pylist())
            cols = list(zip(*got, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t.type) for c, t in zip(cols, list(schema)[2:], strict=True))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), text.alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
